"""Exact duplicates by counting quotient filters, with the suspects compared byte by byte.

A 64-bit fingerprint of the normalised text splits into a quotient (its leading bits, the block) and a remainder. Every
task builds filters of its own rows: per block the sorted remainders, as many bytes wide as the quotient leaves, and a counter of
one byte each; counts that don't fit stand in an overflow list. Filters of one block merge without loss by merging the sorted
remainders and adding the counts. A fingerprint with count 1 proves its row unique; all others go to the byte comparison, which
groups by the normalised text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.rows import BLANKS, map_batches, numbered, row_ids, text_of
from assayloom.staging import stage

#: Fingerprints per block of the filter, on average. It bounds a block's memory, not what is counted.
BLOCK_FINGERPRINTS = 16_384
#: Different fingerprints that a task holds; beyond, it gives out the filter that it has and begins another.
HELD_FINGERPRINTS = 4_000_000
_FULL = 255
#: The routing table has 2**27 bits in rows of 32,768: at most 4,096 rows and 16 MB, however many fingerprints repeat.
ROUTE_BITS = 27
_ROW_BITS = 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def _quotients(fingerprints: np.ndarray, quotient_bits: int) -> np.ndarray:
    if not quotient_bits:
        return np.zeros(len(fingerprints), np.int64)
    return (fingerprints.view(np.uint64) >> np.uint64(64 - quotient_bits)).astype(np.int64)


def partition_filters(rows: DataFrame, fingerprint: str, quotient_bits: int) -> DataFrame:
    """Rows of a task's filters, one per block: sorted remainders, their counters, and the counts that overflow them.

    Batches wait until they are as many as what is held, so a task takes n log n steps; it holds ``HELD_FINGERPRINTS`` at most.
    """

    def given(held: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = held
        if not len(keys):
            return
        blocks, starts = np.unique(_quotients(keys, quotient_bits), return_index=True)
        ends = np.append(starts[1:], len(keys))
        for i in range(0, len(blocks), 1024):
            part = slice(i, i + 1024)
            packed = zip(*[pack(keys[a:b], counts[a:b], quotient_bits) for a, b in zip(starts[part], ends[part])])
            yield pa.RecordBatch.from_arrays([pa.array(blocks[part]), *[pa.array(c, pa.binary()) for c in packed]], names=_FILTER)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            waiting.append((values, np.ones(len(values), np.int64)))
            size += len(values)
            if size > max(len(held[0]), 1 << 16):
                held, waiting, size = merge_sorted([held, *waiting]), [], 0
                if len(held[0]) > HELD_FINGERPRINTS:
                    yield from given(held)
                    held = held[0][:0], held[1][:0]
        yield from given(merge_sorted([held, *waiting]))

    kinds = "block long, remainders binary, counters binary, overflow binary"
    return map_batches(rows.select(fingerprint), kinds, build)


_FILTER = ["block", "remainders", "counters", "overflow"]


def _width(quotient_bits: int) -> int:
    """Bytes of a remainder."""
    return -(-(64 - quotient_bits) // 8)


def pack(keys: np.ndarray, counts: np.ndarray, quotient_bits: int) -> tuple[bytes, bytes, bytes]:
    """Sorted fingerprints of one quotient as remainders, counters and the counts from ``_FULL`` on, in order."""
    remainders = keys & np.uint64((1 << (64 - quotient_bits)) - 1)
    cut = np.ascontiguousarray(remainders).view(np.uint8).reshape(-1, 8)[:, : _width(quotient_bits)]
    return cut.tobytes(), np.minimum(counts, _FULL).astype(np.uint8).tobytes(), counts[counts >= _FULL].tobytes()


def unpack(block: int, remainders: bytes, counters: bytes, overflow: bytes, quotient_bits: int) -> tuple[np.ndarray, np.ndarray]:
    cut = np.frombuffer(remainders, np.uint8).reshape(-1, _width(quotient_bits))
    wide = np.zeros((len(cut), 8), np.uint8)
    wide[:, : cut.shape[1]] = cut
    keys = wide.view(np.uint64).ravel()
    if quotient_bits:
        keys = keys | np.uint64(block << (64 - quotient_bits))
    counts = np.frombuffer(counters, np.uint8).astype(np.int64)
    counts[counts == _FULL] = np.frombuffer(overflow, np.int64)
    return keys, counts


def merge_sorted(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lossless merge: the sorted union of the remainders with the counts added."""
    keys = np.concatenate([f[0] for f in filters])
    counts = np.concatenate([f[1] for f in filters])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts)


def merged_filters(filters: DataFrame, quotient_bits: int) -> DataFrame:
    """Every fingerprint with its count over all tasks."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = zip(*[group[c] for c in _FILTER])
        keys, counts = merge_sorted([unpack(*row, quotient_bits) for row in rows])
        return pd.DataFrame({"fingerprint": keys.view(np.int64), "n": counts})

    return filters.groupBy("block").applyInPandas(merge, "fingerprint long, n long")


def routing_table(repeated: DataFrame) -> DataFrame:
    """A bitmap of the repeated fingerprints' leading bits: at most 4,096 rows of 4 kB each."""
    place = F.shiftrightunsigned("fingerprint", 64 - ROUTE_BITS)
    return (
        repeated.select(place.alias("place"))
        .groupBy(F.shiftright("place", _ROW_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place"))).alias("bits"))
    )


def _routed(fingerprint: Column) -> tuple[Column, Column]:
    place = F.shiftrightunsigned(fingerprint, 64 - ROUTE_BITS)
    inside = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.shiftright(place, _ROW_BITS), F.getbit(byte.cast("long"), inside.bitwiseAND(F.lit(7)).cast("int"))


def mark_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", rid: str | None = None) -> DataFrame:
    """One row per input row: rid, key, keep_id, keep_rid, group_size, kept, text_sha256.

    Texts are equal when identical without blanks (space, tab to carriage return). The row with the most code points stays,
    then the smallest key (null keys last), then the first of repeated rows: exactly one row of a group has ``kept``. A null
    text counts as empty; an empty table gives an empty result. ``rid`` is the column of that name in ``docs``, if one is given
    (whole numbers, unique), else a number of the row as this scan saw it.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), text_of(f"`{text}`").alias("text"), *row_ids(rid))
    plain = normalised(F.col("text"))
    table = numbered(
        source.select(
            "key",
            F.length("text").cast("long").alias("size"),
            F.xxhash64(plain).alias("fingerprint"),
            F.sha2(plain, 256).alias("digest"),
            *row_ids(rid and "rid"),
        ),
        "exact-rows",
    )
    quotient_bits = min(24, max(0, (table.count() // BLOCK_FINGERPRINTS).bit_length()))
    merged = merged_filters(partition_filters(table, "fingerprint", quotient_bits), quotient_bits)
    repeated = stage(merged.where("n > 1").select("fingerprint"), "repeated-fingerprints")

    # Rows whose leading bits no repeated fingerprint has are proven unique and never shuffle their text.
    bucket, bit = _routed(F.col("fingerprint"))
    hashed = source.withColumn("plain", plain).withColumn("fingerprint", F.xxhash64("plain"))
    route = F.broadcast(routing_table(repeated))
    suspects = hashed.join(route, bucket == F.col("bucket")).where(bit == 1)
    confirmed = suspects.groupBy("plain").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = confirmed.select(F.sha2("plain", 256).alias("digest"))

    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("key").isNull().alias("last"), "key", "rid")).alias("best")
    heads = (
        table.join(F.broadcast(routing_table(repeated)), bucket == F.col("bucket"))
        .where(bit == 1)
        .groupBy("digest")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .join(groups, "digest")
        .select("digest", F.col("best.key").alias("keep_key"), F.col("best.rid").alias("keep_rid"), "group_size")
    )
    heads = stage(heads, "exact-heads")
    alone = F.col("keep_rid").isNull()
    return table.join(heads, "digest", "left").select(
        "rid",
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("keep_key")).alias("keep_id"),
        F.coalesce("keep_rid", "rid").alias("keep_rid"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_rid") == F.col("rid"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )

"""Near duplicates by SimHash, with candidates from Golay-code fuzzy hashing.

The perfect binary Golay code (23, 12) puts every 23-bit word within 3 bits of one codeword. A 64-bit fingerprint is cut
into segments of 22, 21 and 21 bits. A segment's *index* is the number of its codeword; its *near indices* are those of all
words within one bit of it, six at most. If two segments differ in at most one bit, the index of one is a near index of the
other.

At most three differing bits fall on three segments (pigeonhole): either every segment has at most one, and the three indices
meet; or one segment has two or three, and of the other two one is equal and one differs in at most one bit, so the equal
segment with the index of the other one meets. One side of the join gives its near indices and the other its plain ones; each
key has 33 bits or more, and every pair with three or fewer differing bits shares one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.graph import components
from assayloom.llm.rows import TEXT_ROWS, map_batches, numbered, row_ids, text_of, whole
from assayloom.staging import stage

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
_CHUNK = 1 << 16

# The Golay code's generator polynomial and the segments' places in a fingerprint.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_NEAR = 6


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles; fewer words are one shingle, none gives 0."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        places = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in places], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_bits > len(starts), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE_WORDS, rid: str | None = None
) -> DataFrame:
    """``key, fp`` (and ``rid``, where given) per input row; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in whole(batch, "text")]
            arrays = [batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "fp", "rid"][: len(arrays)])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_of(f"`{text}`").alias("text"), *row_ids(rid))
    return map_batches(source, "key long, fp long" + (", rid long" if rid else ""), work, TEXT_ROWS)


def _remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern of each syndrome."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            errors[_remainder(pattern)] = pattern
    return low, high, errors


_LOW, _HIGH, _ERRORS = _tables()


def index_of(words: np.ndarray) -> np.ndarray:
    """The 12-bit number of the codeword within three bits of each 23-bit word."""
    return (words ^ _ERRORS[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


def near_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``[n, 6]`` indices of the words within one bit, and which of the places are filled."""
    flips = np.append(0, 1 << np.arange(width))
    found = np.sort(index_of(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(new)
    places = (np.cumsum(new, axis=1) - 1)[rows, columns]
    out, filled = np.zeros((len(words), MOST_NEAR), np.int64), np.zeros((len(words), MOST_NEAR), bool)
    out[rows, places] = found[rows, columns]
    filled[rows, places] = True
    return out, filled


def _segments(values: np.ndarray) -> list[np.ndarray]:
    bits = values.view(np.uint64)
    return [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def plain_keys(values: np.ndarray) -> np.ndarray:
    """``[n, 7]``: the three indices together, and each equal segment with the index of each other one."""
    parts = _segments(values)
    index = [index_of(p) for p in parts]
    keys = [index[0] << 24 | index[1] << 12 | index[2]]
    for tag, (i, j) in enumerate(permutations(range(3), 2), 1):
        keys.append(tag << 40 | parts[i] << 12 | index[j])
    return np.stack(keys, axis=1)


def near_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[n, 252]`` keys that meet a plain key of everything within three bits, and which of them exist."""
    parts = _segments(values)
    near, filled = zip(*[near_indices(p, width) for p, (_, width) in zip(parts, SEGMENTS)])
    together = near[0][:, :, None, None] << 24 | near[1][:, None, :, None] << 12 | near[2][:, None, None, :]
    exist = filled[0][:, :, None, None] & filled[1][:, None, :, None] & filled[2][:, None, None, :]
    keys, real = [together.reshape(len(values), -1)], [exist.reshape(len(values), -1)]
    for tag, (i, j) in enumerate(permutations(range(3), 2), 1):
        keys.append(tag << 40 | parts[i][:, None] << 12 | near[j])
        real.append(filled[j])
    return np.concatenate(keys, axis=1), np.concatenate(real, axis=1)


def _keyed(classes: DataFrame, near: bool) -> DataFrame:
    """``rep, fp, key``: one row per key of every distinct fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(at, 2048)
                values = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                if near:
                    keys, real = near_keys(values)
                    counts, flat = real.sum(axis=1), keys[real]
                else:
                    keys = plain_keys(values)
                    counts, flat = np.full(len(values), keys.shape[1]), keys.reshape(-1)
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["rep", "fp", "keys"])

    listed = map_batches(classes.select("rep", "fp"), "rep long, fp long, keys array<long>", work)
    return listed.select("rep", "fp", F.explode("keys").alias("key"))


def links_between(classes: DataFrame) -> DataFrame:
    """``a, b`` (a < b): all pairs of distinct fingerprints with three or fewer differing bits."""
    near = _keyed(classes, True).select(F.col("rep").alias("a"), F.col("fp").alias("fa"), "key")
    plain = _keyed(classes, False).select(F.col("rep").alias("b"), F.col("fp").alias("fb"), "key")
    apart = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    pairs = near.join(plain, (near["key"] == plain["key"]) & (F.col("a") < F.col("b")) & (apart <= MOST_BITS))
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", rid: str | None = None) -> DataFrame:
    """One row per input row: rid, key, fingerprint (16 hex digits), component_id, links (of its fingerprint), kept.

    Rows link when their fingerprints differ in three bits or fewer; ``component_id`` is the smallest key reachable. Copies
    of a fingerprint are one node, so no pairs are made inside a group of copies. Empty and null texts have fingerprint zero
    and link like any other; null keys take no part in naming a component (null only if all its keys are null); an empty
    table gives an empty result. Exactly one row of a component is ``kept``: of its smallest key, the first of repeated rows.
    ``rid`` is the column of that name in ``docs``, if one is given (whole numbers, unique), else a number of the row.
    """
    table = numbered(fingerprints(docs, text, key, rid=rid), "fingerprints")
    best = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "rid"))
    classes = stage(table.groupBy("fp").agg(F.min("rid").alias("rep"), best.alias("best")), "fingerprint-classes")
    links = stage(links_between(classes), "fingerprint-links")
    roots = components(links, "a", "b")
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    placed = (
        classes.join(roots, classes["rep"] == roots["node"], "left")
        .drop("node")
        .join(ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links")), "rep", "left")
        .select("fp", "best", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    placed = stage(placed, "fingerprint-roots")
    heads = placed.groupBy("root").agg(F.min("best").alias("head"))
    named = stage(placed.join(heads, "root").select("fp", "head", "links"), "fingerprint-names")
    return table.join(named, "fp").select(
        "rid",
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.key").alias("component_id"),
        F.col("links").cast("long").alias("links"),
        (F.col("head.rid") == F.col("rid")).alias("kept"),
    )

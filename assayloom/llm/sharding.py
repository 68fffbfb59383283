"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows each partition sends to each target is one draw from the multivariate hypergeometric law with both margins
fixed: the partition sizes and the wanted target sizes. Each partition permutes its rows locally and deals them out by its
row of the matrix; the rows themselves are exchanged by target; every target permutes what it got and numbers it, so a row comes
out where its target lies. The result is a uniform permutation of all rows.

The matrix is never built. A binary tree over the partitions splits the target counts at every node with a seeded draw, and a
partition finds its own row by walking down the tree. A shard of more than ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of text is
several targets, so no task holds a whole shard. The driver sees one number per partition, as the scheduler does anyway.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.rows import boxed, numbered

SHARDS = 40
BLOCK_ROWS = 1_000_000
#: Bytes of text in a target, about: rows are dealt at random, so targets of a shard hold nearly equal bytes.
BLOCK_BYTES = 128 << 20
SEED = 20_240_611
_PART_BITS = 33
_NUMPY_MOST = 999_999_999


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw, also for populations beyond NumPy's limit (by inversion around the mode)."""
    if good + bad <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mean = draws * good / total
    spread = math.sqrt(max(mean * (bad / total) * ((total - draws) / (total - 1)), 1.0))
    low = max(0, draws - bad, int(mean - 14 * spread))
    high = min(good, draws, int(mean + 14 * spread) + 1)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - x) * (draws - x)) - np.log((x + 1) * (bad - draws + x + 1))
    logs = np.append(0.0, np.cumsum(steps))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split_counts(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` rows go to each target when ``counts`` rows per target are left in all."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, here in enumerate(counts.tolist()):
        rest -= here
        if draws and here:
            out[i] = hypergeometric(rng, here, rest, draws) if rest else draws
            draws -= int(out[i])
    return out


def matrix_row(starts: list[int], targets: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Partition ``part``'s counts per target; ``starts`` holds the rows before each partition, and the total last."""
    low, high, counts = 0, len(starts) - 1, targets
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, 1, low, high])
        left = split_counts(rng, counts, starts[middle] - starts[low])
        low, high, counts = (low, middle, left) if part < middle else (middle, high, counts - left)
    return counts


def target_sizes(rows: int, shards: int, blocks: int) -> np.ndarray:
    """Exact target sizes: shards at most one row apart, and so the blocks within each."""
    sizes = []
    for shard in range(shards):
        whole = rows // shards + (shard < rows % shards)
        sizes += [whole // blocks + (block < whole % blocks) for block in range(blocks)]
    return np.array(sizes, np.int64)


def shuffle_into_shards(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``row`` (the input row as a struct), ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Shard sizes are at most one row apart. Repeated rows, nulls and empty texts are rows like any other; fewer rows than
    shards leave some shards empty; an empty table gives an empty result. Given the partitions of ``df``, the same seed gives
    the same result.
    """
    length = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    bytes_ = sum(length, F.lit(16)).cast("long")
    table = numbered(boxed(df, bytes=bytes_), "to-shard").withColumn("part", F.shiftright("rid", _PART_BITS))
    counts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    sizes, size = {r["part"]: r["n"] for r in counts}, sum(r["bytes"] for r in counts)
    starts = [0]
    for part in range(max(sizes, default=-1) + 1):
        starts.append(starts[-1] + sizes.get(part, 0))
    rows = starts[-1]
    blocks = max(1, -(-(-(-rows // shards)) // block_rows), -(-size // (shards * block_bytes)))
    targets = target_sizes(rows, shards, blocks)
    shared = df.sparkSession.sparkContext.broadcast((starts, targets))

    @F.arrow_udf("int")
    def target(rids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        starts, targets = shared.value
        held: tuple[int, np.ndarray] = -1, np.empty(0, np.int32)
        for rid in rids:
            rid = rid.to_numpy(zero_copy_only=False)
            parts, places = rid >> _PART_BITS, rid & ((1 << _PART_BITS) - 1)
            out = np.empty(len(rid), np.int32)
            for part in np.unique(parts).tolist():
                if held[0] != part:
                    counts = matrix_row(starts, targets, part, seed)
                    labels = np.repeat(np.arange(len(targets), dtype=np.int32), counts)
                    held = part, np.random.default_rng([seed, 2, part]).permutation(labels)
                here = parts == part
                out[here] = held[1][places[here]]
            yield pa.array(out)

    whole = F.lit(rows // shards) + (F.col("shard") < rows % shards).cast("long")
    block = F.col("target") % blocks
    start = block * F.floor(whole / blocks) + F.least(block, whole % blocks)
    again = Window.partitionBy("target").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid")
    return (
        table.select("rid", "row", target("rid").alias("target"))
        .withColumn("shard", F.floor(F.col("target") / blocks).cast("int"))
        .withColumn("slot", (start + F.row_number().over(again) - 1).cast("long"))
        .select("row", "shard", "slot")
    )

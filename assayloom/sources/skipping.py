"""Equality scans that open only the files that can hold a match.

An index table has, per file and column, the smallest and largest value and a Bloom filter of all values. A scan turns its predicates
into a filter on that table, reads the names of the files that are left, and scans those with the same predicates. A file is left out
only if a range or a filter proves that it has no match, so the result is that of the full scan.

Ranges prove little when every file holds a bit of everything. ``write_by_neighbourhood`` lays a table out along a Z-order curve: columns
are cut into parts of about equal size, and files take neighbouring parts of all columns together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.sources.tables import filtered_scan, scan

#: Bits of a block of a Bloom filter (the width of Spark's bitmaps), and how many bits a value sets.
BLOCK_BITS, HASHES = 32_768, 4
#: Different values that a filter is made for; more of them make it say "maybe" more often, never "no" wrongly.
VALUES = 16_384
#: Bits of a column's part number in the Z-order.
PART_BITS = 6
_FILE = "_file"


def _block_count(values: int) -> int:
    """Blocks for about eight bits a value: one in forty other values passes."""
    return max(1, -(-values * 8 // BLOCK_BITS))


def _places(value: Column, blocks: int) -> Column:
    """Where a value's bits lie, from 0."""
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(i)), F.lit(blocks * BLOCK_BITS)) for i in range(HASHES)])


def build_index(spark: SparkSession, path: str, columns: Sequence[str], index: str, values: int = VALUES) -> None:
    """Write the index of a Parquet table's columns: one row per file, column and block. The table is read once per column.

    Null values match no equality and are left out; a column without values in a file has no row, so the file is never read.
    """
    table, blocks = scan(spark, path), _block_count(values)
    parts = []
    for name in columns:
        value = F.col(f"`{name}`")
        rows = table.select(F.col("_metadata.file_path").alias(_FILE), value.alias("value")).where("value IS NOT NULL")
        placed = rows.withColumn("place", F.explode(_places(F.col("value"), blocks)))
        # Bitmaps are numbered from 1, bits from 0.
        block = F.floor(F.col("place") / BLOCK_BITS).cast("int").alias("block")
        bits = placed.groupBy(_FILE, block).agg(
            F.bitmap_construct_agg(F.pmod("place", F.lit(BLOCK_BITS))).alias("bits"),
            F.min("value").cast("string").alias("least"),
            F.max("value").cast("string").alias("most"),
        )
        # Every block of a file has the ends of the values that set a bit of it, which are no wider than those of the file.
        parts.append(bits.withColumns({"column": F.lit(name), "blocks": F.lit(blocks)}))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found.write.mode("overwrite").partitionBy("column").parquet(index)


def files_to_read(spark: SparkSession, table: DataFrame, index: str, equals: Mapping[str, Any]) -> list[str]:
    """The files that can hold a row that meets every equality; only their names reach the driver."""
    found = scan(spark, index)
    known = {r["column"]: r["blocks"] for r in found.groupBy("column").agg(F.max("blocks").alias("blocks")).collect()}
    used = {n: v for n, v in equals.items() if n in known}
    if not used:
        raise ValueError(f"the index has columns {sorted(known)}, not one of {sorted(equals)}")
    left: DataFrame | None = None
    for name, value in used.items():
        kind = table.schema[name].dataType
        wanted = F.lit(value).cast(kind)
        # A value's bits lie in a few blocks; all of them have to be set, and each block's ends have to enclose the value.
        place = F.explode(F.array_distinct(_places(wanted, known[name]))).alias("place")
        asked = spark.range(1).select(place)
        asked = asked.select(F.floor(F.col("place") / BLOCK_BITS).cast("int").alias("block"), F.pmod("place", F.lit(BLOCK_BITS)).alias("bit"))
        rows = found.where(F.col("column") == name).where(
            (F.col("least").cast(kind) <= wanted) & (F.col("most").cast(kind) >= wanted)
        )
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
        hits = rows.join(F.broadcast(asked), "block").where(is_set)
        count = asked.count()
        files = hits.groupBy(_FILE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == count).select(_FILE)
        left = files if left is None else left.join(files, _FILE, "left_semi")
    return sorted(r[_FILE] for r in left.collect())


def skipping_scan(spark: SparkSession, path: str, index: str, equals: Mapping[str, Any], columns: Sequence[str]) -> DataFrame:
    """:func:`filtered_scan` over the files that the index leaves; equal to it over all files."""
    table = scan(spark, path)
    files = files_to_read(spark, table, index, equals)
    if not files:
        return filtered_scan(spark.createDataFrame([], table.schema), equals, columns)
    return filtered_scan(spark.read.schema(table.schema).parquet(*files), equals, columns)


def _below(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda bound: bound <= value))


def _parts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """A part number per column: by quantiles for numbers, so that ranges prune too, by a hash for everything else."""
    count = 1 << PART_BITS
    numeric = [c for c in columns if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    shares = [i / count for i in range(1, count)]
    bounds = df.agg(F.count(F.lit(1)), *[F.percentile_approx(F.col(f"`{c}`"), shares, 1000) for c in numeric]).first()[1:] if numeric else []
    known = dict(zip(numeric, bounds))
    out = []
    for c in columns:
        value = F.col(f"`{c}`")
        if known.get(c):
            held = F.array(*[F.lit(b) for b in dict.fromkeys(known[c])])
            out.append(F.coalesce(_below(held, value), F.lit(0)))
        else:
            out.append(F.pmod(F.xxhash64(value), F.lit(count)).cast("int"))
    return out


def write_by_neighbourhood(df: DataFrame, path: str, columns: Sequence[str], files: int) -> None:
    """A Parquet table of about ``files`` files of equal size along a Z-order curve of the columns.

    Part numbers come from a sketch of the table, files from ranges of the curve and, within, of the columns; so a value that
    fills a third of the table is split by the other columns.
    """
    if not 0 < len(columns) * PART_BITS < 63:
        raise ValueError(f"one to {62 // PART_BITS} columns, not {len(columns)}")
    curve = F.lit(0).cast("long")
    for j, part in enumerate(_parts(df, columns)):
        for i in range(PART_BITS):
            bit = F.shiftright(part, i).bitwiseAND(F.lit(1)).cast("long")
            curve = curve.bitwiseOR(F.shiftleft(bit, i * len(columns) + j))
    placed = df.withColumn("_curve", curve)
    ranged = placed.repartitionByRange(files, "_curve", *columns).sortWithinPartitions("_curve", *columns)
    ranged.drop("_curve").write.mode("overwrite").parquet(path)

"""Rows by their position in Parquet files, for tables that hold no key and belong together row by row.

A row's place in its file is known to the reader, whichever part of the file a task reads. Only the rows before each file have to be
added: one count per file, from the scan of no column at all. So a position takes no sort, no window over the rows and no shuffle of
them. Files follow one another as their writer named them: by folder, then shorter names first, then by name, which puts
``part-100000`` behind ``part-99999``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.sources.tables import scan
from assayloom.staging import stage

POSITION = "position"
#: The table of files is broadcast up to this many of them (a path and a number each); beyond, it is joined.
BROADCAST_FILES = 100_000
_FILE, _PLACE = "_file", "_place"


class UnequalLengths(ValueError):
    """Tables that should match row by row and don't have the same number of rows."""


def _file_order() -> list[Column]:
    name = F.element_at(F.split(_FILE, "/"), -1)
    folder = F.left(_FILE, F.length(_FILE) - F.length(name))
    return [folder, F.length(name), name]


def file_offsets(rows: DataFrame) -> DataFrame:
    """``_file, rows, before``: the rows of each file and of the files before it. One row per file, so one task orders them."""
    sizes = rows.groupBy(_FILE).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy(*_file_order()).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def read_with_positions(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns of a Parquet table and each row's ``position``, from 0 without gaps. An empty table has no rows."""
    found = scan(spark, path)
    wanted = found.columns if columns is None else list(columns)
    metadata = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_PLACE)]
    offsets = stage(file_offsets(found.select(metadata[0])), "file-offsets")
    files = offsets.count()
    rows = found.select(*[F.col(f"`{c}`") for c in wanted], *metadata)
    kept = offsets.select(_FILE, "before")
    joined = rows.join(F.broadcast(kept) if files <= BROADCAST_FILES else kept, _FILE)
    return joined.select(*[F.col(f"`{c}`") for c in wanted], (F.col("before") + F.col(_PLACE)).alias(POSITION))


def joined_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row by row, two tables with a ``position``; :class:`UnequalLengths` unless both hold the same positions, once each.

    Columns of both sides have to differ. The positions are checked before anything is joined.
    """
    clash = sorted((set(left.columns) & set(right.columns)) - {POSITION})
    if clash:
        raise ValueError(f"both tables have columns {clash}")
    spans = []
    for side in (left, right):
        p = F.col(POSITION)
        one = side.agg(F.count(p).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.sum(p.cast("decimal(38,0)")).alias("sum"))
        spans.append(tuple(one.first()))
    if spans[0] != spans[1]:
        raise UnequalLengths(f"rows, first, last and sum of the positions differ: {spans[0]} and {spans[1]}")
    return left.join(right, POSITION)


def read_side_by_side(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two Parquet tables without keys, joined row by row."""
    return joined_by_position(read_with_positions(spark, left), read_with_positions(spark, right))

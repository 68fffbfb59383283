"""Exact running totals and order statistics without a one-task window.

Spark sends every row of a window partition to one task. That is wrong for a group, or an ungrouped table, of unbounded size.
The functions here have one path for every size. They

1. range-partition by (keys, order), so a big group spans many partitions, and stage the result with its chunk number,
2. total each (keys, chunk), at most #keys + #chunks rows,
3. turn those totals into offsets, and
4. run the window inside each (keys, chunk) only, adding the offset.

Order columns are given by name, with a leading ``-`` for descending. The order has to be total for the result to be
unique. Null keys form a group of their own. The input is read twice: stage it first if it is dear to compute.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.staging import stage

_CHUNK = "_chunk"


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that lets null keys meet; the right copy of the keys is dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition).drop(*[f"_right_{k}" for k in keys])


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*sort_columns(keys), *sort_columns(order))
    return stage(ranged.withColumn(_CHUNK, F.spark_partition_id()), "chunked")


def _window(keys: Sequence[str], order: Sequence[str], through: int = 0) -> Window:
    window = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return window.orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, through)


def _aggregate(kind: str, column: str) -> Column:
    return F.sum(column) if kind == "sum" else F.max(column)


def _through(kind: str) -> int:
    return -1 if kind == "max_before" else 0


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add running aggregates per key.

    ``outputs`` maps a new column to ``(kind, column)``. Kinds are ``sum`` and ``max``, which include the current row,
    and ``max_before``, which stops before it and is null on a group's first row.
    """
    rows = _chunked(df, keys, order)
    totals = rows.groupBy(*keys, _CHUNK).agg(
        *[_aggregate(kind, column).alias(f"_in_{name}") for name, (kind, column) in outputs.items()]
    )
    earlier = _window(keys, [_CHUNK], -1)
    offsets = totals.select(
        *keys,
        _CHUNK,
        *[
            _aggregate(kind, f"_in_{name}").over(earlier).alias(f"_before_{name}")
            for name, (kind, _) in outputs.items()
        ],
    )
    joined = join_null_safe(rows, offsets, [*keys, _CHUNK])
    added = {}
    for name, (kind, column) in outputs.items():
        before = F.col(f"_before_{name}")
        inside = _aggregate(kind, column).over(_window([*keys, _CHUNK], order, _through(kind)))
        if kind == "sum":
            added[name] = F.coalesce(before + inside, before, inside)
        else:
            added[name] = F.greatest(before, inside)
    return joined.withColumns(added).drop(_CHUNK, *[f"_before_{name}" for name in outputs])


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Add per key ``row``, from 1, and ``best``: the largest ``value`` up to the row as ``(value, back)``, where ``back`` is minus
    the first row that has it; null until there is a value.

    Row numbers and maxima come from the same chunks: a chunk's maximum is placed by its own row numbers, and moved by the rows before
    the chunk.
    """
    inside = [*keys, _CHUNK]
    rows = _chunked(df, keys, order).withColumn("_row", F.row_number().over(Window.partitionBy(*inside).orderBy(*sort_columns(order))))
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("value"), (-F.col("_row")).cast("long").alias("back")))
    marked = rows.withColumn("_mark", mark)
    totals = marked.groupBy(*inside).agg(F.count(F.lit(1)).alias("_rows"), F.max("_mark").alias("_top"))
    earlier = _window(keys, [_CHUNK], -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    moved = lambda top: F.when(top.isNotNull(), F.struct(top["value"], (top["back"] - F.col("_before")).alias("back")))
    placed = totals.withColumn("_before", before).withColumn("_top", moved(F.col("_top")))
    offsets = placed.select(*inside, "_before", F.max("_top").over(earlier).alias("_best"))
    found = marked.withColumn("_mark", F.max("_mark").over(_window(inside, order)))
    joined = join_null_safe(found, offsets, inside)
    best = F.greatest(F.col("_best"), moved(F.col("_mark")))
    added = joined.withColumns({"row": F.col("_before") + F.col("_row"), "best": best})
    return added.drop(_CHUNK, "_row", "_mark", "_before", "_best")


def previous_values(df: DataFrame, order: Sequence[str], outputs: Mapping[str, str]) -> DataFrame:
    """Add, for every row of the whole ordered table, a column's value in the row before it (ascending order only)."""
    rows = _chunked(df, [], order)
    position = F.struct(*order)
    lasts = rows.groupBy(_CHUNK).agg(
        *[F.max_by(F.struct(column), position).alias(f"_last_{name}") for name, column in outputs.items()]
    )
    by_chunk = Window.orderBy(_CHUNK)
    offsets = lasts.select(
        _CHUNK, *[F.lag(f"_last_{name}").over(by_chunk).alias(f"_before_{name}") for name in outputs]
    )
    inside = Window.partitionBy(_CHUNK).orderBy(*sort_columns(order))
    joined = rows.join(offsets, _CHUNK)
    added = {
        name: F.coalesce(F.lag(F.struct(column)).over(inside), F.col(f"_before_{name}"))[column]
        for name, column in outputs.items()
    }
    return joined.withColumns(added).drop(_CHUNK, *[f"_before_{name}" for name in outputs])


def rows_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ranks: DataFrame | Sequence[int],
    weight: str | None = None,
) -> DataFrame:
    """The rows that hold given 1-based ranks in their group, with the rank in a ``rank`` column.

    ``ranks`` has the key columns and an array column ``ranks``; without keys it is a short list of numbers. A row with
    weight w covers w ranks. Only the chunks that contain a wanted rank are ordered.
    """
    rows = df if weight else df.withColumn("_weight", F.lit(1).cast("long"))
    weight = weight or "_weight"
    without_keys = None if keys else F.array(*[F.lit(int(r)).cast("long") for r in ranks])

    def with_ranks(table: DataFrame) -> DataFrame:
        return join_null_safe(table, ranks, keys) if keys else table.withColumn("ranks", without_keys)

    def hits(rows_with_ranks: DataFrame) -> DataFrame:
        held = F.filter("ranks", lambda r: (F.col("_upto") - F.col(weight) < r) & (r <= F.col("_upto")))
        return rows_with_ranks.withColumn("rank", F.explode(held)).drop("ranks", "_upto", "_weight")

    rows = _chunked(rows, keys, order)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.sum(weight).alias("_inside"))
    before = F.coalesce(F.sum("_inside").over(_window(keys, [_CHUNK], -1)), F.lit(0))
    spans = with_ranks(totals.withColumn("_before", before))
    inside_span = F.exists(
        "ranks", lambda r: (F.col("_before") < r) & (r <= F.col("_before") + F.col("_inside"))
    )
    spans = spans.where(inside_span).drop("_inside")
    counted = join_null_safe(rows, spans, [*keys, _CHUNK]).withColumn(
        "_upto", F.col("_before") + F.sum(weight).over(_window([*keys, _CHUNK], order))
    )
    return hits(counted).drop(_CHUNK, "_before")

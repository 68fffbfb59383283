"""Duplicate collapse: exact median and first identifier per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.ordered import join_null_safe, rows_at_ranks
from assayloom.staging import stage


def collapse_duplicates(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    first: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """One row per key: ``n``, the exact median of ``value`` and the ``first`` columns of the row first in ``order``.

    Clean ``value`` before (no NaN): Spark sorts NaN last where other tools skip it. Nulls are skipped.
    ``order`` has to be unique per row. Equal (key, value) pairs are counted first and the middle ranks come from
    range-partitioned chunks, so a key of any size is spread over tasks; there is one path for every size.
    """
    counted = stage(value_counts(df, keys, value, first, order), "value-counts")
    return collapse_counts(counted, keys, value, first)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, first: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keys, _value, _weight, _first``: rows per key and value, and the order and ``first`` columns of their first row.

    Counts of several tables add up: group their union again, sum the weights and take the least ``_first``.
    """
    rows = df.select(
        *keys, F.col(value).alias("_value"), F.struct(*order, *[c for c in first if c not in order]).alias("_first")
    )
    return rows.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_weight"), F.min("_first").alias("_first"))


def collapse_counts(counted: DataFrame, keys: Sequence[str], value: str, first: Sequence[str]) -> DataFrame:
    """:func:`collapse_duplicates` from staged :func:`value_counts`."""
    per_key = counted.groupBy(*keys).agg(
        F.sum("_weight").alias("n"),
        F.sum(F.when(F.col("_value").isNotNull(), F.col("_weight"))).alias("_valued"),
        F.min("_first").alias("_first"),
    )
    middle = F.array_distinct(F.array(F.expr("(_valued + 1) div 2"), F.expr("_valued div 2 + 1")))
    ranks = per_key.where("_valued > 0").select(*keys, middle.alias("ranks"))
    present = counted.where(F.col("_value").isNotNull()).drop("_first")
    found = rows_at_ranks(present, keys, ["_value"], ranks, "_weight")
    medians = found.groupBy(*keys).agg(F.avg("_value").alias("_median"))
    # One row per key on both sides; a key without any value keeps a null median.
    without = per_key.where("_valued is null").withColumn("_median", F.lit(None).cast("double"))
    collapsed = join_null_safe(per_key, medians, keys).unionByName(without).drop("_valued")
    return collapsed.select(
        *keys, "n", F.col("_median").alias(f"median_{value}"), *[F.col(f"_first.{c}").alias(f"first_{c}") for c in first]
    )

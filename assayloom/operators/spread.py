"""Equi-joins that stay balanced when one key holds a large share of the left side.

A key is hot when it has more than a fixed number of left rows, whatever the size of the table. Hot keys are spread over
several sub-keys: left rows by a hash of a row column, the few right rows of the key by copying them to every sub-key. All
other keys have one sub-key. The table of hot keys is joined like any other, so their number has no limit, and null keys are
spread too. There is one path for every size, and no row is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.staging import stage

HOT_ROWS = 1_000_000
_SALT, _COPIES = "_salt", "_copies"


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str, null_safe: bool = True) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they meet those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"{prefix}{k}" for k in on})
    condition = F.lit(True)
    for k in on:
        mine, other = left[k], renamed[f"{prefix}{k}"]
        condition = condition & (mine.eqNullSafe(other) if null_safe else mine == other)
    return renamed, condition


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hot keys, null ones too, with the number of sub-keys each gets; empty when there is none."""
    return hot_keys_from_sizes(df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), on, "_rows", hot_rows)


def hot_keys_from_sizes(sizes: DataFrame, on: Sequence[str], rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    copies = F.ceil(F.col(rows) / F.lit(max(hot_rows, 1))).cast("int").alias(_COPIES)
    return stage(sizes.where(F.col(rows) > hot_rows).select(*on, copies), "hot-keys")


def _with_copies(df: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    marked, condition = same_keys(df, hot, on, "_hot_")
    return df.join(marked, condition, "left").drop(*[f"_hot_{k}" for k in on])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join ``right`` (few rows per key) to ``left``; ``how`` is inner, left, left_semi or left_anti.

    ``spread_by`` names left columns that differ between the rows of one key. ``hot`` comes from :func:`hot_keys`. With
    ``null_safe`` null keys meet each other.
    """
    on = list(on)
    copies = F.coalesce(F.col(_COPIES), F.lit(1))
    salt = F.pmod(F.xxhash64(*spread_by), copies.cast("long")).cast("int")
    salted_left = _with_copies(left, on, hot).withColumn(_SALT, salt).drop(_COPIES)
    every = F.explode(F.sequence(F.lit(0), copies - 1))
    salted_right = _with_copies(right, on, hot).withColumn("_right_salt", every).drop(_COPIES)
    renamed, condition = same_keys(salted_left, salted_right, on, "_right_", null_safe)
    joined = salted_left.join(renamed, condition & (salted_left[_SALT] == renamed["_right_salt"]), how)
    return joined.drop(_SALT, "_right_salt", *[f"_right_{k}" for k in on])

"""Keyed one-to-one joins in place of alignment by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.spread import HOT_ROWS, hot_keys, spread_join


def alignment_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on one side only, keys that repeat, and keys that match. All zero but the last is a clean 1:1 join."""
    sides = (
        left.select(key, F.lit(1).alias("_left"), F.lit(0).alias("_right"))
        .unionByName(right.select(key, F.lit(0).alias("_left"), F.lit(1).alias("_right")))
        .groupBy(key)
        .agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    )
    is_left, is_right = F.col("_left") > 0, F.col("_right") > 0
    return sides.agg(
        F.count_if(is_left & ~is_right).alias("left_only"),
        F.count_if(is_right & ~is_left).alias("right_only"),
        F.count_if((F.col("_left") > 1) | (F.col("_right") > 1)).alias("repeated"),
        F.count_if(is_left & is_right).alias("matched"),
    )


def aligned_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of two tables that hold the same keys; a key that repeats on the left is spread if it is hot."""
    spread_by = [c for c in left.columns if c != key] or [key]
    return spread_join(left, right, [key], spread_by, hot_keys(left, [key], hot_rows))


def aligned_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of both sides with a ``status``: matched, repeated (a key that one side has more than once), left only or
    right only. No row is lost, and repeated keys are not multiplied silently."""
    named = right.withColumnsRenamed({key: "_right_key"})
    sizes = [df.groupBy(F.col(k).alias(f"_{k}")).agg(F.count(F.lit(1)).alias(n)) for df, k, n in ((left, key, "_n"), (named, "_right_key", "_m"))]
    joined = left.join(named, F.col(key) == F.col("_right_key"), "full")
    joined = joined.join(sizes[0], F.col(key) == F.col(f"_{key}"), "left")
    joined = joined.join(sizes[1], F.col("_right_key") == F.col("__right_key"), "left")
    status = (
        F.when(F.col("_m").isNull(), "left only")
        .when(F.col("_n").isNull(), "right only")
        .when((F.col("_n") > 1) | (F.col("_m") > 1), "repeated")
        .otherwise("matched")
    )
    rest = [c for c in (*left.columns, *right.columns) if c != key]
    return joined.select(F.coalesce(F.col(key), F.col("_right_key")).alias(key), *rest, status.alias("status"))


def require_aligned(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless the two sides hold exactly the same keys, once each."""
    report = alignment_report(left, right, key).first()
    if report["left_only"] or report["right_only"] or report["repeated"]:
        raise ValueError(f"tables are not aligned on {key}: {report.asDict()}")


def keep_surviving(labels: DataFrame, survivors: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Labels whose key is among the survivors."""
    spread_by = [c for c in labels.columns if c != key] or [key]
    return spread_join(labels, survivors.select(key), [key], spread_by, hot_keys(labels, [key], hot_rows), "left_semi")

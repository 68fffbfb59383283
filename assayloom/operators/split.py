"""Exact group-aware train / valid / test split: no group spans two parts.

The rule is greedy over groups, largest first and, among equals, latest first: a group goes to train while train stays
within its share, else to valid while train and valid stay within theirs, else to test. All groups of one size meet the
same state, so the greedy walk has a closed form per size class and only the histogram of sizes has to be walked. It
has at most sqrt(2 * rows) entries. Which groups of a class go where is then an order statistic inside the class.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from assayloom.operators.ordered import rows_at_ranks, running
from assayloom.operators.spread import HOT_ROWS, hot_keys_from_sizes, spread_join
from assayloom.staging import stage

SPLITS = ("train", "valid", "test")
SHARES = (8, 1, 1)


def group_sizes(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``group, size, first_row``: rows per group and the group's earliest row.

    A single numeric order column keeps this a hash aggregate; several columns are compared as one struct, which sorts.
    """
    row = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min(row).alias("first_row"))


def rank_in_size_class(groups: DataFrame, group: str) -> DataFrame:
    """Add ``class_rank``: 1 for the latest group among those of equal size."""
    one = groups.withColumn("_one", F.lit(1).cast("long"))
    order = ["-first_row", f"-{group}"]
    return running(one, ["size"], order, {"class_rank": ("sum", "_one")}).drop("_one")


def fill_by_size(
    histogram: Iterable[tuple[int, int]], shares: Sequence[int] = SHARES, held: tuple[int, int, int] = (0, 0, 0)
) -> list[tuple[int, int, int, int]]:
    """``(size, groups, to_train, to_valid)`` per size class from ``(size, groups)`` pairs.

    ``held`` counts rows that are in train, valid and test already; they take their room first.
    """
    classes = sorted(histogram, reverse=True)
    rows = sum(size * groups for size, groups in classes) + sum(held)
    train_room = rows * shares[0] // sum(shares)
    both_room = rows * (shares[0] + shares[1]) // sum(shares)
    train, valid = held[:2]
    filled = []
    for size, groups in classes:
        to_train = min(groups, max(0, (train_room - train) // size))
        train += to_train * size
        to_valid = min(groups - to_train, max(0, (both_room - train - valid) // size))
        valid += to_valid * size
        filled.append((size, groups, to_train, to_valid))
    return filled


def assign_groups(
    groups: DataFrame,
    group: str,
    histogram: Sequence[tuple[int, int]],
    shares: Sequence[int] = SHARES,
    held: tuple[int, int, int] = (0, 0, 0),
) -> DataFrame:
    """Add ``split`` to a staged table of group sizes whose ``(size, groups)`` histogram is given; see :func:`fill_by_size`."""
    spark = groups.sparkSession
    filled = fill_by_size(histogram, shares, held)
    # Classes that are cut inside: look up the last group on the near side of each cut.
    cuts = [(size, [r for r in sorted({a, a + b}) if 0 < r < n]) for size, n, a, b in filled]
    cuts = [(size, ranks) for size, ranks in cuts if ranks]
    marks = {}
    if cuts:
        ranks = spark.createDataFrame(cuts, "size long, ranks array<long>")
        found = rows_at_ranks(
            groups.join(ranks.select("size"), "size", "left_semi"),
            ["size"],
            ["-first_row", f"-{group}"],
            ranks,
        )
        # At most two rows per cut class.
        marks = {(r["size"], r["rank"]): (r["first_row"], r[group]) for r in found.collect()}
    classes = [
        (size, a == n, a + b == n, marks.get((size, a)), marks.get((size, a + b))) for size, n, a, b in filled
    ]
    mark = StructType([groups.schema["first_row"], groups.schema[group]])
    schema = StructType(
        [
            StructField("size", LongType()),
            StructField("all_train", BooleanType()),
            StructField("none_test", BooleanType()),
            StructField("train_mark", mark),
            StructField("both_mark", mark),
        ]
    )
    classes = spark.createDataFrame(classes, schema)
    here = F.struct("first_row", group)
    split = (
        F.when(F.col("all_train") | (here >= F.col("train_mark")), SPLITS[0])
        .when(F.col("none_test") | (here >= F.col("both_mark")), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    # One row per size class: at most sqrt(2 * rows).
    return groups.join(classes, "size").select(group, "size", "first_row", split.alias("split"))


def group_split(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    shares: Sequence[int] = SHARES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``split`` to every row. ``order`` names the columns that make row order explicit and unique.

    No row is left out: rows without a group key form one group of their own.
    """
    groups = stage(group_sizes(df, group, order), "group-sizes")
    histogram = [(r["size"], r["count"]) for r in groups.groupBy("size").count().collect()]
    assigned = assign_groups(groups, group, histogram, shares).select(group, "split")
    hot = hot_keys_from_sizes(groups, [group], "size", hot_rows)
    return spread_join(df, assigned, [group], order, hot, null_safe=True)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def leaked_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups found in more than one split; empty for a correct split."""
    seen = df.groupBy(group).agg(F.min("split").alias("one_split"), F.max("split").alias("other_split"))
    return seen.where(F.col("one_split") != F.col("other_split"))


def bundle_splits(train: DataFrame, valid: DataFrame, test: DataFrame) -> DataFrame:
    """Three split tables as one table with a ``split`` column."""
    named = [df.withColumn("split", F.lit(name)) for name, df in zip(SPLITS, (train, valid, test))]
    return named[0].unionByName(named[1]).unionByName(named[2])

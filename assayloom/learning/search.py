"""Seeded random hyperparameter search with a trial ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Whole:
    """A whole number from ``low`` to ``high`` in steps."""

    name: str
    low: int
    high: int
    step: int = 1

    def draw(self, uniform: Column) -> Column:
        choices = (self.high - self.low) // self.step + 1
        return (F.lit(self.low) + F.lit(self.step) * F.floor(uniform * choices)).cast("int")


@dataclass(frozen=True)
class Real:
    """A real number in [low, high), evenly spread or evenly spread in its logarithm."""

    name: str
    low: float
    high: float
    log: bool = False

    def draw(self, uniform: Column) -> Column:
        if self.log:
            low, high = F.ln(F.lit(self.low)), F.ln(F.lit(self.high))
            return F.exp(low + uniform * (high - low))
        return F.lit(self.low) + uniform * F.lit(self.high - self.low)


# Search spaces of the fingerprint regressor and of the models on vectors.
FINGERPRINT_SPACE = (
    Whole("n_estimators", 100, 1000, 100),
    Whole("max_depth", 3, 10),
    Real("learning_rate", 0.01, 0.3, log=True),
    Real("subsample", 0.6, 1.0),
    Real("colsample_bytree", 0.6, 1.0),
    Whole("min_child_weight", 1, 7),
)
VECTOR_SPACE = (
    Whole("n_estimators", 500, 2000, 100),
    Whole("max_depth", 4, 12),
    Real("learning_rate", 0.001, 0.1, log=True),
    Real("subsample", 0.5, 1.0),
    Real("colsample_bytree", 0.5, 1.0),
    Real("gamma", 0.0, 5.0),
    Whole("min_child_weight", 1, 10),
)


def uniform_draw(trial: Column, name: str, seed: int) -> Column:
    """A number in [0, 1) that depends on trial, parameter and seed only, not on partitions or row order.

    It is made of the first 52 bits of an MD5 digest, so other engines draw the same trials.
    """
    digest = F.md5(F.concat_ws("|", trial.cast("string"), F.lit(name), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") * F.lit(2.0**-52)


def draw_trials(spark: SparkSession, space: Sequence[Whole | Real], n: int, seed: int) -> DataFrame:
    """``trial, params`` for ``n`` trials; trial k is the same whatever ``n`` is."""
    trial = F.col("trial")
    params = F.struct(*[p.draw(uniform_draw(trial, p.name, seed)).alias(p.name) for p in space])
    return spark.range(n).select(F.col("id").alias("trial"), params.alias("params"))


def run_trials(
    trials: DataFrame, objective: Callable[[dict[str, Any]], float], parallelism: int = 2
) -> DataFrame:
    """The ledger ``trial, params, score``. Each objective runs distributed fits; several go on at once.

    The trials are a handful of parameter records; the data stays on the executors.
    """
    drawn = trials.orderBy("trial").collect()
    run = inheritable_thread_target(trials.sparkSession)(lambda row: float(objective(row["params"].asDict())))
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(run, drawn))
    scored = [(row["trial"], row["params"], score) for row, score in zip(drawn, scores)]
    schema = f"trial long, params {trials.schema['params'].dataType.simpleString()}, score double"
    return trials.sparkSession.createDataFrame(scored, schema)

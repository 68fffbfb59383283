"""Search by successive halving: many trials grow few trees, the better ones grow on from where they stand.

A trial's state after a rung is written: its rows with their margins, and the trees of the rung. The next rung reads the margins and
grows further trees on what they leave, so no tree is grown twice and a losing trial costs its first rungs only. The ledger has one
record per trial and rung, written when both are complete. A search that is started again at the same path reads the ledger and goes
on with what is missing, so the loss of the driver costs the rungs under way.

Trees follow the rules of the plain boosted trees: squared or logistic loss, a first tree of full weight and later ones of
the learning rate, so a trial of all rounds without row sampling equals the plain fit. Row samples depend on the row's key, the round
and the seed only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.learning.search import Real, Whole, draw_trials
from assayloom.sources.files import DEFAULT_PARAMETERS

FIRST_ROUNDS, KEPT_ONE_IN = 8, 2
_LEDGER = "trial long, rung int, rounds int, score double, params string"


@dataclass(frozen=True)
class Loss:
    """A target column, what a tree grown at given margins learns, and the loss that ranks trials, smaller being better."""

    target: str
    logistic: bool

    def signed(self) -> Column:
        return 2 * F.col(self.target) - 1 if self.logistic else F.col(self.target).cast("double")

    def left(self, margin: Column, first: bool) -> Column:
        """What is left to learn: the target itself at first, then the loss's negative gradient."""
        if first or not self.logistic:
            return (1 if first else 2) * (self.signed() - margin)
        return 4 * self.signed() / (1 + F.exp(2 * self.signed() * margin))

    def score(self, margin: Column) -> Column:
        if self.logistic:
            # log(1 + exp(-z)) without overflow.
            z = 2 * self.signed() * margin
            return F.avg(2 * (F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))
        return F.sqrt(F.avg(F.pow(self.signed() - margin, 2)))


SQUARED, LOGISTIC = Loss("y", False), Loss("label", True)


def _sampled(rows: DataFrame, key: str, share: float, number: int, seed: int) -> DataFrame:
    if share >= 1:
        return rows
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(number), F.lit(seed)), 11) * F.lit(2.0**-53)
    return rows.where(uniform < share)


def grow(
    rows: DataFrame, loss: Loss, params: dict[str, Any], key: str, start: int, stop: int, seed: int
) -> tuple[DataFrame, list[Any]]:
    """Trees ``start`` to ``stop`` on the training rows, and all rows with their margins after them."""
    given = {**DEFAULT_PARAMETERS, **params}
    share = given.get("colsample_bytree")
    trees = []
    for number in range(start, stop):
        wanted = _sampled(rows.where("split = 'train'"), key, float(given.get("subsample", 1.0)), number, seed)
        tree = RandomForestRegressor(
            numTrees=1,
            bootstrap=False,
            featuresCol="vector",
            labelCol="_left",
            predictionCol="_step",
            maxDepth=int(given["max_depth"]),
            minInstancesPerNode=int(given.get("min_child_weight") or 1),
            minInfoGain=float(given.get("gamma") or 0.0),
            featureSubsetStrategy="all" if share is None or share >= 1 else str(float(share)),
            seed=seed + number,
        ).fit(wanted.withColumn("_left", loss.left(F.col("margin"), number == 0)))
        trees.append(tree)
        weight = 1.0 if number == 0 else float(given["learning_rate"])
        rows = tree.transform(rows).withColumn("margin", F.col("margin") + F.lit(weight) * F.col("_step")).drop("_step")
    return rows, trees


class Search:
    """A search at one path. ``rows`` have a unique ``key``, ``split``, ``vector`` and the loss's target."""

    def __init__(
        self,
        rows: DataFrame,
        loss: Loss,
        key: str,
        path: str,
        space: Sequence[Whole | Real],
        n_trials: int,
        seed: int = 42,
        first_rounds: int = FIRST_ROUNDS,
        kept_one_in: int = KEPT_ONE_IN,
        parallelism: int = 2,
    ) -> None:
        if kept_one_in < 2 or first_rounds < 1 or n_trials < 1:
            raise ValueError("one trial and one round at least, and one in two or more kept")
        self.spark: SparkSession = rows.sparkSession
        self.rows, self.loss, self.key, self.path = rows.select(key, "split", "vector", loss.target), loss, key, path
        self.space, self.n_trials, self.seed = space, n_trials, seed
        self.first_rounds, self.kept_one_in, self.parallelism = first_rounds, kept_one_in, parallelism

    def ledger(self) -> DataFrame:
        """``trial, rung, rounds, score, params`` of what is complete."""
        try:
            return self.spark.read.schema(_LEDGER).json(f"{self.path}/ledger/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LEDGER)

    def _state(self, trial: int, rung: int) -> str:
        return f"{self.path}/state/trial={trial}/rung={rung}"

    def rounds(self, params: dict[str, Any], rung: int) -> int:
        """Trees of a trial after a rung; no more than its own number."""
        return min(self.first_rounds * self.kept_one_in**rung, int(params.get("n_estimators", DEFAULT_PARAMETERS["n_estimators"])))

    def _run(self, trial: int, rung: int, params: dict[str, Any]) -> dict[str, Any]:
        if rung:
            rows, start = self.spark.read.parquet(f"{self._state(trial, rung - 1)}/rows"), self.rounds(params, rung - 1)
        else:
            rows, start = self.rows.withColumn("margin", F.lit(0.0)), 0
        stop, state = self.rounds(params, rung), self._state(trial, rung)
        grown, trees = grow(rows, self.loss, params, self.key, start, stop, self.seed)
        grown.write.mode("overwrite").parquet(f"{state}/rows")
        PipelineModel(trees).write().overwrite().save(f"{state}/trees")
        written = self.spark.read.parquet(f"{state}/rows")
        score = written.where("split = 'valid'").agg(self.loss.score(F.col("margin")).alias("score")).first()["score"]
        record = {"trial": trial, "rung": rung, "rounds": stop, "score": score, "params": json.dumps(params)}
        one = self.spark.createDataFrame([tuple(record.values())], _LEDGER)
        one.coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/trial={trial}-rung={rung}")
        return record

    def run(self, most_rungs: int | None = None) -> DataFrame:
        """The ledger with ``kept``: whether the trial went on to a further rung or, in the last one, won.

        A rung keeps the better one in ``kept_one_in`` of its trials, at least one; the lower trial number wins ties, and a trial
        without a finite score is the worst. The last rung is the one with a single trial, or the last of ``most_rungs``.
        """
        drawn = draw_trials(self.spark, self.space, self.n_trials, self.seed).collect()
        params = {r["trial"]: r["params"].asDict() for r in drawn}
        done = {(r["trial"], r["rung"]): r.asDict() for r in self.ledger().collect()}
        left, rung, out = sorted(params), 0, []
        work = inheritable_thread_target(self.spark)(lambda at: self._run(at[0], at[1], params[at[0]]))
        while True:
            todo = [(trial, rung) for trial in left if (trial, rung) not in done]
            with ThreadPoolExecutor(self.parallelism) as pool:
                done |= {(r["trial"], r["rung"]): r for r in pool.map(work, todo)}
            found = [done[trial, rung] for trial in left]
            last = len(left) == 1 or rung + 1 == most_rungs
            better = sorted(found, key=lambda r: (_worst_last(r["score"]), r["trial"]))
            left = sorted(r["trial"] for r in better[: 1 if last else max(1, len(left) // self.kept_one_in)])
            out += [(r["trial"], r["rung"], r["rounds"], r["score"], r["params"], r["trial"] in left) for r in found]
            if last:
                return self.spark.createDataFrame(out, f"{_LEDGER}, kept boolean")
            rung += 1

    def winner(self) -> tuple[int, dict[str, Any], int]:
        """Trial, parameters and rungs of a search that has been run: the best record of the highest rung."""
        found = self.ledger().collect()
        last = max(r["rung"] for r in found)
        best = min((r for r in found if r["rung"] == last), key=lambda r: (_worst_last(r["score"]), r["trial"]))
        return best["trial"], json.loads(best["params"]), last + 1

    def with_margins(self, rows: DataFrame, trial: int, rungs: int) -> DataFrame:
        """``margin`` from the written trees of a trial: the prediction, or half the log odds of label 1."""
        rate = json.loads(self.ledger().where(F.col("trial") == trial).first()["params"])
        rate = float({**DEFAULT_PARAMETERS, **rate}["learning_rate"])
        rows, number = rows.withColumn("margin", F.lit(0.0)), 0
        for rung in range(rungs):
            for tree in PipelineModel.load(f"{self._state(trial, rung)}/trees").stages:
                step = F.lit(1.0 if number == 0 else rate) * F.col("_step")
                rows = tree.transform(rows).withColumn("margin", F.col("margin") + step).drop("_step")
                number += 1
        return rows


def _worst_last(score: float | None) -> float:
    return score if score is not None and math.isfinite(score) else math.inf

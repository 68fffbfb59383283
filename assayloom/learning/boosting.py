"""Boosted-tree regression and classification with validation-driven stopping and a held-out evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JError
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.vectors import as_feature_vector
from assayloom.operators.classification import roc_auc
from assayloom.sources.files import DEFAULT_PARAMETERS
from assayloom.staging import shared_folder, stage

SEED = 42
#: Rounds whose area under the curve is read in one pass over the validation rows.
ROUNDS_PER_PASS = 50


@dataclass(frozen=True)
class Fit:
    """A fitted model, the number of rounds it kept, and the validation loss of every round that was looked at.

    Where the stopping metric is the area under the curve, the loss is one minus that area.
    """

    model: Any
    rounds: int
    losses: list[float]


def with_vector(df: DataFrame, features: str = "features", vector: str = "vector") -> DataFrame:
    return df.withColumn(vector, as_feature_vector(F.col(features)))


def in_fixed_order(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The rows placed and ordered by their unique key, so that seeded row sampling inside a fit repeats exactly.

    Sampling follows partitions and row order, which otherwise depend on files and shuffle arrival. One shuffle per fit is
    little beside the passes of the fit. The result depends on ``partitions``, by default the shuffle partition setting.
    """
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, key).sortWithinPartitions(key)


def _tree_settings(params: Mapping[str, Any], rounds: int | None, seed: int) -> dict[str, Any]:
    given = {**DEFAULT_PARAMETERS, **params}
    settings = {
        "maxIter": rounds or int(given["n_estimators"]),
        "maxDepth": int(given["max_depth"]),
        "stepSize": float(given["learning_rate"]),
        "subsamplingRate": float(given.get("subsample", 1.0)),
        "minInfoGain": float(given.get("gamma") or 0.0),
        "minInstancesPerNode": int(given.get("min_child_weight") or 1),
        "seed": seed,
    }
    share = given.get("colsample_bytree")
    if share is not None and share < 1.0:
        settings["featureSubsetStrategy"] = str(float(share))
    return settings


def regressor(params: Mapping[str, Any], rounds: int | None = None, seed: int = SEED) -> GBTRegressor:
    """Squared-loss trees from the parameter names of the search space.

    ``colsample_bytree`` acts per node, ``min_child_weight`` counts rows, and ``gamma`` is an information gain.
    """
    return GBTRegressor(
        featuresCol="vector", labelCol="y", predictionCol="y_pred", **_tree_settings(params, rounds, seed)
    )


def classifier(params: Mapping[str, Any], rounds: int | None = None, seed: int = SEED) -> GBTClassifier:
    """Logistic-loss trees for a 0/1 label; see :func:`regressor` for the parameters."""
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", predictionCol="predicted", **_tree_settings(params, rounds, seed)
    )
    return trees.setProbabilityCol("probability").setRawPredictionCol("raw")


def best_round(losses: list[float], patience: int) -> int:
    """The 1-based round with the lowest loss before ``patience`` rounds pass without a new low."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_rounds(model: Any, rounds: int) -> Any:
    """The model of the first ``rounds``: the same trees and weights, without a second fit.

    Raises AttributeError or TypeError where the session has no classic models to take apart (see :func:`fit_with_stopping`).
    """
    whole, spark_jvm = model._java_obj, SparkSession.active()._jvm
    parts = [model.uid, whole.trees()[:rounds], whole.treeWeights()[:rounds], model.numFeatures]
    if isinstance(model, GBTRegressionModel):
        made = spark_jvm.org.apache.spark.ml.regression.GBTRegressionModel(*parts)
    else:
        made = spark_jvm.org.apache.spark.ml.classification.GBTClassificationModel(*parts, model.numClasses)
    shorter = model.copy()
    shorter._java_obj = made
    shorter._transfer_params_to_java()
    return shorter


def areas_by_round(model: Any, rows: DataFrame, per_pass: int = ROUNDS_PER_PASS) -> Iterator[list[float]]:
    """The exact area under the curve after each round, a list per pass; 0.5 where the rows have one class.

    A pass adds the trees of its rounds to the margins that the pass before has written.
    """
    trees, weights = model.trees, list(model.treeWeights)
    held = rows.select("vector", "label", F.array(F.lit(0.0)).alias("margins"))
    for start in range(0, len(trees), per_pass):
        chosen = range(start, min(start + per_pass, len(trees)))
        for i in chosen:
            tree = trees[i].copy()
            held = tree.setFeaturesCol("vector").setPredictionCol(f"_tree{i}").transform(held)
        steps = F.array(*[F.col(f"_tree{i}") * F.lit(weights[i]) for i in chosen])
        margins = F.transform(
            F.sequence(F.lit(1), F.lit(len(chosen))),
            lambda n: F.aggregate(F.slice(steps, F.lit(1), n), F.element_at("margins", -1), lambda a, x: a + x),
        )
        held = stage(held.select("vector", "label", margins.alias("margins")), "margins")
        each = held.select("label", F.posexplode("margins").alias("round", "margin"))
        found = {r["round"]: r["auc"] for r in roc_auc(each, "label", "margin", by=["round"]).collect()}
        yield [0.5 if found.get(n) is None else found[n] for n in range(len(chosen))]


def fit_with_stopping(
    make, params: Mapping[str, Any], train: DataFrame, valid: DataFrame, patience: int, metric: str = "loss"
) -> Fit:
    """Fit all rounds, read the validation loss of each, and keep the rounds up to the best one.

    ``make`` is :func:`regressor` or :func:`classifier`. The trees are grown once; the stopped model is their first part.
    ``metric`` is ``loss`` (squared or logistic; one pass over the validation rows) or, for a classifier, ``auc`` (a pass per
    ``ROUNDS_PER_PASS`` rounds, until the patience is over).
    """
    if metric not in ("loss", "auc"):
        raise ValueError(f"no such stopping metric: {metric}")
    shared_folder(train.sparkSession)
    model = make(params).fit(train)
    losses: list[float] = []
    if metric == "auc":
        for areas in areas_by_round(model, valid):
            losses += [1 - area for area in areas]
            if len(losses) - best_round(losses, patience) >= patience:
                break
    else:
        each = model.evaluateEachIteration
        losses += each(valid, "squared") if isinstance(model, GBTRegressionModel) else each(valid)
    rounds = best_round(losses, patience)
    if rounds < model.getNumTrees:
        try:
            model = first_rounds(model, rounds)
        except (AttributeError, TypeError, Py4JError):
            # Another Spark version or a remote session: the same seed grows the same first trees.
            model = make(params, rounds=rounds).fit(train)
    return Fit(model, rounds, losses)


def scoring_model(regression: Any, classification: Any) -> PipelineModel:
    """Both fitted models as one saveable model over the ``vector`` column; each vector is read once for the two."""
    return PipelineModel([regression, classification])

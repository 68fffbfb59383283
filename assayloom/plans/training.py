"""Training jobs over one table of split rows: embed, tune, train and evaluate.

Input rows have an identifier, a ``split`` column, a ``vector`` and a target: ``y`` for the regressor, ``label`` (0/1) for
the classifier. Every job writes below one folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.vectors import positive_probability
from assayloom.learning import boosting, halving, search
from assayloom.learning.encoding import Encoder, encode_texts
from assayloom.operators.classification import classification_metrics, roc_auc
from assayloom.operators.regression import regression_metrics, with_residuals
from assayloom.operators.stopping import best_trial
from assayloom.sinks.files import append_metrics, save_model, write_by_split, write_csv, write_parameters
from assayloom.staging import stage

PATIENCE = 50
TRIALS = 100


@dataclass(frozen=True)
class Task:
    """What differs between the two models: estimator, target, tuning score and its direction, stopping metric."""

    make: Callable[..., Any]
    predictions: Callable[[DataFrame, str], DataFrame]
    metrics: Callable[[DataFrame], DataFrame]
    score: str
    larger_is_better: bool
    stopping: str


def _regression_predictions(scored: DataFrame, key: str) -> DataFrame:
    found = scored.select(F.col(key).alias("id"), F.col("y").alias("y_true"), "y_pred")
    return with_residuals(found).drop("absolute_error")


def _class_predictions(scored: DataFrame, key: str) -> DataFrame:
    return scored.select(
        F.col(key).alias("id"),
        F.col("label").alias("true"),
        F.col("predicted").cast("int"),
        positive_probability(F.col("probability")).alias("predicted_probability"),
    )


def _class_metrics(predictions: DataFrame) -> DataFrame:
    """Rates and exact area as one record."""
    area = roc_auc(predictions, "true", "predicted_probability").first()["auc"]
    rates = classification_metrics(predictions).withColumnRenamed("f1", "f1-score")
    return rates.withColumn("ROC-AUC", F.lit(area).cast("double"))


REGRESSION = Task(boosting.regressor, _regression_predictions, regression_metrics, "rmse", False, "loss")
CLASSIFICATION = Task(boosting.classifier, _class_predictions, _class_metrics, "ROC-AUC", True, "auc")


def embed(df: DataFrame, text: str, path: str, make_encoder: Callable[[], Encoder] | None = None) -> None:
    """Encode the texts of a split table and write key, vector and targets in one folder per split."""
    write_by_split(encode_texts(df, text, make_encoder), path)


def _part(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split)


def tune(
    rows: DataFrame,
    task: Task,
    key: str,
    space: Sequence[search.Whole | search.Real] = search.VECTOR_SPACE,
    n_trials: int = TRIALS,
    path: str | None = None,
    seed: int = boosting.SEED,
    patience: int = PATIENCE,
    parallelism: int = 2,
    partitions: int | None = None,
) -> DataFrame:
    """Trial ledger of a seeded search scored on the validation rows; the winner is written to ``path``.

    The rows are placed and ordered once and kept for all trials. Models on fingerprints take ``FINGERPRINT_SPACE``.
    """
    train = boosting.in_fixed_order(_part(rows, "train"), key, partitions).persist()
    valid = _part(rows, "valid").persist()

    def objective(params: dict[str, Any]) -> float:
        fit = boosting.fit_with_stopping(task.make, params, train, valid, patience, task.stopping)
        predictions = task.predictions(fit.model.transform(valid), key)
        return task.metrics(predictions).first()[task.score]

    drawn = search.draw_trials(rows.sparkSession, space, n_trials, seed)
    try:
        ledger = search.run_trials(drawn, objective, parallelism)
    finally:
        train.unpersist()
        valid.unpersist()
    if path is not None:
        winner = best_trial(ledger, task.larger_is_better).first()["params"].asDict()
        write_parameters(rows.sparkSession, path, winner)
    return ledger


def tune_by_halving(
    rows: DataFrame,
    task: Task,
    key: str,
    path: str,
    space: Sequence[search.Whole | search.Real] = search.VECTOR_SPACE,
    n_trials: int = TRIALS,
    seed: int = boosting.SEED,
    first_rounds: int = halving.FIRST_ROUNDS,
    parallelism: int = 2,
) -> DataFrame:
    """Like :func:`tune`, by successive halving on the validation loss: the ledger with who went on at each rung.

    State, trees and ledger stand below ``path``, the winner's parameters in its folder ``best``. Called again with the same path, a
    search that broke off goes on with the trials and rungs that are missing.
    """
    loss = halving.LOGISTIC if task is CLASSIFICATION else halving.SQUARED
    found = halving.Search(rows, loss, key, path, space, n_trials, seed, first_rounds, parallelism=parallelism)
    ledger = found.run()
    _, params, _ = found.winner()
    write_parameters(rows.sparkSession, f"{path}/best", params)
    return ledger


def train_and_evaluate(
    rows: DataFrame,
    task: Task,
    params: Mapping[str, Any],
    key: str,
    path: str | None = None,
    run: str = "run",
    patience: int = PATIENCE,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit with stopping, predict the held-out rows and evaluate: ``(predictions, one metrics record)``.

    With a ``path`` the model, the predictions (CSV) and the metrics record (runs table) are written below it.
    """
    train = boosting.in_fixed_order(_part(rows, "train"), key, partitions)
    fit = boosting.fit_with_stopping(task.make, params, train, _part(rows, "valid"), patience, task.stopping)
    predictions = stage(task.predictions(fit.model.transform(_part(rows, "test")), key), "predictions")
    best = F.struct(*[F.lit(v).alias(k) for k, v in params.items()])
    record = task.metrics(predictions).withColumns({"run": F.lit(run), "rounds": F.lit(fit.rounds), "best_params": best})
    if path is not None:
        save_model(PipelineModel([fit.model]), f"{path}/model")
        write_csv(predictions, f"{path}/predictions")
        append_metrics(record, f"{path}/metrics")
    return predictions, record

"""Binary classification evaluation: confusion matrix, rates, exact ROC curve and area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.numeric import finite
from assayloom.operators.ordered import previous_values, running
from assayloom.staging import stage


def _cell(y_true: str, y_pred: str, t: int, p: int) -> Column:
    return F.count_if((F.col(y_true) == t) & (F.col(y_pred) == p))


def _unlabelled(y_true: str, y_pred: str) -> Column:
    labelled = F.col(y_true).isin(0, 1) & F.col(y_pred).isin(0, 1)
    return F.count_if(~F.coalesce(labelled, F.lit(False))).alias("unlabelled")


def confusion_matrix(df: DataFrame, y_true: str = "true", y_pred: str = "predicted") -> DataFrame:
    """``true, predicted, count`` for all four cells, empty ones included, and ``unlabelled`` in every row.

    Rows with a null or any label but 0 and 1 on either side are in no cell; ``unlabelled`` is their number.
    """
    cells = [
        F.struct(F.lit(t).alias("true"), F.lit(p).alias("predicted"), _cell(y_true, y_pred, t, p).alias("count"))
        for t in (0, 1)
        for p in (0, 1)
    ]
    counted = df.agg(F.array(*cells).alias("_cells"), _unlabelled(y_true, y_pred))
    return counted.select(F.explode("_cells").alias("_cell"), "unlabelled").select("_cell.*", "unlabelled")


def classification_metrics(df: DataFrame, y_true: str = "true", y_pred: str = "predicted") -> DataFrame:
    """One row in one pass: accuracy, precision, recall, F1 of the labelled rows, and ``unlabelled``. A rate without cases is 0."""
    counted = df.agg(
        _cell(y_true, y_pred, 1, 1).alias("tp"),
        _cell(y_true, y_pred, 0, 1).alias("fp"),
        _cell(y_true, y_pred, 1, 0).alias("fn"),
        _cell(y_true, y_pred, 0, 0).alias("tn"),
        _unlabelled(y_true, y_pred),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return counted.select(
        rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "unlabelled",
    )


def positives_by_score(df: DataFrame, y_true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (of a group), staged; everything ordered works on this smaller table.

    Rows without a finite score, or with a label other than 0 and 1, have no place on a curve and are left out.
    """
    rows = df.where(F.col(y_true).isin(0, 1) & finite(F.col(score)).isNotNull())
    positive = F.col(y_true).cast("long")
    by_score = rows.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(positive).alias("positives"), F.sum(1 - positive).alias("negatives")
    )
    return stage(by_score, "by-score")


def cumulative_positives(df: DataFrame, y_true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``score, positives, negatives, tp, fp``: counts of rows scored at or above each distinct score."""
    outputs = {"tp": ("sum", "positives"), "fp": ("sum", "negatives")}
    return running(positives_by_score(df, y_true, score, by), by, ["-score"], outputs)


def roc_auc(df: DataFrame, y_true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row ``auc``, or one per group of ``by``.

    It is the exact chance that a positive outranks a negative, ties counting half; null with one class.
    """
    above = cumulative_positives(df, y_true, score, by)
    # At each score: positives strictly above beat this score's negatives, positives at it tie with them.
    won = F.col("negatives") * (F.col("tp") - F.col("positives") / 2)
    totals = above.groupBy(*by).agg(
        F.sum(won).alias("won"), F.sum("positives").alias("p"), F.sum("negatives").alias("n")
    )
    pairs = F.col("p").cast("double") * F.col("n")
    return totals.select(*by, F.try_divide(F.col("won"), pairs).alias("auc"))


def roc_curve(df: DataFrame, y_true: str, score: str) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score and at the (0, 0) start, whose threshold is infinite.

    Collinear points are kept. Rates are null when their class is absent.
    """
    by_score = positives_by_score(df, y_true, score)
    p, n = by_score.agg(F.sum("positives"), F.sum("negatives")).first()
    counted = running(by_score, [], ["-score"], {"tp": ("sum", "positives"), "fp": ("sum", "negatives")})
    points = counted.select(
        F.col("score").cast("double").alias("threshold"),
        F.try_divide(F.col("fp"), F.lit(n or 0)).alias("fpr"),
        F.try_divide(F.col("tp"), F.lit(p or 0)).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def area_under(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``area``: trapezoids under the points taken in ascending (x, y) order."""
    stepped = previous_values(stage(points.select(x, y), "points"), [x, y], {"_x": x, "_y": y})
    return stepped.agg(F.sum((F.col(x) - F.col("_x")) * (F.col(y) + F.col("_y")) / 2).alias("area"))

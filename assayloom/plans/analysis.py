"""Reports over written predictions: the tables behind residual plots, confusion matrix and ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators import classification, regression
from assayloom.sources.files import CLASS_PREDICTIONS_SCHEMA, REGRESSION_PREDICTIONS_SCHEMA, read_csv


def regression_report(predictions: DataFrame, worst: int = 5) -> dict[str, DataFrame]:
    """Metrics, worst rows with text lines, histogram, density, profile and bias of the residuals."""
    residuals = regression.with_residuals(predictions)
    bins = regression.histogram(residuals, "residual")
    width = bins.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 1.0
    return {
        "metrics": regression.regression_metrics(predictions),
        "worst": regression.report_lines(regression.worst_predictions(predictions, ["id"], worst)),
        "histogram": bins,
        "density": regression.density(residuals, "residual", width),
        "profile": regression.residual_profile(predictions),
        "bias": regression.residual_bias(predictions),
    }


def classification_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Rates, confusion matrix, ROC curve and its area."""
    curve = classification.roc_curve(predictions, "true", "predicted_probability")
    return {
        "metrics": classification.classification_metrics(predictions),
        "confusion": classification.confusion_matrix(predictions),
        "curve": curve,
        "area": classification.area_under(curve, "fpr", "tpr"),
    }


def analyse_regression_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return regression_report(read_csv(spark, path, REGRESSION_PREDICTIONS_SCHEMA))


def analyse_classification_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return classification_report(read_csv(spark, path, CLASS_PREDICTIONS_SCHEMA))

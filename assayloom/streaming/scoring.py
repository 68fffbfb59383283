"""Dual scoring: one feature vector through a regressor and a classifier into one nested response.

All steps are per row and stateless, so a batch table and a stream give the same answers.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.requests import request_error, required_string, response
from assayloom.functions.vectors import has_length, positive_probability
from assayloom.learning.boosting import with_vector
from assayloom.staging import fresh_path


def read_requests(df: DataFrame, body: str, field: str) -> DataFrame:
    """Add the checked ``field`` and an ``error`` that is null for good requests. No row is dropped or fails the job."""
    return df.withColumns({"error": request_error(F.col(body), field), field: required_string(F.col(body), field)})


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("error").isNull()).drop("error")


def rejected(requests: DataFrame, body: str) -> DataFrame:
    return requests.where(F.col("error").isNotNull()).select(body, F.lit("error").alias("status"), "error")


def check_vectors(df: DataFrame, dimensions: int) -> DataFrame:
    """Add ``status`` and ``error``: a vector that is missing or of another length is an error of its row only."""
    good = has_length(F.col("features"), dimensions)
    return df.withColumns(
        {
            "status": F.when(good, "success").otherwise("error"),
            "error": F.when(F.col("features").isNull(), "no vector").when(~good, "wrong vector length"),
        }
    )


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``y_pred, p_toxic, is_toxic`` from a two-model pipeline, and ``error``; every row stays.

    A row that has an ``error`` already, or a vector that is missing or of another length, is scored on a stand-in vector and
    its outputs are null.
    """
    dimensions = model.stages[0].numFeatures
    earlier = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    checked = check_vectors(df.withColumn("_earlier", earlier), dimensions)
    checked = checked.withColumn("error", F.coalesce("_earlier", "error")).drop("_earlier", "status")
    stand_in = F.array_repeat(F.lit(0.0).cast(df.schema["features"].dataType.elementType), dimensions)
    safe = checked.withColumn("_given", F.when(F.col("error").isNull(), F.col("features")).otherwise(stand_in))
    scored = model.transform(with_vector(safe, "_given"))
    good = F.col("error").isNull()
    return scored.withColumns(
        {
            "y_pred": F.when(good, F.col("y_pred")),
            "p_toxic": F.when(good, positive_probability(F.col("probability"))),
            "is_toxic": F.when(good, F.col("predicted") == 1.0),
        }
    ).drop("vector", "raw", "probability", "predicted", "_given")


def respond(scored: DataFrame, text: str) -> DataFrame:
    """Add the nested ``response``."""
    answer = response(F.col(text), F.col("is_toxic"), F.col("p_toxic"), F.col("y_pred"), F.col("error"))
    return scored.withColumn("response", answer)


def run_stream(stream: DataFrame, label: str, checkpoint: str | None = None, output: str | None = None) -> DataFrame:
    """Process all files that are there, then stop, and return the written table.

    Give fixed ``checkpoint`` and ``output`` paths to pick up only new files the next time.
    """
    spark: SparkSession = stream.sparkSession
    output = output or fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)

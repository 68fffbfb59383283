"""Scoring of a stream into two sinks, responses and rejects, each row once in the end.

A micro-batch is written to folders that carry its number, in both sinks, and then marked as done. The engine gives a repeated batch the
same number and the same input, so a batch that is repeated after a failure, wherever it broke off, replaces its own folders.
Readers see the batches that are marked: both sinks show the same ones, and none shows a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.staging import stage

RESPONSES, REJECTS = "responses", "rejects"
_DONE = "done"


def write_batch(scored: DataFrame, number: int, path: str) -> None:
    """One scored batch, with its ``error`` column: good rows to the responses, the others to the rejects, then the mark."""
    held = stage(scored, "scored-batch")
    sinks = {RESPONSES: F.col("error").isNull(), REJECTS: F.col("error").isNotNull()}
    for name, chosen in sinks.items():
        held.where(chosen).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    counts = held.agg(F.lit(number).cast("long").alias("number"), *[F.count_if(c).alias(n) for n, c in sinks.items()])
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/{_DONE}/batch={number}")


def run_into_sinks(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Process all that is there and stop. ``work`` adds ``error`` and whatever a response holds to the rows of a batch.

    Call it again with the same paths to go on, after a failure or when there are new files.
    """
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: write_batch(work(batch), number, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def done_batches(spark: SparkSession, path: str) -> DataFrame:
    """``number, responses, rejects`` of the batches that are complete in both sinks."""
    schema = f"number long, {RESPONSES} long, {REJECTS} long"
    try:
        return spark.read.schema(schema).json(f"{path}/{_DONE}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_sink(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The rows of the complete batches of a sink, with their ``batch``. ``schema`` is needed before anything was written."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, batch long")
    try:
        rows = reader.parquet(f"{path}/{name}")
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    done = done_batches(spark, path).select(F.col("number").alias("batch"))
    return rows.withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")

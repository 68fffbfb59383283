"""Table scans: declared schemas, equality filters at the source, guarded paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingInput(FileNotFoundError):
    """An input path that does not exist."""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or :class:`MissingInput` with the path in the message."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"could not find {path}; run the job that writes it first") from error
        raise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan(spark, f"{folder}/{name}.parquet")


def filtered_scan(df: DataFrame, equals: Mapping[str, Any], columns: Sequence[str]) -> DataFrame:
    """Rows that meet every equality, with the wanted columns only. Both reach the Parquet reader."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.select(*columns)


def result_size(df: DataFrame) -> DataFrame:
    """One row with the number of records, counted without materialising them."""
    return df.agg(F.count(F.lit(1)).alias("records"))

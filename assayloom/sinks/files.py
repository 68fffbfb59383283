"""Table sinks. Writers of single records append to a runs table that is keyed by run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assayloom.functions.text import NULL_MARK, escaped
from assayloom.sources.files import PARAMETERS_SCHEMA


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """CSV with a header row and no row index, from which :func:`read_csv` reads back any text whole; a folder per ``by``.

    Quotes are doubled. Line breaks, the empty text and the sign itself are written with the escape sign, so a record is one
    line and files stay splittable; null has a mark of its own.
    """
    texts = {f.name: F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, StringType)}
    writer = df.withColumns({n: escaped(c) for n, c in texts.items()}).write.mode("overwrite")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(header=True, escape='"', nullValue=NULL_MARK, **kept).partitionBy(*by).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_split(df: DataFrame, path: str) -> None:
    """Parquet with one folder per split; readers of one split never open the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_metrics(records: DataFrame, path: str) -> None:
    """Add metric records (``run``, metrics, optional ``best_params``) to the runs table, one nested JSON object each."""
    records.write.mode("append").json(path)


def write_parameters(spark: SparkSession, path: str, params: Mapping[str, Any]) -> None:
    """The winning parameters as one JSON record."""
    names = [field.split()[0] for field in PARAMETERS_SCHEMA.split(", ")]
    row = tuple(params.get(n) for n in names)
    spark.createDataFrame([row], PARAMETERS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)

"""Text-format inputs with declared schemas: CSV, JSON records, JSON parameters, vectors per split."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.text import NULL_MARK, unescaped
from assayloom.sources.tables import scan

# Schemas of the exchanged files.
RAW_SCHEMA = "molecule_chembl_id STRING, canonical_smiles STRING, standard_value STRING, standard_units STRING"
SPLIT_SCHEMA = "id STRING, smiles STRING, pIC50 DOUBLE, split STRING"
REGRESSION_PREDICTIONS_SCHEMA = "id STRING, y_true DOUBLE, y_pred DOUBLE, residual DOUBLE"
CLASS_PREDICTIONS_SCHEMA = "id STRING, true INT, predicted INT, predicted_probability DOUBLE"
PARAMETERS_SCHEMA = (
    "n_estimators INT, max_depth INT, learning_rate DOUBLE, subsample DOUBLE, colsample_bytree DOUBLE, gamma DOUBLE, "
    "min_child_weight INT"
)
METRICS_SCHEMA = f"run STRING, rmse DOUBLE, r2 DOUBLE, best_params STRUCT<{PARAMETERS_SCHEMA}>"
CLASS_METRICS_SCHEMA = (
    "run STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, `f1-score` DOUBLE, `ROC-AUC` DOUBLE"
)

# Parameters of a regressor that was never tuned.
DEFAULT_PARAMETERS = {"n_estimators": 1000, "learning_rate": 0.05, "max_depth": 6}


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False, malformed: str = "PERMISSIVE") -> DataFrame:
    """CSV with a header row. The schema is declared, so no pass over the data is spent on guessing types.

    What :func:`write_csv` wrote comes back as it was. ``multi_line`` accepts line breaks inside quoted fields of other
    writers, but then Spark cannot split a file between tasks. Unquoted empty fields are null. ``malformed`` is Spark's mode
    for rows that do not fit the schema; FAILFAST refuses them.
    """
    reader = spark.read.schema(schema).options(header=True, mode=malformed, escape='"', nullValue=NULL_MARK)
    found = reader.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, multiLine=multi_line).csv(path)
    return found.withColumns({n: unescaped(F.col(f"`{n}`")) for n, kind in found.dtypes if kind == "string"})


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines records as a table; fields that a record lacks are null."""
    return spark.read.schema(schema).json(path)


def read_vectors(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Key, vector and target rows; a split prunes to its partition folder."""
    vectors = scan(spark, path)
    return vectors if split is None else vectors.where(F.col("split") == split)


def with_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Fill missing parameter fields."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def read_parameters(spark: SparkSession, path: str, defaults: Mapping[str, Any] = DEFAULT_PARAMETERS) -> dict[str, Any]:
    """One saved parameter record with defaults for what it lacks; the defaults alone when there is no file."""
    try:
        found = spark.read.schema(PARAMETERS_SCHEMA).json(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    saved = {k: v for k, v in found.asDict().items() if v is not None} if found else {}
    return {**defaults, **saved}

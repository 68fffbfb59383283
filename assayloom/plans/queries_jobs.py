"""Registered queries: whole jobs from source to written files, and reports over written predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.regression import with_residuals
from assayloom.plans import queries_evaluation as evaluation
from assayloom.plans.analysis import analyse_classification_file, analyse_regression_file
from assayloom.plans.curation import fetch, process_and_split
from assayloom.plans.queries_curation import RETURNED
from assayloom.plans.queries_split import split_sql
from assayloom.sinks.files import write_csv
from assayloom.sources.files import SPLIT_SCHEMA, read_csv
from assayloom.sources.tables import table
from assayloom.staging import fresh_path


def _line_id() -> Column:
    return F.concat_ws("-", *evaluation.LINE_KEY)


def fetched_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raw measurements of parts: fetched to CSV, curated, split by brand, written and read back.

    Some prices are no numbers, and some parts have no brand: those are groups of their own.
    """
    price = F.when(F.col("l_orderkey") % 97 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    source = table(spark, sf, "lineitem").select(
        _line_id().alias("molecule_chembl_id"),
        F.concat(F.lit(" Part  "), "l_partkey").alias("canonical_smiles"),
        price.alias("standard_value"),
        F.lit("nM").alias("standard_units"),
        *RETURNED,
    )
    parts = table(spark, sf, "part").where(F.col("p_partkey") % 5 != 0)
    brands = parts.select(F.concat(F.lit("part "), "p_partkey").alias("canonical_smiles"), "p_brand")
    raw, path = fresh_path(spark, "raw"), fresh_path(spark, "processed")
    fetch(source, RETURNED, raw)
    process_and_split(spark, raw, path, brands, "p_brand")
    return read_csv(spark, path, SPLIT_SCHEMA)


def _entries(report: str, df: DataFrame, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(report).alias("report"), item.cast("string").alias("item"), F.round(value.cast("double"), 6).alias("value"))


def _measures(report: str, df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(
        F.lit(report).alias("report"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.round(F.col(n).cast("double"), 6).alias("value")) for n in names])),
    )


def price_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report over price predictions that were written as CSV: metrics, bias, worst rows, histogram and profile."""
    predictions = with_residuals(evaluation.price_predictions(spark, sf))
    path = fresh_path(spark, "price-predictions")
    write_csv(predictions.select(_line_id().alias("id"), "y_true", "y_pred", "residual"), path)
    found = analyse_regression_file(spark, path)
    parts = [
        _measures("metrics", found["metrics"], ["n", "skipped", "rmse", "r2", "pearson_r2"]),
        _measures("bias", found["bias"], ["residual_slope", "mean_residual"]),
        _entries("worst", found["worst"], F.col("id"), F.col("absolute_error")),
        _entries("histogram", found["histogram"], F.col("bin"), F.col("count")),
        _entries("profile", found["profile"], F.col("bucket"), F.col("mean_residual")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def urgency_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report over urgency scores that were written as CSV: rates, cells and the area under the written curve."""
    orders = evaluation.urgency(spark, sf)
    path = fresh_path(spark, "class-predictions")
    named = orders.select(F.col("o_orderkey").alias("id"), "true", "predicted", F.col("score").alias("predicted_probability"))
    write_csv(named, path)
    found = analyse_classification_file(spark, path)
    rates = _measures("metrics", found["metrics"], ["accuracy", "precision", "recall", "f1", "unlabelled"])
    cells = _entries("confusion", found["confusion"], F.concat_ws(":", "true", "predicted"), F.col("count"))
    return rates.unionByName(cells).unionByName(_measures("area", found["area"], ["area"]))


QUERIES = {"fetched_splits": fetched_splits, "price_report": price_report, "urgency_report": urgency_report}

_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

_CURATED = f"""(
  SELECT smiles, id, pIC50, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE smiles END AS grp FROM (
    SELECT l_partkey, 'part ' || l_partkey AS smiles, min({_KEY}) AS id,
           round(9 - log10(median(l_extendedprice) + 1e-10), 6) AS pIC50
    FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey % 97 <> 0 GROUP BY l_partkey)
  JOIN part ON p_partkey = l_partkey)"""


def _listed(report: str, sql: str, item: str, value: str) -> str:
    return f"SELECT '{report}' AS report, ({item})::VARCHAR AS item, round(({value})::DOUBLE, 6) AS value FROM ({sql})"


def _measured(report: str, sql: str, names: list[str]) -> str:
    return " UNION ALL ".join(_listed(report, sql, f"'{n}'", n) for n in names)


_SQL = evaluation.ORACLE

ORACLE = {
    "fetched_splits": split_sql(
        _CURATED, "grp", "smiles", f"SELECT id, smiles, pIC50, split FROM {_CURATED} JOIN assigned USING (grp)"
    ),
    "price_report": " UNION ALL ".join(
        [
            _measured("metrics", _SQL["price_metrics"], ["n", "skipped", "rmse", "r2", "pearson_r2"]),
            _measured("bias", _SQL["residual_bias"], ["residual_slope", "mean_residual"]),
            _listed("worst", _SQL["worst_predictions"], _KEY, "absolute_error"),
            _listed("histogram", _SQL["residual_histogram"], "bin", "count"),
            _listed("profile", _SQL["residual_profile"], "bucket", "mean_residual"),
        ]
    ),
    "urgency_report": " UNION ALL ".join(
        [
            _measured("metrics", _SQL["classification_metrics"], ["accuracy", "precision", "recall", "f1", "unlabelled"]),
            _listed("confusion", _SQL["confusion_matrix"], "concat_ws(':', \"true\", predicted)", "count"),
            _measured("area", _SQL["area_under_curve"], ["area"]),
        ]
    ),
}

"""Registered queries: scans, files, coercion, canonical keys, collapse, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.numeric import negative_log_molar, threshold_label, to_number
from assayloom.functions.text import canonical_key
from assayloom.operators.collapse import collapse_duplicates
from assayloom.operators.regression import regression_metrics
from assayloom.operators.stopping import best_trial
from assayloom.plans.curation import clean_measurements, curate, keep_complete, keyed_by_digest, with_label
from assayloom.plans.queries_evaluation import price_predictions
from assayloom.sinks.files import append_metrics, write_csv, write_parameters, write_records
from assayloom.sources.files import METRICS_SCHEMA, read_csv, read_parameters, read_records, with_defaults
from assayloom.sources.tables import MissingInput, filtered_scan, result_size, scan, table
from assayloom.staging import fresh_path

RETURNED = {"l_returnflag": "R", "l_linestatus": "F"}
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def filtered_scan_query(spark: SparkSession, sf: str) -> DataFrame:
    return filtered_scan(table(spark, sf, "lineitem"), RETURNED, ["l_orderkey", "l_partkey", "l_extendedprice"])


def result_size_query(spark: SparkSession, sf: str) -> DataFrame:
    return result_size(filtered_scan(table(spark, sf, "lineitem"), RETURNED, ["l_orderkey"]))


def guarded_scan_query(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of an input that is there, and zero for one that is not: the guard reports instead of failing."""
    orders = scan(spark, f"{sf}/orders.parquet")
    try:
        absent = scan(spark, f"{sf}/not_written_yet.parquet")
    except MissingInput:
        absent = orders.limit(0)
    return result_size(orders).withColumn("input", F.lit("orders")).unionByName(
        result_size(absent).withColumn("input", F.lit("not_written_yet"))
    )


def text_values(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as text, with a word where a number should be for error events."""
    value = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", "user_id", value.alias("value_text"))


def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    return text_values(spark, sf).select("event_id", to_number(F.col("value_text")).alias("number"))


def numeric_rows_only(spark: SparkSession, sf: str) -> DataFrame:
    return keep_complete(coerced_values(spark, sf), ["number"]).withColumnRenamed("number", "standard_value")


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "n_chars", "text")


def canonical_texts(spark: SparkSession, sf: str) -> DataFrame:
    key = canonical_key(F.col("text"))
    return document_texts(spark, sf).select("doc_id", F.md5(key).alias("key_digest"), F.length(key).alias("key_chars"))


def collapsed_documents(spark: SparkSession, sf: str) -> DataFrame:
    keyed = keyed_by_digest(document_texts(spark, sf), "text", ["doc_id", "n_chars"])
    return collapse_duplicates(keyed, ["key_digest"], "n_chars", ["doc_id"], ["doc_id"])


def curated_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, coerce, collapse by part to the median price, transform to log scale and label."""
    raw = filtered_scan(table(spark, sf, "lineitem"), RETURNED, [*LINE_KEY, "l_extendedprice"])
    as_text = raw.withColumn("l_extendedprice", F.col("l_extendedprice").cast("string"))
    cleaned = clean_measurements(as_text, "l_partkey", "l_extendedprice")
    curated = with_label(curate(cleaned, ["l_partkey"], "l_extendedprice", ["l_orderkey"], LINE_KEY), threshold=4.6)
    return curated.withColumn("median_l_extendedprice", F.round("median_l_extendedprice", 6))


def label_balance(spark: SparkSession, sf: str) -> DataFrame:
    return curated_prices(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("keys"), F.round(F.avg("y"), 6).alias("mean_y")
    )


def log_targets(spark: SparkSession, sf: str) -> DataFrame:
    y = negative_log_molar(F.col("c_acctbal") * 10)
    return table(spark, sf, "customer").select("c_custkey", y.alias("y"), threshold_label(y).alias("label"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Part rows written as CSV with a header and read back with a declared schema."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    path = fresh_path(spark, "csv")
    write_csv(parts, path)
    return read_csv(spark, path, "p_partkey LONG, p_name STRING, p_type STRING, p_retailprice DOUBLE")


def csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts with blanks around, quotes, line breaks, the empty text and nulls, written as CSV and read back."""
    kind, text = F.col("doc_id") % 7, F.col("text")
    texts = (
        F.when(kind == 0, F.concat(F.lit("  "), text, F.lit(" \t")))
        .when(kind == 1, F.concat(F.lit('"'), text, F.lit('",""')))
        .when(kind == 2, F.concat(F.lit("\r\n"), text, F.lit("\\\n")))
        .when(kind == 3, F.lit(""))
        .when(kind != 4, text)
    )
    path = fresh_path(spark, "csv")
    write_csv(table(spark, sf, "documents").select("doc_id", texts.alias("text"), "lang"), path)
    return read_csv(spark, path, "doc_id LONG, text STRING, lang STRING", malformed="FAILFAST")


def records_to_table(spark: SparkSession, sf: str) -> DataFrame:
    """Event records as JSON lines, read back as a typed table with one field the records do not have."""
    path = fresh_path(spark, "records")
    write_records(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
    read = read_records(spark, path, "event_id LONG, event_type STRING, value DOUBLE, unit STRING")
    return read.withColumn("has_unit", F.col("unit").isNotNull().cast("int")).drop("unit")


def parameters_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """JSON parameter records with defaults for the fields they lack."""
    path = fresh_path(spark, "parameters")
    table(spark, sf, "events").select("props").write.text(path)
    records = read_records(spark, path, "k INT, n_estimators INT, learning_rate DOUBLE")
    filled = with_defaults(records, {"k": 0, "n_estimators": 1000, "learning_rate": 0.05})
    return filled.groupBy("k", "n_estimators", "learning_rate").agg(F.count(F.lit(1)).alias("records"))


def runs_table(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the list price per return flag, appended as metric records and read back."""
    path = fresh_path(spark, "runs")
    found = regression_metrics(price_predictions(spark, sf), by=["l_returnflag"])
    append_metrics(found.withColumnRenamed("l_returnflag", "run"), path)
    runs = read_records(spark, path, METRICS_SCHEMA)
    return runs.select("run", F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


def trial_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One trial per user: parameters from its event counts, score from its mean value."""
    params = F.struct(
        F.count(F.lit(1)).cast("int").alias("n_estimators"), F.count_if(F.col("event_type") == "click").cast("int").alias("max_depth")
    )
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("trial")).agg(
        params.alias("params"), F.round(F.avg("value"), 6).alias("score")
    )


def best_trial_query(spark: SparkSession, sf: str) -> DataFrame:
    best = best_trial(trial_ledger(spark, sf))
    return best.select("trial", "params.n_estimators", "params.max_depth", "score")


def saved_best_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The winning trial's parameters written as JSON and read back over the defaults."""
    path = fresh_path(spark, "best-parameters")
    write_parameters(spark, path, best_trial(trial_ledger(spark, sf)).first()["params"].asDict())
    found = read_parameters(spark, path)
    row = (found["n_estimators"], found["max_depth"], found["learning_rate"])
    return spark.createDataFrame([row], "n_estimators INT, max_depth INT, learning_rate DOUBLE")


QUERIES = {
    "filtered_scan": filtered_scan_query,
    "result_size": result_size_query,
    "guarded_scan": guarded_scan_query,
    "coerced_values": coerced_values,
    "numeric_rows_only": numeric_rows_only,
    "canonical_texts": canonical_texts,
    "collapsed_documents": collapsed_documents,
    "curated_prices": curated_prices,
    "label_balance": label_balance,
    "log_targets": log_targets,
    "csv_round_trip": csv_round_trip,
    "csv_texts": csv_texts,
    "records_to_table": records_to_table,
    "parameters_with_defaults": parameters_with_defaults,
    "runs_table": runs_table,
    "best_trial": best_trial_query,
    "saved_best_parameters": saved_best_parameters,
}

_CANONICAL = r"nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '')"

_CURATED = """
  SELECT l_partkey, count(*) AS n, round(median(l_extendedprice), 6) AS median_l_extendedprice,
         (min({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey})).a AS first_l_orderkey,
         round(9 - log10(median(l_extendedprice) + 1e-10), 6) AS y
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY l_partkey
"""

_PRICE_ERROR = """
  SELECT l_returnflag, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS t, l_extendedprice AS p FROM lineitem
"""

_TRIALS = """
  SELECT user_id AS trial, count(*)::INT AS n_estimators, (count(*) FILTER (event_type = 'click'))::INT AS max_depth,
         round(avg(value), 6) AS score
  FROM events GROUP BY user_id
"""

ORACLE = {
    "filtered_scan": """
        SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    "result_size": "SELECT count(*) AS records FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
    "guarded_scan": """
        SELECT count(*) AS records, 'orders' AS input FROM orders
        UNION ALL SELECT 0 AS records, 'not_written_yet' AS input""",
    "coerced_values": "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS number FROM events",
    "numeric_rows_only": "SELECT event_id, value AS standard_value FROM events WHERE event_type <> 'error'",
    "canonical_texts": f"""
        SELECT doc_id, md5({_CANONICAL}) AS key_digest, length({_CANONICAL})::INT AS key_chars FROM documents""",
    "collapsed_documents": f"""
        SELECT sha256({_CANONICAL}) AS key_digest, count(*) AS n, median(n_chars) AS median_n_chars,
               min(doc_id) AS first_doc_id
        FROM documents WHERE {_CANONICAL} IS NOT NULL GROUP BY {_CANONICAL}""",
    "curated_prices": f"SELECT *, (y >= 4.6)::INT AS label FROM ({_CURATED})",
    "label_balance": f"""
        SELECT (y >= 4.6)::INT AS label, count(*) AS keys, round(avg(y), 6) AS mean_y FROM ({_CURATED}) GROUP BY 1""",
    "log_targets": """
        SELECT c_custkey, y, (y >= 5.0)::INT AS label FROM (
          SELECT c_custkey,
                 CASE WHEN c_acctbal * 10 + 1e-10 > 0 THEN round(9 - log10(c_acctbal * 10 + 1e-10), 6) END AS y
          FROM customer)""",
    "csv_texts": """
        SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '  ' || text || ' ' || chr(9) WHEN 1 THEN '"' || text || '",""'
               WHEN 2 THEN chr(13) || chr(10) || text || chr(92) || chr(10) WHEN 3 THEN '' WHEN 4 THEN NULL ELSE text END AS text,
               lang FROM documents""",
    "csv_round_trip": "SELECT p_partkey, p_name, p_type, p_retailprice FROM part",
    "records_to_table": "SELECT event_id, event_type, value, 0 AS has_unit FROM events",
    "parameters_with_defaults": """
        SELECT coalesce((props->>'$.k')::INT, 0) AS k, 1000 AS n_estimators, 0.05::DOUBLE AS learning_rate,
               count(*) AS records
        FROM events GROUP BY 1""",
    "runs_table": f"""
        SELECT l_returnflag AS run, round(sqrt(avg(pow(t - p, 2))), 6) AS rmse,
               round(1 - sum(pow(t - p, 2)) / (var_pop(t) * count(*)), 6) AS r2
        FROM ({_PRICE_ERROR}) GROUP BY l_returnflag""",
    "best_trial": f"SELECT trial, n_estimators, max_depth, score FROM ({_TRIALS}) ORDER BY score, trial LIMIT 1",
    "saved_best_parameters": f"""
        SELECT n_estimators, max_depth, 0.05::DOUBLE AS learning_rate FROM ({_TRIALS}) ORDER BY score, trial LIMIT 1""",
}

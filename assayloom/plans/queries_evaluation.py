"""Registered queries: regression and classification evaluation, residual diagnostics, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators import classification, regression, stopping
from assayloom.operators.alignment import aligned_join
from assayloom.plans.training import CLASSIFICATION
from assayloom.sinks.files import append_metrics
from assayloom.sources.files import CLASS_METRICS_SCHEMA, read_records
from assayloom.sources.tables import table
from assayloom.staging import fresh_path

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for comparison across engines."""
    return df.withColumns({name: F.round(name, digits) for name, kind in df.dtypes if kind == "double"})


def price_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the charged price as truth and the list price as prediction."""
    charged = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").select(
        *LINE_KEY,
        "l_returnflag",
        "l_quantity",
        "l_discount",
        charged.alias("y_true"),
        F.col("l_extendedprice").alias("y_pred"),
    )


def retail_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A second, uninformative predictor: quantity times the part's retail price."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    joined = aligned_join(price_predictions(spark, sf), parts, "l_partkey")
    return joined.withColumn("y_retail", F.col("l_quantity") * F.col("p_retailprice"))


def line_residuals(spark: SparkSession, sf: str) -> DataFrame:
    found = regression.with_residuals(price_predictions(spark, sf))
    return rounded(found.select(*LINE_KEY, "residual", "absolute_error"))


def price_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.regression_metrics(price_predictions(spark, sf)))


def retail_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.regression_metrics(retail_predictions(spark, sf), y_pred="y_retail"))


def worst_predictions(spark: SparkSession, sf: str) -> DataFrame:
    worst = regression.worst_predictions(price_predictions(spark, sf), LINE_KEY)
    return rounded(regression.report_lines(worst).select(*LINE_KEY, "absolute_error", "line"))


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    models = {"list price": "y_pred", "discounted price": "y_discounted", "retail price": "y_retail"}
    predictions = retail_predictions(spark, sf).withColumn("y_discounted", F.col("y_pred") * (1 - F.col("l_discount")))
    return rounded(regression.compare_models(predictions, "y_true", models, baseline="retail price"))


def residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    residuals = regression.with_residuals(price_predictions(spark, sf)).select("residual")
    return rounded(regression.histogram(residuals, "residual"))


def residual_density(spark: SparkSession, sf: str) -> DataFrame:
    residuals = regression.with_residuals(price_predictions(spark, sf)).select("residual")
    return rounded(regression.density(residuals, "residual", bin_width=100.0), 4)


def residual_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.residual_profile(price_predictions(spark, sf)))


def residual_bias(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.residual_bias(price_predictions(spark, sf)))


def urgency(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with urgency as the class and the scaled price as the score."""
    score = F.col("o_totalprice") / 500000
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("true"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return classification.confusion_matrix(urgency(spark, sf))


def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.classification_metrics(urgency(spark, sf)))


def cumulative_positives(spark: SparkSession, sf: str) -> DataFrame:
    return classification.cumulative_positives(urgency(spark, sf), "true", "score")


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.roc_auc(urgency(spark, sf), "true", "score"))


def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = classification.roc_curve(urgency(spark, sf), "true", "score")
    return curve.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


def area_under_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = classification.roc_curve(urgency(spark, sf), "true", "score")
    return rounded(classification.area_under(curve, "fpr", "tpr"))


def class_runs_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rates and area of the urgency score as one record appended to a metrics table and read back."""
    orders = urgency(spark, sf).withColumn("predicted_probability", F.col("score"))
    path = fresh_path(spark, "class-runs")
    append_metrics(CLASSIFICATION.metrics(orders).withColumn("run", F.lit("urgency")), path)
    return rounded(read_records(spark, path, CLASS_METRICS_SCHEMA))


def patience_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Every run to its end, with a gap of several units, so that the gap decides."""
    return stopping.early_stops(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", gap=7.5)


def patience_stops_long_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same where nearly every run counts as too long for one row."""
    events = table(spark, sf, "events")
    return stopping.early_stops(events, "user_id", ["ts", "event_id"], "value", gap=7.5, held_records=2)


def patience_stops_null_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events of every third user have lost their run; together they are one."""
    run = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    events = table(spark, sf, "events").withColumn("run", run)
    return stopping.early_stops(events, "run", ["ts", "event_id"], "value", gap=7.5)


def capped_patience_stops(spark: SparkSession, sf: str) -> DataFrame:
    """A trainer that ends after 20 epochs."""
    events = table(spark, sf, "events")
    return stopping.early_stops(events, "user_id", ["ts", "event_id"], "value", gap=7.5, most_epochs=20)


def uneven_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Price predictions with missing, NaN and infinite sides."""
    key = F.col("l_partkey")
    lost = F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, F.lit(float("nan"))).when(key % 17 == 0, F.lit(float("inf")))
    whole = (key % 11 != 0) & (key % 13 != 0) & (key % 17 != 0)
    rows = price_predictions(spark, sf).withColumn("y_pred", F.when(whole, F.col("y_pred")).otherwise(lost.cast("double")))
    return rows.withColumn("y_true", F.when(key % 19 != 0, F.col("y_true")))


def uneven_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.regression_metrics(uneven_predictions(spark, sf), by=["l_returnflag"]))


def uneven_histogram(spark: SparkSession, sf: str) -> DataFrame:
    residuals = regression.with_residuals(uneven_predictions(spark, sf)).select("residual")
    return rounded(regression.histogram(residuals, "residual", bins=32))


def uneven_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix and rates of orders with missing and foreign labels."""
    key = F.col("o_orderkey")
    orders = urgency(spark, sf).withColumns(
        {
            "true": F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit(2)).otherwise(F.col("true")),
            "predicted": F.when(key % 13 != 0, F.col("predicted")),
        }
    )
    rates = classification.classification_metrics(orders).drop("unlabelled")
    return rounded(classification.confusion_matrix(orders).crossJoin(F.broadcast(rates)))


def uneven_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the curve of the orders that have a finite score."""
    key = F.col("o_orderkey")
    score = F.when(key % 5 == 0, F.lit(float("nan"))).when(key % 7 != 0, F.col("score"))
    return rounded(classification.roc_auc(urgency(spark, sf).withColumn("score", score), "true", "score"))


def round_stops(spark: SparkSession, sf: str) -> DataFrame:
    return stopping.early_stops(
        table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", patience=20, gap=0.0, larger_is_better=False
    )


def best_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return stopping.best_epochs(table(spark, sf, "events"), "user_id", "event_id", "value")


QUERIES = {
    "line_residuals": line_residuals,
    "price_metrics": price_metrics,
    "retail_metrics": retail_metrics,
    "worst_predictions": worst_predictions,
    "model_comparison": model_comparison,
    "residual_histogram": residual_histogram,
    "residual_density": residual_density,
    "residual_profile": residual_profile,
    "residual_bias": residual_bias,
    "confusion_matrix": confusion_matrix,
    "classification_metrics": classification_metrics,
    "cumulative_positives": cumulative_positives,
    "roc_auc": roc_auc,
    "roc_curve": roc_curve,
    "area_under_curve": area_under_curve,
    "class_runs_table": class_runs_table,
    "patience_stops": patience_stops,
    "patience_stops_long_runs": patience_stops_long_runs,
    "patience_stops_null_runs": patience_stops_null_runs,
    "capped_patience_stops": capped_patience_stops,
    "uneven_metrics": uneven_metrics,
    "uneven_histogram": uneven_histogram,
    "uneven_classes": uneven_classes,
    "uneven_auc": uneven_auc,
    "round_stops": round_stops,
    "best_epochs": best_epochs,
}

_LINES = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS t,
         l_extendedprice AS p, l_extendedprice * (1 - l_discount) AS d, l_quantity * p_retailprice AS q,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice AS e
  FROM lineitem JOIN part ON p_partkey = l_partkey"""


def _metrics(pred: str) -> str:
    return f"""round(sqrt(avg(pow(t - {pred}, 2))), 6) AS rmse,
        round(1 - sum(pow(t - {pred}, 2)) / (var_pop(t) * count(*)), 6) AS r2"""


_ORDERS = """
  SELECT o_orderkey, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS y, o_totalprice / 500000 AS s,
         (o_totalprice / 500000 >= 0.5)::INT AS yhat FROM orders"""

_CURVE = f"""
  SELECT s, positives, negatives,
         (sum(positives) OVER (ORDER BY s DESC))::BIGINT AS tp, (sum(negatives) OVER (ORDER BY s DESC))::BIGINT AS fp
  FROM (SELECT s, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives FROM ({_ORDERS}) GROUP BY s)"""


def _stops_sql(patience: int, sign: str, most: str) -> str:
    return f"""
        WITH log AS (
          SELECT user_id, {sign}value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
          FROM events),
        kept AS (SELECT *, least(count(*) OVER (PARTITION BY user_id), {most}) AS epochs FROM log),
        seen AS (
          SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY pos
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
          FROM kept WHERE pos <= epochs),
        better AS (SELECT *, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nxt
                   FROM seen WHERE best IS NULL OR v > best),
        stops AS (SELECT user_id, min(pos) AS best_epoch FROM better
                  WHERE (nxt IS NULL OR nxt > pos + {patience}) AND pos + {patience} <= epochs GROUP BY user_id),
        lasts AS (SELECT user_id, max(pos) AS last_epoch FROM better GROUP BY user_id)
        SELECT l.user_id, b.epochs, b.pos AS best_epoch, {sign}b.v AS best_value,
               s.best_epoch + {patience} AS stop_epoch
        FROM lasts l LEFT JOIN stops s ON s.user_id = l.user_id
        JOIN better b ON b.user_id = l.user_id AND b.pos = coalesce(s.best_epoch, l.last_epoch)"""


def _literal_stops(run: str, most: str, name: str = "user_id") -> str:
    """The patience loop as it stands, epoch by epoch."""
    return f"""
        WITH RECURSIVE log AS (
          SELECT {run} AS r, value AS v, row_number() OVER (PARTITION BY {run} ORDER BY ts, event_id) AS e FROM events),
        kept AS (SELECT * FROM log WHERE e <= {most}),
        walk AS (
          SELECT r, e, v AS best, e AS since, 0 AS waited FROM kept WHERE e = 1
          UNION ALL
          SELECT k.r, k.e, CASE WHEN k.v > best + 7.5 THEN k.v ELSE best END, CASE WHEN k.v > best + 7.5 THEN k.e ELSE since END,
                 CASE WHEN k.v > best + 7.5 THEN 0 ELSE waited + 1 END
          FROM walk w JOIN kept k ON k.r IS NOT DISTINCT FROM w.r AND k.e = w.e + 1 WHERE waited < 10),
        ends AS (SELECT r, max(e) AS e FROM walk GROUP BY r),
        sizes AS (SELECT r, count(*) AS epochs FROM kept GROUP BY r)
        SELECT w.r AS {name}, epochs, since AS best_epoch, best AS best_value, CASE WHEN waited = 10 THEN w.e END AS stop_epoch
        FROM walk w JOIN ends n ON n.r IS NOT DISTINCT FROM w.r AND n.e = w.e
        JOIN sizes s ON s.r IS NOT DISTINCT FROM w.r"""


_UNEVEN = """
  SELECT l_returnflag, t, p, good FROM (
    SELECT l_returnflag, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS t, l_extendedprice AS p,
           l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AS good FROM lineitem)"""

_RATES = """
  round(avg((y = yhat)::INT), 6) AS accuracy, round(sum(y * yhat) / sum(yhat), 6) AS precision,
  round(sum(y * yhat) / sum(y), 6) AS recall, round(2 * sum(y * yhat) / (sum(y) + sum(yhat)), 6)"""

_AUC = f"""
  SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc
  FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM ({_ORDERS}))"""

ORACLE = {
    "line_residuals": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e, 6) AS residual, round(abs(e), 6) AS absolute_error
        FROM ({_LINES})""",
    "price_metrics": f"""
        SELECT count(*) AS n, 0 AS skipped, {_metrics("p")}, round(pow(corr(t, p), 2), 6) AS pearson_r2 FROM ({_LINES})""",
    "retail_metrics": f"""
        SELECT count(*) AS n, 0 AS skipped, {_metrics("q")}, round(pow(corr(t, q), 2), 6) AS pearson_r2 FROM ({_LINES})""",
    "worst_predictions": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(e), 6) AS absolute_error,
               printf('True: %.2f | Predicted: %.2f | Residual: %.2f', t, p, e) AS line
        FROM ({_LINES}) ORDER BY abs(e) DESC, 1, 2, 3, 4 LIMIT 5""",
    "model_comparison": f"""
        WITH base AS (SELECT sqrt(avg(pow(t - q, 2))) AS b FROM ({_LINES})),
        found AS (
          SELECT 'list price' AS model, {_metrics("p")}, sqrt(avg(pow(t - p, 2))) AS raw FROM ({_LINES}) UNION ALL
          SELECT 'discounted price', {_metrics("d")}, sqrt(avg(pow(t - d, 2))) FROM ({_LINES}) UNION ALL
          SELECT 'retail price', {_metrics("q")}, sqrt(avg(pow(t - q, 2))) FROM ({_LINES}))
        SELECT model, rmse, r2, round((b - raw) / b, 6) AS rmse_gain FROM found, base""",
    "residual_histogram": f"""
        WITH e AS (SELECT e FROM ({_LINES})),
        s AS (SELECT count(*) AS n, min(e) AS lo, max(e) AS hi, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3
              FROM e),
        b AS (SELECT *, greatest(ceil(log2(n) + 1), ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0 / 3))))::BIGINT AS bins
              FROM s),
        w AS (SELECT *, (hi - lo) / bins AS width FROM b),
        c AS (SELECT least(floor((e - lo) / width), bins - 1)::BIGINT AS bin, count(*) AS count FROM e, w GROUP BY 1)
        SELECT c.bin, bins, round(lo + c.bin * width, 6) AS low, round(lo + (c.bin + 1) * width, 6) AS high, c.count
        FROM w, c""",
    "residual_density": f"""
        WITH e AS (SELECT e FROM ({_LINES})),
        s AS (SELECT count(*) AS n, min(e) AS lo, max(e) AS hi, stddev_samp(e) * pow(count(*), -0.2) AS h FROM e),
        k AS (SELECT *, ceil((hi - lo) * 64 / h) AS cells FROM s),
        c AS (SELECT least(floor((e - lo) / ((hi - lo) / cells)), cells - 1) AS cell, count(*) AS m, avg(e) AS center
              FROM e, k GROUP BY 1),
        g AS (SELECT i AS point, lo + i * ((hi - lo) / 199) AS x, h FROM k, (SELECT unnest(range(200)) AS i))
        SELECT point, round(any_value(x), 4) AS x,
               round(sum(m * exp(-pow((x - center) / h, 2) / 2)) * 100.0 / (any_value(h) * sqrt(2 * pi())), 4) AS density
        FROM g, c GROUP BY point""",
    "residual_profile": f"""
        WITH s AS (SELECT min(p) AS lo, (max(p) - min(p)) / 20 AS w FROM ({_LINES}))
        SELECT least(floor((p - lo) / w), 19)::BIGINT AS bucket, count(*) AS count, round(avg(p), 6) AS mean_prediction,
               round(avg(e), 6) AS mean_residual, round(stddev_samp(e), 6) AS residual_stddev
        FROM ({_LINES}), s GROUP BY 1""",
    "residual_bias": f"""
        SELECT round(regr_slope(e, t), 6) AS residual_slope, round(avg(e), 6) AS mean_residual FROM ({_LINES})""",
    "confusion_matrix": f"""
        SELECT g.t AS true, g.p AS predicted, count(o.y) AS count, 0 AS unlabelled
        FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(t, p) LEFT JOIN ({_ORDERS}) o ON o.y = g.t AND o.yhat = g.p
        GROUP BY g.t, g.p""",
    "classification_metrics": f"SELECT {_RATES} AS f1, 0 AS unlabelled FROM ({_ORDERS})",
    "class_runs_table": f"""
        SELECT 'urgency' AS run, {_RATES} AS "f1-score", ({_AUC}) AS "ROC-AUC" FROM ({_ORDERS})""",
    "cumulative_positives": f"SELECT s AS score, positives, negatives, tp, fp FROM ({_CURVE})",
    "roc_auc": _AUC,
    "roc_curve": f"""
        SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
        SELECT s, round(fp / (SELECT sum(1 - y) FROM ({_ORDERS})), 6),
               round(tp / (SELECT sum(y) FROM ({_ORDERS})), 6)
        FROM ({_CURVE})""",
    "area_under_curve": f"""
        WITH t AS (SELECT max(fp) AS n, max(tp) AS p FROM ({_CURVE})),
        c AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT fp / n, tp / p FROM ({_CURVE}), t)
        SELECT round(sum((x - lx) * (y + ly) / 2), 6) AS area
        FROM (SELECT x, y, lag(x) OVER (ORDER BY x, y) AS lx, lag(y) OVER (ORDER BY x, y) AS ly FROM c)""",
    "patience_stops": _literal_stops("user_id", "9223372036854775807"),
    "patience_stops_long_runs": _literal_stops("user_id", "9223372036854775807"),
    "patience_stops_null_runs": _literal_stops(
        "CASE WHEN user_id % 3 <> 0 THEN 'u' || user_id END", "9223372036854775807", "run"
    ),
    "capped_patience_stops": _literal_stops("user_id", "20"),
    "uneven_metrics": f"""
        SELECT l_returnflag, count(t) FILTER (good) AS n, count(*) FILTER (NOT coalesce(good, false)) AS skipped,
               round(sqrt(avg(pow(t - p, 2)) FILTER (good)), 6) AS rmse,
               round(1 - sum(pow(t - p, 2)) FILTER (good) / (var_pop(t) FILTER (good) * count(*) FILTER (good)), 6) AS r2,
               round(pow(corr(t, p) FILTER (good), 2), 6) AS pearson_r2
        FROM ({_UNEVEN}) GROUP BY l_returnflag""",
    "uneven_histogram": f"""
        WITH e AS (SELECT t - p AS e FROM ({_UNEVEN}) WHERE good),
        s AS (SELECT min(e) AS lo, (max(e) - min(e)) / 32 AS width FROM e)
        SELECT least(floor((e - lo) / width), 31)::BIGINT AS bin, 32 AS bins,
               round(any_value(lo) + bin * any_value(width), 6) AS low,
               round(any_value(lo) + (bin + 1) * any_value(width), 6) AS high, count(*) AS count
        FROM e, s GROUP BY bin""",
    "uneven_classes": f"""
        WITH o AS (
          SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 2 ELSE y END AS y,
                 CASE WHEN o_orderkey % 13 <> 0 THEN yhat END AS yhat FROM ({_ORDERS})),
        k AS (SELECT * FROM o WHERE y IN (0, 1) AND yhat IN (0, 1)),
        r AS (SELECT {_RATES} AS f1, (SELECT count(*) FROM o) - count(*) AS unlabelled FROM k)
        SELECT g.t AS true, g.p AS predicted, (SELECT count(*) FROM k WHERE y = g.t AND yhat = g.p) AS count, r.*
        FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(t, p), r""",
    "uneven_auc": f"""
        WITH k AS (SELECT * FROM ({_ORDERS}) WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
        SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc
        FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM k)""",
    "round_stops": _stops_sql(20, "-", "9223372036854775807"),
    "best_epochs": """
        SELECT user_id, arg_min(event_id, {'v': value, 'e': event_id}) AS best_epoch, min(value) AS best_metric
        FROM events GROUP BY user_id""",
}

"""Registered queries: boosted trees, stopping, search, encoding, dual scoring on tables and streams.

Trees are kept small: the tables here are small, and the plans do not depend on the number of rounds.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.numeric import negative_log_molar, threshold_label
from assayloom.functions.requests import HIGH_RISK, LOW_RISK
from assayloom.functions.text import canonical_key, tokens
from assayloom.learning import boosting, search
from assayloom.learning.encoding import encode_texts, hashed_direction_encoder
from assayloom.learning.halving import LOGISTIC, Search
from assayloom.learning.features import with_fingerprint_vector
from assayloom.operators.split import group_split
from assayloom.plans.queries_evaluation import rounded
from assayloom.plans.queries_features import bucket_sql, TOKENS_SQL
from assayloom.plans.queries_split import split_sql
from assayloom.plans.training import CLASSIFICATION, REGRESSION, train_and_evaluate, tune
from assayloom.sinks.files import save_model
from assayloom.sources.files import read_parameters
from assayloom.sources.models import load_model
from assayloom.sources.tables import table
from assayloom.staging import fresh_path, stage
from assayloom.streaming.scoring import read_requests, respond, run_stream, score

SMALL_TREES = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8}
SEARCH_SPACE = (
    search.Whole("n_estimators", 2, 6, 2),
    search.Whole("max_depth", 2, 3),
    search.Real("learning_rate", 0.05, 0.5, log=True),
    search.Real("subsample", 0.6, 1.0),
)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Key, features, regression target (half the label plus a fixed linear function of the vector) and 0/1 label."""
    weighted = F.aggregate(
        F.transform("embedding", lambda v, i: v.cast("double") * F.sin(i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("features"),
        (F.col("label") / 2 + weighted).alias("y"),
        threshold_label(F.col("label")).alias("label"),
    )


def _staged_split(spark: SparkSession, sf: str) -> DataFrame:
    return stage(group_split(vectors(spark, sf), "vec_id", ["vec_id"]), "split-vectors")


def split_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return boosting.with_vector(_staged_split(spark, sf))


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    split = split_vectors(spark, sf)
    train, valid, test = (split.where(F.col("split") == s) for s in ("train", "valid", "test"))
    return boosting.in_fixed_order(train, "vec_id"), valid, test


def _saved_models(spark: SparkSession, sf: str) -> str:
    train, _, _ = parts(spark, sf)
    model = boosting.scoring_model(
        boosting.regressor(SMALL_TREES).fit(train), boosting.classifier(SMALL_TREES).fit(train)
    )
    path = fresh_path(spark, "models")
    save_model(model, path)
    return path


def saved_models(spark: SparkSession, sf: str) -> PipelineModel:
    return load_model(_saved_models(spark, sf))


def regression_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of a regressor on vectors, with their identifiers and residuals."""
    rows = split_vectors(spark, sf)
    predictions, _ = train_and_evaluate(rows, REGRESSION, SMALL_TREES, "vec_id", patience=3)
    return predictions


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out classes and probabilities of a classifier on vectors."""
    rows = split_vectors(spark, sf)
    predictions, _ = train_and_evaluate(rows, CLASSIFICATION, SMALL_TREES, "vec_id", patience=3)
    return predictions


def fingerprint_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A regressor on text fingerprints for the log text length; copies of a text never span two splits."""
    documents = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    target = negative_log_molar(F.col("n_chars").cast("double"))
    described = with_fingerprint_vector(documents, "text").select(
        "doc_id", "vector", target.alias("y"), F.sha2(canonical_key(F.col("text")), 256).alias("digest")
    )
    rows = group_split(stage(described, "fingerprints"), "digest", ["doc_id"])
    predictions, _ = train_and_evaluate(stage(rows, "split-fingerprints"), REGRESSION, SMALL_TREES, "doc_id", patience=3)
    return predictions


def stopped_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Validation loss of every round, and whether the stopped model kept the round."""
    train, valid, _ = parts(spark, sf)
    fit = boosting.fit_with_stopping(boosting.regressor, {**SMALL_TREES, "n_estimators": 12}, train, valid, patience=3)
    rows = [(i, loss, i <= fit.rounds) for i, loss in enumerate(fit.losses, start=1)]
    return spark.createDataFrame(rows, "round int, validation_loss double, kept boolean")


ONE_SPLIT = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, "subsample": 1.0}


def one_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Split rows whose only feature is 0 or 1: what one round of depth one learns has a closed form."""
    source = table(spark, sf, "embeddings").select(
        "vec_id",
        F.array((F.col("label") >= 5).cast("double")).alias("features"),
        (F.col("label") / 2).alias("y"),
        F.col("label").isin(4, 5, 6, 8, 9).cast("int").alias("label"),
    )
    return boosting.with_vector(stage(group_split(source, "vec_id", ["vec_id"]), "one-feature"))


STOPPED = {"n_estimators": 12, "max_depth": 1, "learning_rate": 0.7}


def stopped_class_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Validation loss of every round of a classifier on the one feature, and whether the stopped model kept the round."""
    rows = one_feature(spark, sf)
    train, valid = (rows.where(F.col("split") == s) for s in ("train", "valid"))
    train = boosting.in_fixed_order(train, "vec_id")
    fit = boosting.fit_with_stopping(boosting.classifier, STOPPED, train, valid, patience=3)
    kept = [(i, round(loss, 6), i <= fit.rounds) for i, loss in enumerate(fit.losses, start=1)]
    return spark.createDataFrame(kept, "round int, validation_loss double, kept boolean")


HALVING_SPACE = (search.Whole("n_estimators", 3, 9), search.Real("learning_rate", 0.02, 0.9, log=True), search.Whole("max_depth", 1, 2))


def halving_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A search of eight trials on the one feature: drawn parameters, rounds and loss of each rung, and who went on."""
    found = Search(one_feature(spark, sf), LOGISTIC, "vec_id", fresh_path(spark, "halving"), HALVING_SPACE, 8, first_rounds=2)
    params = F.from_json("params", "n_estimators int, learning_rate double, max_depth int")
    ledger = found.run().withColumn("params", params)
    return ledger.select(
        "trial", "rung", "rounds", "params.n_estimators", F.round("params.learning_rate", 6).alias("learning_rate"),
        "params.max_depth", F.round("score", 6).alias("score"), "kept",
    )


def split_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of the regressor: the means of the two sides of the training rows."""
    predictions, _ = train_and_evaluate(one_feature(spark, sf), REGRESSION, ONE_SPLIT, "vec_id")
    return rounded(predictions)


def split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics record of the same job."""
    _, record = train_and_evaluate(one_feature(spark, sf), REGRESSION, ONE_SPLIT, "vec_id")
    return rounded(record.drop("best_params"))


def split_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out classes and probabilities of the classifier: the logistic of twice the mean of the -1/1 labels of a side."""
    predictions, _ = train_and_evaluate(one_feature(spark, sf), CLASSIFICATION, ONE_SPLIT, "vec_id")
    return rounded(predictions)


def split_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics record of the same job."""
    _, record = train_and_evaluate(one_feature(spark, sf), CLASSIFICATION, ONE_SPLIT, "vec_id")
    return rounded(record.drop("best_params"))


def _split_model(spark: SparkSession, rows: DataFrame) -> PipelineModel:
    """Regressor and classifier of the training rows, saved as one model and loaded again."""
    train = boosting.in_fixed_order(rows.where(F.col("split") == "train"), "vec_id")
    path = fresh_path(spark, "split-models")
    save_model(
        boosting.scoring_model(boosting.regressor(ONE_SPLIT).fit(train), boosting.classifier(ONE_SPLIT).fit(train)), path
    )
    return load_model(path)


def _split_answers(scored: DataFrame) -> DataFrame:
    answers = respond(scored.withColumn("name", F.col("vec_id").cast("string")), "name")
    return answers.select(
        "vec_id",
        "response.classification.*",
        F.col("response.regression.predicted_pIC50").alias("predicted"),
        "response.status",
    )


def split_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every row through the saved and reloaded pair of models into the nested response."""
    rows = one_feature(spark, sf)
    return _split_answers(score(rows.select("vec_id", "features"), _split_model(spark, rows)))


def split_responses_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the rows as a file stream."""
    rows, path = one_feature(spark, sf).drop("vector"), fresh_path(spark, "stream-rows")
    rows.select("vec_id", "features").write.parquet(path)
    model = _split_model(spark, boosting.with_vector(rows))
    stream = spark.readStream.schema("vec_id long, features array<double>").parquet(path)
    return run_stream(_split_answers(score(stream, model)), "split-responses")


def search_trials(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of a seeded search for the classifier, scored by exact validation AUC."""
    ledger = tune(split_vectors(spark, sf), CLASSIFICATION, "vec_id", SEARCH_SPACE, 3, patience=3)
    return ledger.select("trial", "params.*", "score")


def refit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Search for the regressor by validation RMSE, refit with the saved winner, and evaluate on the held-out split."""
    rows, path = split_vectors(spark, sf), fresh_path(spark, "winner")
    tune(rows, REGRESSION, "vec_id", SEARCH_SPACE, 2, path, seed=7, patience=3)
    _, record = train_and_evaluate(rows, REGRESSION, read_parameters(spark, path), "vec_id", patience=3)
    return record.drop("best_params")


def encoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a vector from the default encoder."""
    encoded = encode_texts(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return encoded.select("doc_id", "features")


def encoded_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole document through a small encoder of whole-numbered directions: tokens, and sums of their directions."""
    documents = table(spark, sf, "documents").select("doc_id", "text", F.size(tokens(F.col("text"))).alias("length"))
    encoded = encode_texts(documents, "text", hashed_direction_encoder())
    sums = [F.round(F.get("features", F.lit(d)).cast("double") * F.col("length")).cast("long").alias(f"s{d}") for d in range(4)]
    return encoded.select("doc_id", "length", *sums)


def _named(rows: DataFrame) -> DataFrame:
    """The key as text; every seventh vector short and every eleventh missing, as requests may be."""
    broken = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, F.slice("features", 1, 9))
    known = (F.col("vec_id") % 11 != 0) & (F.col("vec_id") % 7 != 0)
    return rows.select("vec_id", F.when(known, F.col("features")).otherwise(broken).alias("features"), F.col("vec_id").cast("string").alias("name"))


def dual_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector through both saved and reloaded models into one nested response."""
    named = _named(vectors(spark, sf).select("vec_id", "features"))
    return respond(score(named, saved_models(spark, sf)), "name").select("vec_id", "response")


def score_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Status and reason of every scored row; the rows are as many as the vectors."""
    return dual_scores(spark, sf).select("vec_id", "response.smiles", "response.status", "response.error")


def stream_score_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the stream."""
    return dual_scores_stream(spark, sf).select("vec_id", "response.smiles", "response.status", "response.error")


def dual_scores_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same scoring over the vectors as a file stream."""
    source = spark.read.parquet(f"{sf}/embeddings.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/[e]mbeddings.parquet")
    named = _named(stream.select("vec_id", F.col("embedding").alias("features")))
    scored = respond(score(named, saved_models(spark, sf)), "name").select("vec_id", "response")
    return run_stream(scored, "scores")


def request_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Text requests end to end: type check, tokens, encoder, both models, nested response."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    bodies = documents.select("doc_id", F.to_json(F.struct(F.col("text").alias("smiles"))).alias("body"))
    encoded = encode_texts(read_requests(bodies, "body", "smiles"), "smiles")
    return respond(score(encoded, saved_models(spark, sf)), "smiles").select("doc_id", "response")


QUERIES = {
    "regression_predictions": regression_predictions,
    "class_predictions": class_predictions,
    "fingerprint_predictions": fingerprint_predictions,
    "stopped_rounds": stopped_rounds,
    "search_trials": search_trials,
    "refit_metrics": refit_metrics,
    "encoded_texts": encoded_texts,
    "encoded_sums": encoded_sums,
    "dual_scores": dual_scores,
    "dual_scores_stream": dual_scores_stream,
    "request_scores": request_scores,
    "score_errors": score_errors,
    "stream_score_errors": stream_score_errors,
    "stopped_class_rounds": stopped_class_rounds,
    "halving_ledger": halving_ledger,
    "split_predictions": split_predictions,
    "split_metrics": split_metrics,
    "split_classes": split_classes,
    "split_class_metrics": split_class_metrics,
    "split_responses": split_responses,
    "split_responses_stream": split_responses_stream,
}

_ERRORS = """
    SELECT vec_id, vec_id::VARCHAR AS smiles,
           CASE WHEN vec_id % 11 = 0 OR vec_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN vec_id % 11 = 0 THEN 'no vector' WHEN vec_id % 7 = 0 THEN 'wrong vector length' END AS error
    FROM embeddings"""

_SIDES = """, m AS (SELECT split, label >= 5 AS f, label / 2.0 AS y, (label IN (4, 5, 6, 8, 9))::INT AS c, vec_id
               FROM embeddings JOIN assigned ON grp = vec_id),
    k AS (SELECT f, avg(y) AS y_pred, 1 / (1 + exp(-2 * (2 * avg(c) - 1))) AS p FROM m WHERE split = 'train' GROUP BY f),
    t AS (SELECT vec_id, split, f, y, c, y_pred, p, (p > 0.5)::INT AS yhat FROM m JOIN k USING (f)),
    held AS (SELECT * FROM t WHERE split = 'test')"""


def _sides(query: str) -> str:
    """Over the two sides of the one feature: ``t`` has every row with its predictions, ``held`` the held-out ones."""
    return split_sql("embeddings", "vec_id", "vec_id", f"{_SIDES} {query}")


# Boosting on the one feature: each side's margin goes on by its mean gradient; one row per trial, round and side.
_BOOSTED = """, m AS (SELECT split, label >= 5 AS f, label IN (4, 5, 6, 8, 9) AS c FROM embeddings JOIN assigned ON grp = vec_id),
    k AS (SELECT f, avg(c::INT) AS p FROM m WHERE split = 'train' GROUP BY f),
    b AS (SELECT trial, rate, most, 1 AS round, f, p, 2 * p - 1 AS margin FROM k, trials
          UNION ALL SELECT trial, rate, most, round + 1, f, p,
            margin + rate * (p * 4 / (1 + exp(2 * margin)) - (1 - p) * 4 / (1 + exp(-2 * margin))) FROM b WHERE round < most),
    v AS (SELECT f, count(*) FILTER (c) AS yes, count(*) FILTER (NOT c) AS no FROM m WHERE split = 'valid' GROUP BY f),
    s AS (SELECT trial, round, sum(2 * (yes * ln(1 + exp(-2 * margin)) + no * ln(1 + exp(2 * margin)))) / sum(yes + no) AS score
          FROM b JOIN v USING (f) GROUP BY ALL)"""


def _boosted(trials: str, query: str) -> str:
    return split_sql("embeddings", "vec_id", "vec_id", f", trials AS ({trials}){_BOOSTED} {query}")


def _drawn(name: str) -> str:
    """The uniform number of a trial ``i`` with seed 42."""
    return f"(('0x' || substr(md5(i || '|{name}|42'), 1, 13))::BIGINT / pow(2, 52))"


_ANSWERS = _sides(f"""
    SELECT vec_id, yhat = 1 AS is_toxic, round(p, 4) AS confidence_score,
           CASE WHEN yhat = 1 THEN '{HIGH_RISK}' ELSE '{LOW_RISK}' END AS warning,
           round(y_pred, 4) AS predicted, 'success' AS status FROM t""")

SUMS_SQL = ", ".join(
    f"(coalesce(list_sum(list_transform(ids, lambda i: instr('0123456789abcdef', substr(md5(i::VARCHAR), {d + 1}, 1)) - 9)), 0))::BIGINT AS s{d}"
    for d in range(4)
)

ORACLE: dict[str, str] = {
    # A round is kept up to the first lowest loss that three rounds in a row do not beat.
    "stopped_class_rounds": _boosted(
        f"SELECT 0 AS trial, {STOPPED['learning_rate']} AS rate, {STOPPED['n_estimators']} AS most",
        """, l AS (SELECT round, score, min(score) OVER w AS low, lead(score, 3) OVER (ORDER BY round) IS NOT NULL
                     AND min(score) OVER (ORDER BY round ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) >= score AS ends
               FROM s WINDOW w AS (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        r AS (SELECT min(round) FILTER (ends) AS stop, arg_min(round, (score, round)) AS best
              FROM l WHERE low IS NULL OR score < low)
        SELECT round::INT AS round, round(score, 6) AS validation_loss, round <= (SELECT coalesce(stop, best) FROM r) AS kept
        FROM s"""),
    "halving_ledger": _boosted(
        f"""SELECT i AS trial, exp(ln(0.02) + {_drawn('learning_rate')} * (ln(0.9) - ln(0.02))) AS rate,
                   (3 + floor({_drawn('n_estimators')} * 7))::INT AS most, (1 + floor({_drawn('max_depth')} * 2))::INT AS depth
            FROM range(8) t(i)""",
        """, rungs AS (SELECT trial, rung, least(2 * pow(2, rung), most)::INT AS rounds FROM trials, range(4) g(rung)),
        c AS (SELECT trial, rung, rounds, score FROM rungs JOIN s USING (trial) WHERE s.round = rounds),
        r0 AS (SELECT *, row_number() OVER (ORDER BY score, trial) <= 4 AS kept FROM c WHERE rung = 0),
        r1 AS (SELECT c.*, row_number() OVER (ORDER BY c.score, trial) <= 2 AS kept
               FROM c JOIN r0 USING (trial) WHERE r0.kept AND c.rung = 1),
        r2 AS (SELECT c.*, row_number() OVER (ORDER BY c.score, trial) <= 1 AS kept
               FROM c JOIN r1 USING (trial) WHERE r1.kept AND c.rung = 2),
        r3 AS (SELECT c.*, true AS kept FROM c JOIN r2 USING (trial) WHERE r2.kept AND c.rung = 3)
        SELECT trial, rung::INT AS rung, rounds, most AS n_estimators, round(rate, 6) AS learning_rate, depth AS max_depth,
               round(score, 6) AS score, kept
        FROM (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2 UNION ALL FROM r3) JOIN trials USING (trial)"""),
    "encoded_sums": f"""
        SELECT doc_id, len(ids)::INT AS length, {SUMS_SQL}
        FROM (SELECT doc_id, list_transform({TOKENS_SQL}, lambda t: {bucket_sql("t", 4094)} + 2) AS ids FROM documents)""",
    "score_errors": _ERRORS,
    "stream_score_errors": _ERRORS,
    "split_predictions": _sides("""
        SELECT vec_id AS id, round(y, 6) AS y_true, round(y_pred, 6) AS y_pred, round(y - y_pred, 6) AS residual FROM held"""),
    "split_metrics": _sides("""
        SELECT count(*) AS n, 0 AS skipped, round(sqrt(avg(pow(y - y_pred, 2))), 6) AS rmse,
               round(1 - sum(pow(y - y_pred, 2)) / (var_pop(y) * count(*)), 6) AS r2,
               round(pow(corr(y, y_pred), 2), 6) AS pearson_r2, 'run' AS run, 1 AS rounds FROM held"""),
    "split_classes": _sides("""
        SELECT vec_id AS id, c AS true, yhat AS predicted, round(p, 6) AS predicted_probability FROM held"""),
    "split_class_metrics": _sides("""
        , r AS (SELECT c, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM held),
        a AS (SELECT (sum(CASE WHEN c = 1 THEN r END) - sum(c) * (sum(c) + 1) / 2) / (sum(c) * sum(1 - c)) AS auc FROM r)
        SELECT round(avg((c = yhat)::INT), 6) AS accuracy, round(sum(c * yhat) / sum(yhat), 6) AS precision,
               round(sum(c * yhat) / sum(c), 6) AS recall, round(2 * sum(c * yhat) / (sum(c) + sum(yhat)), 6) AS "f1-score",
               0 AS unlabelled, round((SELECT auc FROM a), 6) AS "ROC-AUC", 'run' AS run, 1 AS rounds FROM held"""),
    "split_responses": _ANSWERS,
    "split_responses_stream": _ANSWERS,
}

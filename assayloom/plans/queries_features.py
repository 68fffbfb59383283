"""Registered queries: tokens, vocabulary, fingerprints, vector shapes, request checks, response fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import requests, text, vectors
from assayloom.operators.vocabulary import build_vocabulary, encode_tokens
from assayloom.sources.tables import table
from assayloom.streaming.scoring import check_vectors, read_requests, rejected

LEAST_TOKENS = 8


def joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda v: v.cast("string")), " ")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf, name).select(*columns, "text")


def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed token ids, truncated and padded to 512, with their mask."""
    ids = text.hashed_ids(text.truncated(text.tokens(F.col("text"))), 4096)
    documents = texts(spark, sf, "documents", "doc_id").select("doc_id", ids.alias("ids"))
    return documents.select(
        "doc_id",
        F.md5(joined(text.padded(F.col("ids")))).alias("ids_digest"),
        F.size(text.padded(F.col("ids"))).alias("padded_length"),
        F.aggregate(text.attention_mask(F.col("ids")), F.lit(0), lambda a, m: a + m).alias("mask_sum"),
    )


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return build_vocabulary(texts(spark, sf, "documents"), "text")


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as ids of the document vocabulary; words that documents lack are unknown."""
    turns = texts(spark, sf, "conversations", "conv_id", "turn")
    keyed = turns.select(F.struct("conv_id", "turn").alias("place"), "text")
    encoded = encode_tokens(keyed, "place", "text", vocabulary(spark, sf))
    return encoded.select("place.conv_id", "place.turn", F.size("ids").alias("length"), F.md5(joined(F.col("ids"))).alias("ids_digest"))


def document_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as ids; frequent words are spread over several sub-keys."""
    documents = texts(spark, sf, "documents", "doc_id")
    encoded = encode_tokens(documents, "doc_id", "text", vocabulary(spark, sf), hot_rows=5_000)
    return encoded.select("doc_id", F.size("ids").alias("length"), F.md5(joined(F.col("ids"))).alias("ids_digest"))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    bits = text.text_fingerprint(F.col("text"))
    documents = texts(spark, sf, "documents", "doc_id").select("doc_id", bits.alias("bits"))
    return documents.select("doc_id", F.size("bits").alias("bits_set"), F.md5(joined(F.col("bits"))).alias("bits_digest"))


def usable_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with enough tokens for a fingerprint; the label column stays in the row."""
    bits = text.text_fingerprint(F.col("text"), least_tokens=LEAST_TOKENS)
    rows = texts(spark, sf, "documents", "doc_id", "lang").select("doc_id", "lang", bits.alias("features"))
    return rows.where(F.col("features").isNotNull()).select("doc_id", "lang", F.size("features").alias("bits_set"))


def stacked_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint sizes of two text tables stacked into one, each row under its own key."""

    def batch(name: str, key: str) -> DataFrame:
        bits = text.text_fingerprint(F.col("text"))
        return texts(spark, sf, name, key).select(F.lit(name).alias("batch"), F.col(key).alias("row_key"), F.size(bits).alias("bits_set"))

    return batch("documents", "doc_id").unionByName(batch("benchmark", "item_id"))


def positions(vector: Column) -> Column:
    """A 64-vector as a sequence of 8 position vectors of 8."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(vector, i * 8 + 1, 8))


def first_positions(spark: SparkSession, sf: str) -> DataFrame:
    first = vectors.first_position(positions(F.col("embedding")))
    rows = table(spark, sf, "embeddings").select("vec_id", first.alias("first"))
    return rows.select("vec_id", *[F.round(F.col("first")[i].cast("double"), 6).alias(f"v{i}") for i in range(8)])


def flattened_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Position vectors flattened to one, and reshaped to one column of one-entry rows."""
    flat = table(spark, sf, "embeddings").select("vec_id", vectors.flat(positions(F.col("embedding"))).alias("flat"))
    column = vectors.as_column_shape(F.col("flat"))
    return flat.select(
        "vec_id",
        F.size("flat").alias("length"),
        F.round(F.col("flat")[63].cast("double"), 6).alias("last"),
        F.size(column).alias("rows"),
        F.round(column[9][0].cast("double"), 6).alias("tenth"),
    )


def vector_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Row errors for missing and short vectors; vectors of label 3 are cut and those of label 4 removed beforehand."""
    features = F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).when(F.col("label") != 4, F.col("embedding"))
    rows = table(spark, sf, "embeddings").select("vec_id", features.alias("features"))
    return check_vectors(rows, 64).select("vec_id", "status", "error")


def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Events as request bodies: good ones, a number in place of text, a missing field, and plain words."""
    kind = F.col("event_type")
    body = (
        F.when(kind.isin("click", "purchase"), F.to_json(F.struct(kind.alias("smiles"))))
        .when(kind == "view", F.concat(F.lit('{"smiles":'), F.col("user_id").cast("string"), F.lit("}")))
        .when(kind == "error", F.col("props"))
        .otherwise(kind)
    )
    return table(spark, sf, "events").select("event_id", "value", body.alias("body"))


def checked_requests(spark: SparkSession, sf: str) -> DataFrame:
    return read_requests(request_bodies(spark, sf), "body", "smiles").select("event_id", "smiles", "error")


def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    found = rejected(read_requests(request_bodies(spark, sf), "body", "smiles"), "body")
    return found.groupBy("body", "status", "error").agg(F.count(F.lit(1)).alias("requests"))


def accepted_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The nested response of every good request, with the event value standing in for the model, as flat columns."""
    checked = read_requests(request_bodies(spark, sf), "body", "smiles")
    good = checked.where(F.col("error").isNull())
    chance = F.col("value") / 300
    answered = good.withColumn(
        "r", requests.response(F.col("smiles"), F.col("value") >= 20, chance, F.lit(9) - chance, F.col("error"))
    )
    return answered.select("event_id", "r.smiles", "r.classification.*", "r.regression.*", "r.status").withColumn(
        "is_toxic", F.col("is_toxic").cast("int")
    )


QUERIES = {
    "token_windows": token_windows,
    "vocabulary": vocabulary,
    "token_ids": token_ids,
    "document_token_ids": document_token_ids,
    "fingerprints": fingerprints,
    "usable_fingerprints": usable_fingerprints,
    "stacked_batches": stacked_batches,
    "first_positions": first_positions,
    "flattened_vectors": flattened_vectors,
    "vector_checks": vector_checks,
    "checked_requests": checked_requests,
    "rejected_requests": rejected_requests,
    "accepted_responses": accepted_responses,
}

TOKENS_SQL = r"regexp_extract_all(lower(text), '[^\s]+')"


def bucket_sql(value: str, buckets: int) -> str:
    return f"(('0x' || substr(md5({value}), 1, 8))::BIGINT % {buckets})"


def bits_sql(source: str, key: str, width: int = 2048) -> str:
    """Key, tokens and sorted fingerprint bits of each text."""
    grams = """list_distinct(toks
          || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])
          || list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2]))"""
    return f"""
        SELECT {key}, toks, list_sort(list_distinct(list_transform({grams}, lambda g: {bucket_sql("g", width)}))) AS bits
        FROM (SELECT {key}, {TOKENS_SQL} AS toks FROM {source})"""


_VOCABULARY = f"""
  SELECT token, count(*) AS uses, (row_number() OVER (ORDER BY count(*) DESC, encode(token)) + 1)::INT AS token_id
  FROM (SELECT unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY token"""

_BODIES = """
  SELECT event_id, value, CASE
    WHEN event_type IN ('click', 'purchase') THEN '{"smiles":"' || event_type || '"}'
    WHEN event_type = 'view' THEN '{"smiles":' || user_id || '}'
    WHEN event_type = 'error' THEN props ELSE event_type END AS body, event_type
  FROM events"""

_ERROR = """CASE event_type WHEN 'view' THEN 'wrong type' WHEN 'error' THEN 'missing field' WHEN 'signup' THEN 'not json' END"""

ORACLE = {
    "token_windows": f"""
        SELECT doc_id, md5(array_to_string(ids || list_resize([]::BIGINT[], 512 - len(ids), 0), ' ')) AS ids_digest,
               512 AS padded_length, len(ids)::INT AS mask_sum
        FROM (SELECT doc_id, list_transform(({TOKENS_SQL})[1:512], lambda t: {bucket_sql("t", 4094)} + 2) AS ids FROM documents)""",
    "vocabulary": _VOCABULARY,
    "token_ids": f"""
        WITH v AS ({_VOCABULARY}),
        t AS (SELECT conv_id, turn, unnest({TOKENS_SQL}) AS token, unnest(range(len({TOKENS_SQL}))) AS place FROM conversations)
        SELECT conv_id, turn, count(*)::INT AS length,
               md5(string_agg(coalesce(token_id, 1)::VARCHAR, ' ' ORDER BY place)) AS ids_digest
        FROM t LEFT JOIN v USING (token) GROUP BY conv_id, turn
        UNION ALL SELECT conv_id, turn, 0, md5('') FROM conversations WHERE len({TOKENS_SQL}) = 0""",
    "document_token_ids": f"""
        WITH v AS ({_VOCABULARY}),
        t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token, unnest(range(len({TOKENS_SQL}))) AS place FROM documents)
        SELECT doc_id, count(*)::INT AS length,
               md5(string_agg(coalesce(token_id, 1)::VARCHAR, ' ' ORDER BY place)) AS ids_digest
        FROM t LEFT JOIN v USING (token) GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, md5('') FROM documents WHERE len({TOKENS_SQL}) = 0""",
    "fingerprints": f"""
        SELECT doc_id, len(bits)::INT AS bits_set, md5(array_to_string(bits, ' ')) AS bits_digest
        FROM ({bits_sql("documents", "doc_id")})""",
    "usable_fingerprints": f"""
        SELECT doc_id, lang, len(bits)::INT AS bits_set
        FROM ({bits_sql("documents", "doc_id")}) JOIN documents USING (doc_id) WHERE len(toks) >= 8""",
    "stacked_batches": f"""
        SELECT 'documents' AS batch, doc_id AS row_key, len(bits)::INT AS bits_set
        FROM ({bits_sql("documents", "doc_id")}) UNION ALL
        SELECT 'benchmark' AS batch, item_id AS row_key, len(bits)::INT AS bits_set
        FROM ({bits_sql("benchmark", "item_id")})""",
    "first_positions": "SELECT vec_id, " + ", ".join(
        f"round(embedding[{i + 1}]::DOUBLE, 6) AS v{i}" for i in range(8)
    ) + " FROM embeddings",
    "flattened_vectors": """
        SELECT vec_id, len(embedding)::INT AS length, round(embedding[64]::DOUBLE, 6) AS last,
               len(embedding)::INT AS rows, round(embedding[10]::DOUBLE, 6) AS tenth
        FROM embeddings""",
    "vector_checks": """
        SELECT vec_id, CASE WHEN label IN (3, 4) THEN 'error' ELSE 'success' END AS status,
               CASE label WHEN 3 THEN 'wrong vector length' WHEN 4 THEN 'no vector' END AS error
        FROM embeddings""",
    "checked_requests": f"""
        SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS smiles, {_ERROR} AS error
        FROM ({_BODIES})""",
    "rejected_requests": f"""
        SELECT body, 'error' AS status, {_ERROR} AS error, count(*) AS requests
        FROM ({_BODIES}) WHERE event_type NOT IN ('click', 'purchase') GROUP BY ALL""",
    "accepted_responses": """
        SELECT event_id, event_type AS smiles, (value >= 20)::INT AS is_toxic, round(value / 300, 4) AS confidence_score,
               CASE WHEN value >= 20 THEN 'High risk of hERG liability' ELSE 'Appears safe' END AS warning,
               round(9 - value / 300, 4) AS "predicted_pIC50", 'success' AS status
        FROM events WHERE event_type IN ('click', 'purchase')""",
}

"""Registered queries: curation in batches, vectors encoded once, a stream into two sinks, scans that skip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.text import tokens
from assayloom.learning.encoding import hashed_direction_encoder
from assayloom.learning.vector_store import add_unknown, encode_once
from assayloom.plans.queries_features import bucket_sql, TOKENS_SQL
from assayloom.plans.queries_models import SUMS_SQL
from assayloom.plans.updates import Curated
from assayloom.sources.skipping import build_index, skipping_scan, write_by_neighbourhood
from assayloom.sources.tables import table
from assayloom.staging import fresh_path
from assayloom.streaming.scoring import check_vectors
from assayloom.streaming.sinks import REJECTS, RESPONSES, done_batches, read_sink, run_into_sinks


def _curated(spark: SparkSession, sf: str) -> Curated:
    """Line prices by part, added in three batches by line number; the second batch comes twice."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf, "lineitem").select(*order, "l_extendedprice")
    kept = Curated(spark, fresh_path(spark, "curated"), "l_partkey", "l_extendedprice", ["l_orderkey"], order, "l_partkey", 16)
    parts = [lines.where("l_linenumber <= 2"), lines.where("l_linenumber BETWEEN 3 AND 5"), lines.where("l_linenumber > 5")]
    for number in (0, 1, 1, 2):
        kept.add(parts[number], number)
    return kept


def curated_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The curated rows after all batches: those of one run over everything."""
    rows = _curated(spark, sf).rows()
    return rows.select("l_partkey", "n", F.round("median_l_extendedprice", 6).alias("median_price"), "first_l_orderkey", F.round("y", 6).alias("y"))


def batch_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys after all batches, and whether each is in one split."""
    rows = _curated(spark, sf).split_rows()
    per_key = rows.groupBy("l_partkey").agg(F.count_distinct("split").alias("splits"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.max("splits").alias("most_splits"))


def texts_encoded_once(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sums of whole-numbered directions, in two runs over one store; how many texts the second run had to encode."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    path, encoder = fresh_path(spark, "vectors"), hashed_direction_encoder()
    add_unknown(documents, "text", path, "hashed-4", encoder)
    again = add_unknown(documents, "text", path, "hashed-4", encoder)
    found = encode_once(documents, "text", path, "hashed-4", encoder).withColumn("length", F.size(tokens(F.col("text"))))
    whole = [F.get("features", F.lit(d)).cast("double") * F.col("length") for d in range(4)]
    sums = [F.round(F.coalesce(total, F.lit(0.0))).cast("long").alias(f"s{d}") for d, total in enumerate(whole)]
    return found.select("doc_id", "length", *sums, F.lit(again).cast("long").alias("encoded_again"))


def _checked(batch: DataFrame) -> DataFrame:
    """Vectors of some rows are missing or cut; the check says so."""
    vector = F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return check_vectors(batch.select("vec_id", vector.alias("features")), 64)


def stream_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors from a file stream of several batches into responses and rejects, read back from both sinks."""
    source, path = fresh_path(spark, "arriving"), fresh_path(spark, "sinks")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    vectors.repartition(6, "vec_id").write.parquet(source)
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 2).parquet(source)
    run_into_sinks(stream, _checked, path, fresh_path(spark, "sinks-progress"))
    batches = done_batches(spark, path).count()
    sinks = [read_sink(spark, path, name).withColumn("sink", F.lit(name)) for name in (RESPONSES, REJECTS)]
    found = sinks[0].unionByName(sinks[1])
    return found.select("vec_id", "sink", "status", "error", F.lit(batches > 1).alias("in_batches"))


def skipped_files_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one part and supplier flag from a table of 16 files laid out by part and supplier, with an index of both."""
    path, index = fresh_path(spark, "laid-out"), fresh_path(spark, "file-index")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    write_by_neighbourhood(lines, path, ["l_partkey", "l_suppkey"], 16)
    build_index(spark, path, ["l_partkey", "l_suppkey"], index)
    equals = {"l_partkey": 100, "l_returnflag": "N"}
    return skipping_scan(spark, path, index, equals, ["l_orderkey", "l_linenumber", "l_suppkey"])


QUERIES = {
    "curated_in_batches": curated_in_batches,
    "batch_split_sizes": batch_split_sizes,
    "texts_encoded_once": texts_encoded_once,
    "stream_sinks": stream_sinks,
    "skipped_files_scan": skipped_files_scan,
}

ORACLE = {
    "curated_in_batches": """
        SELECT l_partkey, count(*) AS n, round(median(l_extendedprice), 6) AS median_price,
               arg_min(l_orderkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first_l_orderkey,
               round(9 - log10(median(l_extendedprice) + 1e-10), 6) AS y
        FROM lineitem GROUP BY l_partkey""",
    "batch_split_sizes": "SELECT count(DISTINCT l_partkey) AS keys, 1 AS most_splits FROM lineitem",
    "texts_encoded_once": f"""
        SELECT doc_id, len(ids)::INT AS length, {SUMS_SQL}, 0 AS encoded_again
        FROM (SELECT doc_id, list_transform({TOKENS_SQL}, lambda t: {bucket_sql("t", 4094)} + 2) AS ids FROM documents)""",
    "stream_sinks": """
        SELECT vec_id, CASE WHEN e IS NULL THEN 'responses' ELSE 'rejects' END AS sink,
               CASE WHEN e IS NULL THEN 'success' ELSE 'error' END AS status, e AS error, true AS in_batches
        FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'no vector' WHEN vec_id % 7 = 0 THEN 'wrong vector length' END AS e
              FROM embeddings)""",
    "skipped_files_scan": """
        SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey = 100 AND l_returnflag = 'N'""",
}

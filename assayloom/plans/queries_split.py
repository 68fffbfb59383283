"""Registered queries: group-aware split, group sizes, keyed one-to-one joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import text
from assayloom.operators.alignment import aligned_join, aligned_rows, alignment_report, keep_surviving
from assayloom.operators.similarity import similar_pairs, similarity_groups, similarity_split
from assayloom.operators.split import (
    bundle_splits,
    group_sizes,
    group_split,
    leaked_groups,
    rank_in_size_class,
    split_sizes,
)
from assayloom.plans.queries_features import bits_sql
from assayloom.sinks.files import write_by_split
from assayloom.sources.files import read_vectors
from assayloom.sources.tables import table
from assayloom.staging import fresh_path, stage


def orders_split(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return group_split(orders, "o_custkey", ["o_orderkey"])


def conversations_split(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return group_split(turns, "conv_id", ["conv_id", "turn"])


def orders_without_customers_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of every seventh customer have lost their customer; together they are one group."""
    customer = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey")
    return group_split(table(spark, sf, "orders").select("o_orderkey", customer), "o_custkey", ["o_orderkey"], hot_rows=500)


def orders_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return split_sizes(orders_split(spark, sf))


def orders_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = group_sizes(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"])
    return sizes.select("o_custkey", "size", F.col("first_row").alias("first_order"))


def orders_class_ranks(spark: SparkSession, sf: str) -> DataFrame:
    sizes = group_sizes(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"])
    return rank_in_size_class(sizes, "o_custkey").select("o_custkey", "size", "class_rank")


def orders_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked customers and all customers: the first number has to be zero."""
    split = stage(orders_split(spark, sf), "orders-split")
    leaks = leaked_groups(split, "o_custkey").agg(F.count(F.lit(1)).alias("groups")).withColumn("kind", F.lit("leaked"))
    groups = split.select("o_custkey").distinct().agg(F.count(F.lit(1)).alias("groups"))
    return leaks.unionByName(groups.withColumn("kind", F.lit("all")))


def bundled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The three splits as separate tables, bundled again under their names."""
    split = stage(orders_split(spark, sf), "orders-split")
    train, valid, test = (split.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test"))
    return bundle_splits(train, valid, test)


def validation_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and targets written in one folder per split; only the validation folder is read back."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))
    path = fresh_path(spark, "vectors")
    write_by_split(group_split(vectors, "label", ["vec_id"]), path)
    read = read_vectors(spark, path, "valid")
    return read.select("vec_id", "split", F.size("features").alias("dimensions"), F.col("label").cast("double").alias("y"))


def labels_with_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return aligned_join(table(spark, sf, "labels"), documents, "doc_id")


def labels_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    joined = aligned_rows(table(spark, sf, "labels"), vectors, "doc_id")
    return joined.select("doc_id", "toxic", "label", F.size("embedding").alias("dimensions"), "status")


def vector_alignment(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return alignment_report(table(spark, sf, "labels").select("doc_id"), vectors, "doc_id")


def predictions_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and true values of orders, brought together by key and not by row position."""
    orders = table(spark, sf, "orders")
    predicted = orders.select("o_orderkey", (F.col("o_totalprice") / 500000).alias("y_pred"))
    true = orders.select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y_true"))
    return aligned_join(predicted, true, "o_orderkey")


def surviving_labels(spark: SparkSession, sf: str) -> DataFrame:
    survivors = table(spark, sf, "documents").where(F.col("n_chars") >= 50)
    return keep_surviving(table(spark, sf, "labels"), survivors, "doc_id")


#: Width of the fingerprints that similarity is measured on, so wide that few grams of long texts share a bit, and the threshold.
SIMILARITY_BITS, SIMILARITY = 1 << 20, 0.7


def _document_bits(spark: SparkSession, sf: str) -> DataFrame:
    bits = text.text_fingerprint(F.col("text"), SIMILARITY_BITS)
    return table(spark, sf, "documents").select("doc_id", bits.alias("bits"))


def similar_document_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different fingerprints that are similar, each named by its first document."""
    pairs = similar_pairs(_document_bits(spark, sf), "doc_id", "bits", SIMILARITY)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the first one of its group of similar documents."""
    return similarity_groups(_document_bits(spark, sf), "doc_id", "bits", SIMILARITY)


def similar_documents_split(spark: SparkSession, sf: str) -> DataFrame:
    """Train, valid and test without similar documents in different parts."""
    return similarity_split(_document_bits(spark, sf), "doc_id", "bits", SIMILARITY)


QUERIES = {
    "similar_document_pairs": similar_document_pairs,
    "similar_documents": similar_documents,
    "similar_documents_split": similar_documents_split,
    "orders_split": orders_split,
    "conversations_split": conversations_split,
    "orders_without_customers_split": orders_without_customers_split,
    "orders_split_sizes": orders_split_sizes,
    "orders_group_sizes": orders_group_sizes,
    "orders_class_ranks": orders_class_ranks,
    "orders_leaks": orders_leaks,
    "bundled_orders": bundled_orders,
    "validation_vectors": validation_vectors,
    "labels_with_documents": labels_with_documents,
    "labels_with_vectors": labels_with_vectors,
    "vector_alignment": vector_alignment,
    "predictions_with_ids": predictions_with_ids,
    "surviving_labels": surviving_labels,
}


def split_sql(source: str, group: str, order: str, out: str) -> str:
    """The greedy split as SQL: a recursive walk over size classes, then ranks inside each class."""
    return f"""
        WITH RECURSIVE g AS (
          SELECT {group} AS grp, count(*) AS size, min({order}) AS first_row FROM {source} GROUP BY 1),
        h AS (SELECT size, count(*) AS k, row_number() OVER (ORDER BY size DESC) AS i FROM g GROUP BY size),
        room AS (SELECT count(*) * 8 // 10 AS t, count(*) * 9 // 10 AS tv FROM {source}),
        walk AS (
          SELECT 0::BIGINT AS i, 0::BIGINT AS size, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS tr, 0::BIGINT AS va
          UNION ALL
          SELECT i, size, a, b, (tr + a * size)::BIGINT, (va + b * size)::BIGINT FROM (
            SELECT i, size, a, tr, va, least(k - a, greatest(0, (tv - tr - a * size - va) // size))::BIGINT AS b FROM (
              SELECT h.i, h.size, h.k, w.tr, w.va, room.tv,
                     least(h.k, greatest(0, (room.t - w.tr) // h.size))::BIGINT AS a
              FROM walk w JOIN h ON h.i = w.i + 1, room))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY first_row DESC, grp DESC) AS r FROM g),
        assigned AS (
          SELECT grp, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'valid' ELSE 'test' END AS split
          FROM ranked JOIN walk USING (size))
        {out}"""


_ORDERS_OUT = "SELECT o_orderkey, o_custkey, split FROM orders JOIN assigned ON grp = o_custkey"
_ORDERS_SPLIT = split_sql("orders", "o_custkey", "o_orderkey", _ORDERS_OUT)

# All pairs that share a bit, and groups by walking links to their ends.
_SIMILAR = f"""
        f AS ({bits_sql("documents", "doc_id", SIMILARITY_BITS)}),
        s AS (SELECT bits, min(doc_id) AS rep FROM f GROUP BY bits),
        e AS (SELECT rep, unnest(bits) AS bit FROM s),
        c AS (SELECT x.rep AS a, y.rep AS b, count(*) AS n FROM e x JOIN e y ON x.bit = y.bit AND x.rep < y.rep GROUP BY ALL),
        l AS (SELECT a, b, n / (len(p.bits) + len(q.bits) - n) AS similarity
              FROM c JOIN s p ON p.rep = a JOIN s q ON q.rep = b WHERE n >= {SIMILARITY} * (len(p.bits) + len(q.bits) - n))"""
_GROUPED = f"""{_SIMILAR},
        two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT rep AS node, rep AS root FROM s UNION SELECT two.b, root FROM reach JOIN two ON two.a = node),
        grouped AS (SELECT doc_id, "group" FROM f JOIN s USING (bits)
                    JOIN (SELECT node, min(root) AS "group" FROM reach GROUP BY node) ON node = rep)"""

ORACLE = {
    "similar_document_pairs": f"WITH {_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM l",
    "similar_documents": f"""WITH RECURSIVE {_GROUPED} SELECT doc_id, "group" FROM grouped""",
    "similar_documents_split": f"WITH RECURSIVE {_GROUPED}," + split_sql(
        "grouped", '"group"', "doc_id", 'SELECT doc_id, "group", split FROM grouped JOIN assigned ON grp = "group"'
    ).replace("WITH RECURSIVE", "", 1),
    "orders_split": _ORDERS_SPLIT,
    "conversations_split": split_sql(
        "conversations",
        "conv_id",
        "{'c': conv_id, 't': turn}",
        "SELECT conv_id, turn, split FROM conversations JOIN assigned ON grp = conv_id",
    ),
    "orders_without_customers_split": split_sql(
        "(SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders)",
        "o_custkey",
        "o_orderkey",
        """SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, split
           FROM orders JOIN assigned ON grp IS NOT DISTINCT FROM CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END""",
    ),
    "orders_split_sizes": split_sql(
        "orders",
        "o_custkey",
        "o_orderkey",
        "SELECT split, count(*) AS rows FROM orders JOIN assigned ON grp = o_custkey GROUP BY split",
    ),
    "orders_group_sizes": """
        SELECT o_custkey, count(*) AS size, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey""",
    "orders_class_ranks": """
        SELECT o_custkey, size, row_number() OVER (PARTITION BY size ORDER BY first_row DESC, o_custkey DESC) AS class_rank
        FROM (SELECT o_custkey, count(*) AS size, min(o_orderkey) AS first_row FROM orders GROUP BY o_custkey)""",
    "orders_leaks": """
        SELECT 0 AS groups, 'leaked' AS kind UNION ALL SELECT count(DISTINCT o_custkey) AS groups, 'all' AS kind FROM orders""",
    "bundled_orders": _ORDERS_SPLIT,
    "validation_vectors": split_sql(
        "embeddings",
        "label",
        "vec_id",
        """SELECT vec_id, split, len(embedding)::INT AS dimensions, label::DOUBLE AS y
           FROM embeddings JOIN assigned ON grp = label WHERE split = 'valid'""",
    ),
    "labels_with_documents": "SELECT doc_id, quality, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id)",
    "labels_with_vectors": """
        SELECT coalesce(doc_id, vec_id) AS doc_id, toxic, label, len(embedding)::INT AS dimensions,
               CASE WHEN vec_id IS NULL THEN 'left only' WHEN doc_id IS NULL THEN 'right only' ELSE 'matched' END AS status
        FROM labels FULL JOIN embeddings ON doc_id = vec_id""",
    "vector_alignment": """
        SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS left_only,
               (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS right_only,
               (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1 UNION
                SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1)) AS repeated,
               (SELECT count(*) FROM labels JOIN embeddings ON doc_id = vec_id) AS matched""",
    "predictions_with_ids": """
        SELECT o_orderkey, o_totalprice / 500000 AS y_pred,
               (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS y_true
        FROM orders""",
    "surviving_labels": """
        SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 50)""",
}

"""Registered queries: tables without keys, joined by row position, and matrices exchanged as ``.npy`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.positions import POSITION, joined_by_position, read_side_by_side, read_with_positions
from assayloom.sources.npy import read_npy, write_npy
from assayloom.sources.tables import table
from assayloom.staging import fresh_path


def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line with its place in the file."""
    return read_with_positions(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey"])


def _keyless(spark: SparkSession, sf: str, files: int, *columns: str) -> str:
    """Columns of the orders by key, written to a number of files without the key."""
    path = fresh_path(spark, "keyless")
    ranged = table(spark, sf, "orders").repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey")
    ranged.select(*columns).write.parquet(path)
    return path


def orders_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Prices from five files and priorities from three, brought together row by row."""
    prices = _keyless(spark, sf, 5, "o_totalprice", "o_custkey")
    return read_side_by_side(spark, prices, _keyless(spark, sf, 3, "o_orderpriority"))


def _matrices(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Vectors and targets in two folders of ``.npy`` files, rows by vector id."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"))
    paths = fresh_path(spark, "X"), fresh_path(spark, "y")
    write_npy(vectors, paths[0], "embedding", ["vec_id"], parts=5)
    write_npy(vectors, paths[1], "y", ["vec_id"], parts=3)
    return paths


def matrix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix and the targets read back by several tasks and joined row by row."""
    x, y = _matrices(spark, sf)
    left = read_npy(spark, x, task_bytes=64 << 10).withColumnRenamed("row", POSITION)
    right = read_npy(spark, y, task_bytes=4 << 10).withColumnRenamed("row", POSITION)
    joined = joined_by_position(left, right)
    sums = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.round(v.cast("double"), 6))
    return joined.select(
        POSITION,
        F.size("values").alias("dimensions"),
        F.round(F.col("values")[0].cast("double"), 6).alias("first"),
        F.round(sums, 4).alias("total"),
        F.col("value").alias("y"),
    )


def matrix_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Four columns of the matrix; the rest is read past."""
    found = read_npy(spark, _matrices(spark, sf)[0], columns="0,9:11,63")
    picked = [F.round(F.col("values")[i].cast("double"), 6).alias(f"v{c}") for i, c in enumerate((0, 9, 10, 63))]
    return found.select(F.col("row").alias(POSITION), *picked)


QUERIES = {
    "row_positions": row_positions,
    "orders_side_by_side": orders_side_by_side,
    "matrix_round_trip": matrix_round_trip,
    "matrix_columns": matrix_columns,
}

ORACLE = {
    "row_positions": """
        SELECT row_number() OVER () - 1 AS position, l_orderkey, l_linenumber, l_partkey FROM lineitem""",
    "orders_side_by_side": """
        SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_totalprice, o_custkey, o_orderpriority FROM orders""",
    "matrix_round_trip": """
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, len(embedding)::INT AS dimensions,
               round(embedding[1]::DOUBLE, 6) AS first,
               round(list_sum(list_transform(embedding, lambda v: round(v::DOUBLE, 6))), 4) AS total, label::DOUBLE AS y
        FROM embeddings""",
    "matrix_columns": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, " + ", ".join(
        f"round(embedding[{i + 1}]::DOUBLE, 6) AS v{i}" for i in (0, 9, 10, 63)
    ) + " FROM embeddings",
}

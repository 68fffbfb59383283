"""Connected components of a link table by alternating stars, each round a grouping and a join on the node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(lowest, "u").where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(lowest, "u")
    hung = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node with a link; the root is the smallest node reachable. Links have no direction."""
    a, b = F.col(left), F.col(right)
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stage(edges, "links")
    before, after = None, _mark(edges)
    while before != after:
        edges = stage(_small_star(_large_star(edges)), "stars")
        before, after = after, _mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

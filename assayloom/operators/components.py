"""Connected components of a link table by contraction.

In a round every node points to its smallest neighbour, or to itself if it is smaller; pointers are followed to their ends by doubling,
and the links between the ends are the next round's table. A node that still has links after two rounds has lost half of its
company at least, so the rounds are logarithmic in the nodes of a component, whatever its shape. Each step is a grouping or a join on a
node; nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.staging import stage


def follow(pointers: DataFrame) -> DataFrame:
    """``node, root`` from ``node, up``, where ``up`` is never larger than ``node`` and the end of every way points to itself."""
    while True:
        ahead = pointers.select(F.col("node").alias("up"), F.col("up").alias("_further"))
        jumped = stage(pointers.join(ahead, "up"), "pointers")
        pointers = jumped.select("node", F.col("_further").alias("up"))
        if not jumped.where("_further <> up").limit(1).count():
            return pointers.withColumnRenamed("up", "root")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node with a link to another; the root is the smallest node reachable. Links have no direction.

    Repeated links, links of a node to itself and links with a null end change nothing.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    found: DataFrame | None = None
    while True:
        edges = stage(edges, "links")
        if not edges.limit(1).count():
            if found is None:
                return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return found.select("node", "root")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        ends = follow(stage(pointers, "pointers"))
        # Nodes of earlier rounds go on from where they had come to.
        on = ends.select(F.col("node").alias("root"), F.col("root").alias("_end"))
        if found is None:
            found = ends
        else:
            found = found.join(on, "root", "left").select("node", F.coalesce("_end", "root").alias("root"))
        found = stage(found, "components")
        for side in ("a", "b"):
            edges = edges.join(ends.withColumnsRenamed({"node": side, "root": f"_{side}"}), side)
        edges = edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct()

"""Connected components by alternating large-star and small-star steps, logarithmic in the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (node, near). Large: neighbours above a node join the least of it and its neighbours; small: those below."""
    both = edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near")))
    seen = both if large else both.filter("near < node")
    least = seen.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
    moved = seen.filter("near > node" if large else "near < node").join(least.hint("merge"), "node").select(F.col("near").alias("node"), F.col("least").alias("near"))
    if not large:
        moved = moved.unionByName(least.select("node", F.col("least").alias("near")))
    return moved.filter("node <> near").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (node, near): root is the least node of its component."""
    edges = settle(edges.filter("node <> near").distinct(), "components")
    state = None
    while True:
        edges = settle(_star(_star(edges, True), False), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "near").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select("node", F.col("near").alias("root")).unionByName(edges.select(F.col("near").alias("node"), F.col("near").alias("root")).distinct())

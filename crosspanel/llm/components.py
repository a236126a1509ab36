"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node (large: the greater ones; small: the lesser ones) on its least neighbour.

    The least neighbour is an aggregate that is combined before the shuffle, and the neighbours are joined to it, so
    that the neighbours of a hub are never collected.
    """
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = sides.join(least, "a")
    if large:
        out = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): for each node of an edge the smallest node of its component."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # Done when every node hangs on one lesser node that itself hangs on none.
        many = edges.groupBy("a").count().filter("count > 1").limit(1)
        chain = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1)
        if many.unionByName(chain.select("a", F.lit(2).cast("long").alias("count"))).isEmpty():
            break
        edges = checkpoint(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

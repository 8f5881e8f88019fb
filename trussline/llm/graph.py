"""Connected components of large graphs by alternating star operations, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node with an edge; `edges` has two columns of one type.

    Each round halves paths at least, so rounds grow with the logarithm of the longest path. Self-loops, repeats and
    nulls are allowed and add nothing. Hubs only ever meet in a minimum, which is pre-aggregated, and in joins that
    adaptive execution can split."""
    x, y = edges.columns[:2]
    edges = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges, seen = cut(edges), None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(20)")), F.sum(F.hash("b", "a").cast("decimal(20)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(state)

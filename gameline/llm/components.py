"""Connected components of a graph given as pairs of longs, by alternating star contractions.

A round points every larger neighbour of a node to the node's smallest neighbour, then every smaller
one.  Rounds grow with the logarithm of the graph, a node's neighbours are only ever aggregated, never
listed, and each round is written to the shared folder; so are the smallest neighbours, which lets Spark
split the join of a node that a large part of the edges meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gameline.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; neighbours above a node move to its smallest neighbour."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "components-low")
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down; a node and its lower neighbours move to the lowest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = stored(down.groupBy("u").agg(F.min("v").alias("low")), "components-low")
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", "low").toDF("u", "v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge (u, v) with the smallest node of its component."""
    state = stored(edges.select("u", "v").where("u != v").distinct(), "components")
    mark = None
    while True:
        state = stored(_small_star(stored(_large_star(state), "components")), "components")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of a graph of links, by large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round: a node's neighbours move to the smallest node in sight.

    large: neighbours above a node are tied to its smallest neighbour; small: those below and the node itself are.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    if small:
        half = edges.select(high.alias("u"), low.alias("v"))
    else:
        half = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # the smallest neighbour by a combining aggregate and a join, so that a hub's neighbours never meet in one group
    least = half.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = half.join(least, "u")
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b); longs without nulls.

    Each round is written to the shared folder. It ends when every node hangs on its root directly.
    """
    now = materialize(edges.filter("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        # a forest of stars: no root is tied to another node, and each node to one root only
        if now.select("a").intersect(now.select("b")).isEmpty() and now.groupBy("a").count().filter("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).filter("node > root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = materialize(_star(_star(now, False), True), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

"""Independent blocks: connected components of rows that share keys, for folds that mustn't cross them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import written


def blocks(rows: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """rows(node) and edges(a, b) -> node, block: the smallest node that edges reach. Every node has one.

    Labels travel along edges and jump over their own label's label, so that chains halve each round; each round is
    written. The labels of all neighbours are combined in tasks before they are shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "block-edges")
    labels = written(rows.select("node", F.col("node").alias("block")), "blocks")
    if both.isEmpty():
        return labels
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("block").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left").select("node", "block", F.least("block", F.coalesce("near", "block")).alias("least"))
        jump = labels.select(F.col("node").alias("j"), F.col("block").alias("next"))
        now = least.join(jump, least["least"] == jump["j"], "left").select("node", F.col("block").alias("was"), F.least("least", F.coalesce("next", "least")).alias("block"))
        now = written(now, "blocks")
        labels = now.select("node", "block")
        if now.filter("was <> block").isEmpty():
            return labels
    raise RuntimeError(f"blocks did not settle in {most_rounds} rounds")

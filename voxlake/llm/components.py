"""Connected components of a graph given as two tables, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_group, written

#: Rows that one task may well join; only larger graphs can have a hub or a component that is too much for one.
PLAIN = 1_000_000


def components(links: DataFrame, plain: int = PLAIN) -> DataFrame:
    """(node, root) of every node of `links` (a, b): root is the smallest node that it is connected with.

    Each round gives every node the least label of itself and its neighbours, then the label of that label,
    so the rounds grow with the logarithm of the longest chain. In graphs of more than `plain` rows, nodes with
    very many links and labels that very many nodes have are broadcast (`with_group`), so neither a hub nor a
    large component is one task. Nothing is collected but whether a label changed; each round is written to the
    shared folder. Loops and repeated links do no harm. No links give no rows.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rows = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"), F.count(F.lit(1)).alias("links")))
    nodes = labels.count()

    def met(own: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
        return own.join(groups.drop(size), key) if total <= plain else with_group(own, written(groups), key, size, total)

    while nodes:
        near = met(both, labels.select(F.col("node").alias("b"), F.col("root").alias("near"), F.col("links").alias("n")), "b", "n", rows)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = written(labels.join(near, "node").select("node", "links", F.col("root").alias("was"), F.least("root", "near").alias("low")))
        jump = lower.groupBy("low").agg(F.count(F.lit(1)).alias("n")).join(lower.select(F.col("node").alias("low"), F.col("low").alias("far")), "low")
        new = written(met(lower, jump, "low", "n", nodes).select("node", "links", "was", F.least("low", "far").alias("root")))
        labels = new.drop("was")
        if new.where("root <> was").isEmpty():
            break
    return labels.select("node", "root")

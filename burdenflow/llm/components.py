"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.store import keep, release


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the edges a, b.

    Each round gives a node the smallest root among its neighbours and itself, then that root's own root, so the
    number of rounds grows with the logarithm of the longest path. Every round is a table in the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = keep(both.union(both.select("other", "node")).filter("node != other").distinct(), "component-edges")
    roots = keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "component-roots")
    while True:
        heard = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("heard")), "other")
        heard = heard.groupBy("node").agg(F.min("heard").alias("heard"))
        nearer = roots.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        nearer = keep(nearer, "component-near")
        hop = nearer.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = keep(nearer.join(hop, "root").select("node", "was", F.col("next").alias("root")), "component-roots")
        done = jumped.filter("was != root").isEmpty()
        release(nearer)
        release(roots)
        roots = jumped.drop("was")
        if done:
            return roots

"""Connected components of an edge list, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges`` (a, b).

    Each round lets every node take the smallest label around it and then the label of that
    label (pointer jumping), so the rounds grow with the logarithm of the longest chain.  Labels
    and edges are written to the shared folder each round; only a count comes to the driver.
    Edges whose ends have one label are left out of later rounds, and the rest are rewritten to
    labels, so a large group shrinks to its representatives instead of being read again.
    """
    live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = None
    while live.head(1):
        # The smallest neighbour of each node that isn't smaller than the node itself.
        step = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        roots = live.select(F.col("a").alias("node")).join(step, "node", "left_anti").distinct().withColumn("to", F.col("node"))
        chain = cut(step.unionByName(roots), name)
        while True:
            up = chain.select(F.col("node").alias("to"), F.col("to").alias("above"))
            jumped = cut(chain.join(up, "to").select("node", F.col("above").alias("to"), (F.col("above") != F.col("to")).alias("moved")), name)
            chain = jumped.select("node", "to")
            if not jumped.filter("moved").head(1):
                break
        if labels is None:
            labels = chain
        else:
            old = labels.join(chain.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left")
            labels = cut(old.select("node", F.coalesce("root", "to").alias("to")), name)
        ends = live.join(chain.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(chain.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        live = cut(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("to").alias("component"))

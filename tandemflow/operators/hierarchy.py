"""Parent-child trees: closure, leaves, roll-ups, marks inherited from ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialised


def closure(edges: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """(ancestor, descendant, depth) of all pairs, at their least depth; cycles end.

    Each round extends the paths found last by one edge. A level's rows are distributed like any
    join; only whether a level has rows comes to the driver.
    """
    step = edges.select(F.col(parent).alias("mid"), F.col(child).alias("to")).distinct()
    found = frontier = step.select(F.col("mid").alias("ancestor"), F.col("to").alias("descendant"), F.lit(1).alias("depth"))
    depth = 1
    while True:
        depth += 1
        longer = frontier.select("ancestor", F.col("descendant").alias("mid")).join(step, "mid").select("ancestor", F.col("to").alias("descendant")).distinct()
        new = longer.join(found.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialised(new, "closure")
        if not frontier.head(1):
            return found
        found = found.unionByName(frontier)


def leaves(edges: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """(child) of nodes that are nobody's parent."""
    return edges.select(child).distinct().join(edges.select(F.col(parent).alias(child)).distinct(), child, "left_anti")


def roll_up(closed: DataFrame, facts: DataFrame, leaf: str, key: list[str]) -> DataFrame:
    """(ancestor, key, n): facts of the leaves counted for every ancestor.

    Facts are counted by leaf before they are joined to ancestors.
    """
    counted = facts.groupBy(leaf, *key).agg(F.count("*").alias("n"))
    return closed.join(counted, closed["descendant"] == counted[leaf]).groupBy("ancestor", *key).agg(F.sum("n").alias("n"))


def nearest_marked(closed: DataFrame, marks: DataFrame, node: str = "node") -> DataFrame:
    """(node, mark): each node's own mark, or that of its nearest marked ancestor. marks: (node, mark)."""
    own = marks.select(F.col(node).alias("descendant"), F.col(node).alias("holder"), "mark", F.lit(0).alias("depth"))
    above = closed.join(marks.select(F.col(node).alias("ancestor"), "mark"), "ancestor").select("descendant", F.col("ancestor").alias("holder"), "mark", "depth")
    picked = own.unionByName(above).groupBy("descendant").agg(F.min_by(F.struct("holder", "mark"), F.struct("depth", "holder")).alias("m"))
    return picked.select(F.col("descendant").alias("node"), F.col("m.holder").alias("holder"), F.col("m.mark").alias("mark"))

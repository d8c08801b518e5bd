"""Spectral counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted(links: DataFrame) -> DataFrame:
    """(protein_id, basic, specific, weighted) counts. links: (protein_id, peptide_id, n).

    A shared peptide's matches go to its proteins in proportion to their specific matches; a
    peptide none of whose proteins has any is shared equally.
    """
    holders = links.groupBy("peptide_id").agg(F.count("*").alias("holders"))
    marked = links.join(holders, "peptide_id")
    own = marked.groupBy("protein_id").agg(F.sum(F.when(F.col("holders") == 1, F.col("n")).otherwise(0)).alias("specific"), F.sum("n").alias("basic"))
    joined = marked.join(own, "protein_id")
    totals = joined.groupBy("peptide_id").agg(F.sum("specific").alias("all_specific"))
    weight = F.when(F.col("all_specific") > 0, F.col("specific") / F.col("all_specific")).otherwise(1 / F.col("holders"))
    shares = joined.join(totals, "peptide_id").withColumn("share", weight * F.col("n"))
    return shares.groupBy("protein_id").agg(F.max("basic").alias("basic"), F.max("specific").alias("specific"), F.sum("share").alias("weighted"))


def by_channel(psms: DataFrame, keys: list[str]) -> DataFrame:
    return psms.groupBy(*keys).agg(F.count("*").alias("n"))

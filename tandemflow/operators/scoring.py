"""Scores of groups of matches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = "decimal(18,5)"


def exact_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(c.cast(_EXACT)).cast("double")


def standard(best: DataFrame, key: str) -> DataFrame:
    """Sum of the best scores."""
    return best.groupBy(key).agg(exact_sum(F.col("score")).alias("set_score"), F.count("*").alias("n_items"))


def mudpit(best: DataFrame, key: str, threshold: str = "threshold") -> DataFrame:
    """Sum of what scores are above their thresholds, and the mean of those thresholds; 0 without any."""
    above = F.col("score") > F.col(threshold)
    excess = exact_sum(F.when(above, F.col("score") - F.col(threshold)))
    mean = exact_sum(F.when(above, F.col(threshold))) / F.count_if(above)
    return best.groupBy(key).agg(F.coalesce(excess + mean, F.lit(0.0)).alias("set_score"))


def modified_mudpit(best: DataFrame, key: str, threshold: str = "threshold", offset: float = 0.0) -> DataFrame:
    """Sum of what scores are above their thresholds less an offset."""
    excess = F.col("score") - F.col(threshold) + offset
    return best.groupBy(key).agg(F.coalesce(exact_sum(F.when(excess > 0, excess)), F.lit(0.0)).alias("set_score"))


def fisher(best: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Fisher's combination of the n best p-values, at the n that gives the best score.

    With an even number of degrees of freedom the chi-squared tail is a finite series, summed by a
    fold over the sorted scores of one group, which a set of items keeps small.
    """
    scores = F.sort_array(F.collect_list(F.col(score)), False)
    to_log = math.log(10) / 10

    def tail(c: Column, n: Column) -> Column:
        """-10 log10 of exp(-c) times the sum of c^k / k! for k < n."""
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        series = F.aggregate(
            F.slice(F.sequence(F.lit(0), n), 2, n - 1),
            start,
            lambda acc, k: F.struct((acc["term"] * c / k).alias("term"), (acc["sum"] + acc["term"] * c / k).alias("sum")),
            lambda acc: acc["sum"],
        )
        return (c - F.log(series)) / to_log

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c"), F.lit(0.0).alias("best"))

    def step(acc: Column, s: Column) -> Column:
        n, c = acc["n"] + 1, acc["c"] + s * to_log
        return F.struct(n.alias("n"), c.alias("c"), F.greatest(acc["best"], tail(c, n)).alias("best"))

    return best.groupBy(key).agg(F.aggregate(scores, start, step, lambda acc: acc["best"]).alias("set_score"))


def sidak(psms: DataFrame, key: str, score: str = "score") -> DataFrame:
    """p of the best of n matches, 1 - (1 - p)^n, and its score; exact for tiny p."""
    p = F.pow(F.lit(1e1), F.max(score) / -1e1)
    combined = -F.expm1(F.count("*") * F.log1p(-p))
    return psms.groupBy(key).agg(F.count("*").alias("n"), combined.alias("p_value")).withColumn("instance_score", -1e1 * F.log10("p_value"))

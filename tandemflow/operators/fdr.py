"""False-discovery rates: target/decoy counting, ROC curves, Benjamini-Hochberg, thresholds."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import binned, running, running_min
from .storage import materialised


def estimate(target: Column, decoy: Column, method: str = "two_fold", ratio: float = 1.0) -> Column:
    """FDR in percent. two_fold: 2D / (T + D); plain: D / T; corrected: (D + 1) / (ratio T)."""
    t, d = target.cast("double"), decoy.cast("double")
    if method == "two_fold":
        return F.when(t + d > 0, 2e2 * d / (t + d))
    if method == "plain":
        return F.when(t > 0, 1e2 * d / t)
    if method == "corrected":
        return F.when(t > 0, 1e2 * (d + 1) / (ratio * t))
    raise ValueError(method)


def counts(df: DataFrame, keys: list[str], valid: Column | None = None) -> DataFrame:
    """Targets and decoys of each key."""
    valid = F.lit(True) if valid is None else valid
    return df.groupBy(*keys).agg(F.count_if(valid & ~F.col("is_decoy")).alias("target"), F.count_if(valid & F.col("is_decoy")).alias("decoy"))


def roc(df: DataFrame, keys: list[str], threshold: str = "threshold", method: str = "two_fold") -> DataFrame:
    """For each distinct threshold, best first: targets and decoys at or above it and their FDR.

    Rows are counted by threshold before anything is ordered; the running sums are made in bins of
    the threshold's range.
    """
    by_threshold = df.groupBy(*keys, threshold).agg(F.count_if(~F.col("is_decoy")).alias("t"), F.count_if("is_decoy").alias("d"))
    out = running(by_threshold, threshold, {"target": F.col("t"), "decoy": F.col("d")}, keys)
    return out.withColumn("fdr", estimate(F.col("target"), F.col("decoy"), method)).drop("t", "d")


def roc_edges(curve: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    """(keys, threshold, target, decoy) of the points where the decoy count differs from that before or after, per key.

    Counts don't fall along the curve, so the points of a decoy count lie together, and only its first and its
    last can have another count beside them: an aggregation by count, no ordering.
    """
    high, low = F.max(threshold).alias("high"), F.min(threshold).alias("low")
    of_count = materialised(curve.groupBy(*keys, "decoy").agg(high, low, F.min("target").alias("t_high"), F.max("target").alias("t_low")), "roc-edges")
    whole = of_count.groupBy(*keys).agg(F.min("decoy").alias("fewest"), F.max("decoy").alias("most"))
    joined = of_count.join(whole, keys) if keys else of_count.crossJoin(F.broadcast(whole))  # one row
    first, last, alone = F.col("decoy") != F.col("fewest"), F.col("decoy") != F.col("most"), F.col("high") == F.col("low")
    at = lambda c, t: F.struct(F.col(c).alias(threshold), F.col(t).alias("target"))
    ends = F.array(F.when(first | (alone & last), at("high", "t_high")), F.when(~alone & last, at("low", "t_low")))
    return joined.select(*keys, F.explode(ends).alias("p"), "decoy").filter("p IS NOT NULL").select(*keys, "p.*", "decoy")


def roc_min(curve: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    """Points whose FDR is below that of every worse threshold."""
    out = running_min(curve, threshold, "fdr", "_worse", keys, descending=False, inclusive=False)
    return out.filter(F.col("_worse").isNull() | (F.col("fdr") < F.col("_worse"))).drop("_worse")


def at_expected(curve: DataFrame, keys: list[str], expected: float) -> DataFrame:
    """The point to use for an expected FDR.

    Of the points from 0.95 times the expected up to below it, that with most targets; without
    any, the nearest below, and without any of those the nearest of all.
    """
    near = (F.col("fdr") >= 0.95 * expected) & (F.col("fdr") < expected)
    tier = F.when(near, 0).when(F.col("fdr") < expected, 1).otherwise(2)
    worth = F.when(tier == 0, -F.col("target").cast("double")).otherwise(F.abs(F.col("fdr") - expected))
    rest = [c for c in curve.columns if c not in keys]
    best = curve.filter("fdr IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(tier.alias("a"), worth.alias("b"), F.col("threshold").alias("c"))).alias("p"))
    return best.select(*keys, "p.*")


def bh_adjust(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, score, n, adjusted): Benjamini-Hochberg of p = 10^(-score / 10) for each distinct score.

    The smallest m p / rank over all worse or equal p-values; ties share their last rank. Not clamped at 1.
    """
    groups = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n"))
    total = groups.groupBy(*keys).agg(F.sum("n").alias("m"))
    ranked = running(groups, score, {"rank": F.col("n")}, keys)
    ranked = ranked.join(total, keys) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    raw = ranked.withColumn("_raw", F.col("m") / F.col("rank") * F.pow(F.lit(1e1), F.col(score) / -1e1))
    return running_min(raw, score, "_raw", "adjusted", keys, descending=False).select(*keys, score, "n", "adjusted")


def competition(df: DataFrame, least: float, key: str = "query_id") -> DataFrame:
    """One row: queries where the target, or the decoy, is best, and those with one side only at or above a score."""
    sides = df.groupBy(key).agg(F.max(F.when(~F.col("is_decoy"), F.col("score"))).alias("t"), F.max(F.when(F.col("is_decoy"), F.col("score"))).alias("d"))
    t_on, d_on = F.coalesce(F.col("t") >= least, F.lit(False)), F.coalesce(F.col("d") >= least, F.lit(False))
    t_best = F.col("d").isNull() | (F.col("t") >= F.col("d"))
    return sides.agg(
        F.count_if(t_on & d_on & t_best).alias("target_better"),
        F.count_if(t_on & d_on & ~t_best).alias("decoy_better"),
        F.count_if(t_on & F.col("d").isNotNull() & ~d_on).alias("target_over"),
        F.count_if(d_on & F.col("t").isNotNull() & ~t_on).alias("decoy_over"),
        F.count_if(t_on & F.col("d").isNull()).alias("target_only"),
        F.count_if(d_on & F.col("t").isNull()).alias("decoy_only"),
    )


def two_rules(df: DataFrame, key: str, one_at: float, many_at: float) -> DataFrame:
    """Groups with a match at the first threshold, or two or more at the second."""
    n_one, n_many = F.count_if(F.col("score") >= one_at), F.count_if(F.col("score") >= many_at)
    return df.groupBy(key).agg(n_one.alias("n_one"), n_many.alias("n_many")).withColumn("is_validated", (F.col("n_one") >= 1) | (F.col("n_many") >= 2))


def set_rules(sets: DataFrame, single_at: float, multi_at: float) -> DataFrame:
    """Sets (n_items, score) above the threshold of single- or of multi-item sets."""
    return sets.withColumn("is_validated", F.when(F.col("n_items") == 1, F.col("score") >= single_at).otherwise(F.col("score") >= multi_at))


def optimal_set_rules(sets: DataFrame, expected: float, method: str = "two_fold") -> DataFrame:
    """(multi_at, single_at, target, decoy, fdr): the threshold pair with most targets within the expected FDR.

    All distinct thresholds of both curves are tried.  The FDR's bound is linear in the counts, so
    a pair is within it if the margins of its two points add up to enough: for each multi-item
    point, the best single-item point of enough margin is a running best in the order of margins.
    """
    kind = F.when(F.col("n_items") == 1, "single").otherwise("multi")
    curve = roc(sets.filter("score IS NOT NULL").withColumn("kind", kind), ["kind"], "score", method)
    # In whole numbers, so that points on the bound are told exactly.
    share = Fraction(str(expected)).limit_denominator(10**6)
    decoys = 200 * share.denominator - share.numerator if method == "two_fold" else 100 * share.denominator
    enough = 100 * share.denominator if method == "corrected" else 0
    margin = F.col("target") * share.numerator - F.col("decoy") * decoys
    is_single = F.col("kind") == "single"
    points = curve.select("kind", "score", "target", "decoy", F.when(is_single, margin).otherwise(enough - margin).alias("margin"))
    by_margin = points.groupBy("margin").agg(F.min(F.when(is_single, F.struct((-F.col("target")).alias("t"), "decoy", "score"))).alias("single"))
    best = running_min(binned(by_margin, "margin", []), "margin", "single", "best", [], descending=True)
    pairs = points.filter(~is_single).join(best.filter("best IS NOT NULL").select("margin", "best"), "margin")
    both = pairs.select(F.col("score").alias("multi_at"), F.col("best.score").alias("single_at"), (F.col("target") - F.col("best.t")).alias("target"), (F.col("decoy") + F.col("best.decoy")).alias("decoy"))
    scored = both.withColumn("fdr", estimate(F.col("target"), F.col("decoy"), method)).filter(F.col("fdr") <= expected)
    return scored.orderBy(F.col("target").desc(), "fdr", "multi_at", "single_at").limit(1)

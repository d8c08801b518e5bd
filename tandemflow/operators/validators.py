"""Validators: filters, rules and thresholds applied to matches, instances and sets, and what they leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fdr, hierarchy
from .filters import flag
from .running import binned, running, running_min
from .storage import materialised


def benjamini_hochberg(df: DataFrame, most: float, keys: list[str], score: str = "score", **how) -> DataFrame:
    """Flags rows whose adjusted p-value, of p = 10^(-score / 10), is at most ``most``.

    keys tell apart what is adjusted on its own (targets and decoys); none for sets, which are adjusted together.
    """
    adjusted = fdr.bh_adjust(df.select(*keys, score), keys, score).select(*keys, score, "adjusted")
    return flag(df.join(adjusted, [*keys, score], "left"), F.col("adjusted") <= most, **how).drop("adjusted")


def outcome(df: DataFrame, method: str = "two_fold", status: str = "is_validated") -> DataFrame:
    """One row: target, decoy and their FDR among the rows that are valid."""
    n = fdr.counts(df, [], F.coalesce(F.col(status), F.lit(False)))
    return n.withColumn("fdr", fdr.estimate(F.col("target"), F.col("decoy"), method))


#: Validator of sets -> function(sets, threshold): sets with is_decoy, score and n_items.
SET_VALIDATORS: dict[str, Callable[..., DataFrame]] = {
    "basic": lambda sets, filters: _all_of(sets, filters),
    "bh": lambda sets, most: benjamini_hochberg(sets, most, []),
    "two_rules": lambda sets, thresholds: fdr.set_rules(sets, *thresholds),
}


def _all_of(df: DataFrame, filters: list[Column]) -> DataFrame:
    for keep in filters:
        df = flag(df, keep)
    return df


def propagated(psms: DataFrame, thresholds: DataFrame, edges: DataFrame, leaf: str = "leaf", score: str = "score") -> DataFrame:
    """``psms`` with is_validated by the threshold that was found for their leaf or its nearest ancestor with one.

    thresholds: (node, threshold). Leaves below no node with a threshold have no valid match.
    """
    marks = hierarchy.nearest_marked(hierarchy.closure(edges), thresholds.select("node", F.col("threshold").alias("mark")))
    joined = psms.join(marks.select(F.col("node").alias(leaf), F.col("mark").alias("_at")), leaf, "left")
    return flag(joined, F.col(score) >= F.col("_at")).drop("_at")


def _states(sets: DataFrame, before: DataFrame, method: str, most: float) -> DataFrame:
    """(threshold, strict, target, decoy, fdr): the points passed from the best set down until the FDR exceeds ``most``.

    A target set's own score is a threshold; a decoy set's threshold is just above its score (strict).
    before: one row of the target and decoy sets that are valid already.
    """
    counted = materialised(sets.groupBy("score").agg(F.count_if(~F.col("is_decoy")).alias("t"), F.count_if("is_decoy").alias("d")), "rule-counts")
    curve = running(counted, "score", {"target": F.col("t"), "decoy": F.col("d")}, []).crossJoin(F.broadcast(before))  # one row
    at = F.col("t0") + F.col("target"), F.col("d0") + F.col("decoy")
    above = at[0] - F.col("t"), at[1] - F.col("d")
    curve = curve.select(
        "score",
        F.when((F.col("t") > 0) & (at[0] > 0), F.struct(at[0].alias("target"), at[1].alias("decoy"), fdr.estimate(*at, method).alias("fdr"))).alias("upto"),
        F.when((F.col("d") > 0) & (above[0] > 0), F.struct(above[0].alias("target"), above[1].alias("decoy"), fdr.estimate(*above, method).alias("fdr"))).alias("above"),
    )
    curve = materialised(curve, "rule-curve")
    worst = -F.greatest(F.coalesce("above.fdr", F.lit(0.0)), F.coalesce("upto.fdr", F.lit(0.0)))
    passed = running_min(binned(curve.withColumn("_worst", worst), "score", []), "score", "_worst", "_earlier", [], descending=True, inclusive=False)
    earlier = -F.coalesce("_earlier", F.lit(0.0))
    first = F.greatest(earlier, F.coalesce("above.fdr", F.lit(0.0)))
    points = F.array(
        F.when(first <= most, F.struct(F.lit(True).alias("strict"), F.col("above").alias("p"))),
        F.when(F.greatest(first, F.coalesce("upto.fdr", F.lit(0.0))) <= most, F.struct(F.lit(False).alias("strict"), F.col("upto").alias("p"))),
    )
    each = passed.select(F.col("score").alias("threshold"), F.explode(points).alias("x")).filter("x.p.fdr IS NOT NULL")
    return materialised(each.select("threshold", "x.strict", "x.p.*"), "rule-points")


def _chosen(points: DataFrame, expected: float) -> DataFrame:
    """One row: of the points within 5 % of the FDR nearest to the expected one, that with most targets."""
    nearest = points.agg(F.min_by("fdr", F.struct(F.abs(F.col("fdr") - expected).alias("a"), F.col("fdr").alias("b"))).alias("nearest"))
    close = points.crossJoin(F.broadcast(nearest)).filter(F.abs(F.col("fdr") - F.col("nearest")) <= F.col("nearest") * 0.05)  # one row
    order = F.struct((-F.col("target")).alias("a"), F.col("decoy").alias("b"), (-F.col("threshold")).alias("c"), (~F.col("strict")).alias("d"))
    return close.agg(F.min_by(F.struct("threshold", "strict", "target", "decoy", "fdr"), order).alias("p"))


def sequential_set_rules(sets: DataFrame, expected: float, method: str = "two_fold", most: float = 50.0) -> DataFrame:
    """(rule, threshold, strict, target, decoy, fdr): first sets of several items, then single ones with those left over.

    The second rule's FDR counts what the first has made valid as well. A set is valid at or above its rule's threshold,
    or above it if that is strict; a rule without a point leaves all its sets invalid, and has no row.
    sets: (n_items, score, is_decoy).
    """
    sets = materialised(sets.filter("score IS NOT NULL").select("n_items", "score", "is_decoy"), "rule-sets")
    none = sets.limit(0).agg(F.count("*").alias("t0"), F.count("*").alias("d0"))
    many = materialised(_chosen(_states(sets.filter("n_items > 1"), none, method, most), expected), "rule-several")
    valid = (F.col("score") > F.col("p.threshold")) | ((F.col("score") == F.col("p.threshold")) & ~F.col("p.strict"))
    judged = sets.crossJoin(F.broadcast(many)).withColumn("ok", (F.col("n_items") > 1) & F.coalesce(valid, F.lit(False)))  # one row
    judged = materialised(judged, "rule-judged")
    before = judged.filter("ok").agg(F.count_if(~F.col("is_decoy")).alias("t0"), F.count_if("is_decoy").alias("d0"))
    rest = _chosen(_states(judged.filter("NOT ok").select("score", "is_decoy"), before, method, most), expected)
    both = many.select(F.lit("several").alias("rule"), "p").unionByName(rest.select(F.lit("remaining").alias("rule"), "p"))
    return both.filter("p IS NOT NULL").select("rule", "p.*")


def match_rules(psms: DataFrame, key: str, expected: float, steps: list[float], method: str = "two_fold") -> DataFrame:
    """(one_at, many_at, target, decoy, fdr): thresholds of "one match, or two" for groups, by all pairs of ``steps``.

    Of the pairs whose FDR is within the expected one, that with most valid target groups. steps: a bounded
    list of thresholds; what a group reaches is counted once, then summed over steps. psms: (key, is_decoy, score).
    """
    nth = F.row_number().over(Window.partitionBy(key, "is_decoy").orderBy(F.col("score").desc()))
    top = psms.select(key, "is_decoy", "score").withColumn("nth", nth).filter("nth <= 2")
    top = top.groupBy(key, "is_decoy").agg(F.max("score").alias("s1"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("s2"))
    ordered = F.array(*map(F.lit, sorted(steps)))
    reached = lambda c: F.size(F.filter(ordered, lambda x: F.coalesce(x <= c, F.lit(False))))  # noqa: E731  steps at or below a score
    cells = top.groupBy("is_decoy", reached(F.col("s1")).alias("a"), reached(F.col("s2")).alias("b")).agg(F.count("*").alias("n"))
    pairs = cells.select("is_decoy", "a", "b", "n", F.explode(F.sequence(F.lit(1), F.lit(len(steps)))).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(steps)))).alias("j"))
    valid = pairs.filter((F.col("a") >= F.col("i")) | (F.col("b") >= F.col("j"))).filter("j <= i").groupBy("i", "j")
    n = valid.agg(F.coalesce(F.sum(F.when(~F.col("is_decoy"), F.col("n"))), F.lit(0)).alias("target"), F.coalesce(F.sum(F.when(F.col("is_decoy"), F.col("n"))), F.lit(0)).alias("decoy"))
    scored = n.select(ordered[F.col("i") - 1].alias("one_at"), ordered[F.col("j") - 1].alias("many_at"), "target", "decoy").withColumn("fdr", fdr.estimate(F.col("target"), F.col("decoy"), method))
    return scored.filter(F.col("fdr") <= expected).orderBy(F.col("target").desc(), "fdr", "one_at", "many_at").limit(1)

"""Joins on nearness: boxes in two dimensions, intervals, nearest in time.

A range is cut to buckets as wide as the tolerance.  One side is read in its own bucket, the other
in its own and both neighbours, so each pair meets once and the rest is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Least width of a bucket of time in seconds, so that a row whose duration is long touches few.
TIME_WIDTH = 3600.0

#: Buckets of intervals in one width.
FINE = 8


def near_buckets(value: Column, width: float) -> Column:
    """The bucket and its neighbours."""
    at = F.floor(value / width)
    return F.explode(F.array(at - 1, at, at + 1))


def boxes(left: DataFrame, right: DataFrame, keys: list[str], mz_tolerance: float, time_tolerance: float, ppm: bool = False, max_mz: float = 5000.0) -> DataFrame:
    """Pairs (l_ and r_ columns) of equal keys, |dm/z| < tolerance and |dt| < the shorter duration + tolerance.

    keys: all that must be equal; leave the charge out to tolerate other charges.  Left rows are read in each
    bucket of time that they reach, so few pairs are looked at that aren't near in both.
    """
    width = max_mz * mz_tolerance / 1e6 if ppm else mz_tolerance
    span = max(time_tolerance, TIME_WIDTH)
    longest = right.agg(F.max("duration").alias("_longest"))
    reach = F.least("l_duration", "_longest") + time_tolerance + span / 1000  # a little more, for the rounding of times
    touched = F.explode(F.sequence(F.floor((F.col("l_t") - reach) / span), F.floor((F.col("l_t") + reach) / span)))
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).crossJoin(F.broadcast(longest))  # one row
    a = a.withColumn("_time", touched).drop("_longest").withColumn("_bucket", near_buckets(F.col("l_mz"), width))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumns({"_time": F.floor(F.col("r_t") / span), "_bucket": F.floor(F.col("r_mz") / width)})
    within = F.col("l_mz") * mz_tolerance / 1e6 if ppm else F.lit(mz_tolerance)
    on = (a["_bucket"] == b["_bucket"]) & (a["_time"] == b["_time"]) & (F.abs(F.col("l_mz") - F.col("r_mz")) < within)
    on &= F.abs(F.col("l_t") - F.col("r_t")) < F.least("l_duration", "r_duration") + time_tolerance
    for k in keys:
        on &= F.col(f"l_{k}") == F.col(f"r_{k}")
    return a.join(b, on).drop("_bucket", "_time")


def unique_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose both sides are in one pair only."""
    once = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n")).filter("n = 1").select(c)
    return pairs.join(once(left), left, "left_semi").join(once(right), right, "left_semi")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, within: float, tie: str) -> DataFrame:
    """Each left row with the right row of equal keys nearest in ``at``, no farther than ``within``.

    left and right share only the keys; the tie goes to the smaller ``tie``.  No pairs are made: both sides stand in one
    order in each bucket, where a left row's nearest is the last right row before it or the first after it.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    right_columns = [c for c in right.columns if c not in keys]
    once = right.filter(finite(right_at)).groupBy(*keys, right_at).agg(F.min_by(F.struct(*right_columns), tie).alias("_r"))
    b = once.select(*keys, near_buckets(F.col(right_at), within).alias("_bucket"), F.col(right_at).cast("double").alias("_at"), F.lit(None).alias("_l"), "_r")
    a = left.filter(finite(at)).select(*keys, F.floor(F.col(at) / within).alias("_bucket"), F.col(at).cast("double").alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    bucket = Window.partitionBy(*keys, "_bucket")
    seen = lambda order: F.last("_r", True).over(bucket.orderBy(order, F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).select("_l", seen(F.col("_at").asc()).alias("_before"), seen(F.col("_at").desc()).alias("_after")).filter(F.col("_l").isNotNull())

    def reached(side: str) -> Column:
        away = F.abs(F.col(f"_l.{at}") - F.col(f"{side}.{right_at}"))
        return F.when(away <= within, F.struct(away.alias("d"), F.col(f"{side}.{tie}").alias("t"), F.col(side).alias("r")))

    best = both.select("_l.*", F.array_min(F.array(reached("_before"), reached("_after"))).alias("_best")).filter(F.col("_best").isNotNull())
    return best.select(*left.columns, "_best.r.*")


def by_identity(left: DataFrame, right: DataFrame, keys: list[str], time_tolerance: float, t: str = "t") -> DataFrame:
    """(l_feature_id, r_feature_id): features of two maps identified as the same (peptide and charge) and near in time."""
    a = left.select(*keys, F.col("feature_id").alias("l_feature_id"), F.col(t).alias("_lt"))
    b = right.select(*keys, F.col("feature_id").alias("r_feature_id"), F.col(t).alias("_rt"))
    near = F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))
    a = a.withColumn("_b", F.floor(F.col("_lt") / time_tolerance)).withColumn("_b", near)
    b = b.withColumn("_b", F.floor(F.col("_rt") / time_tolerance))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col("_lt") - F.col("_rt")) <= time_tolerance).select("l_feature_id", "r_feature_id")


def inside_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: float) -> DataFrame:
    """Points joined to the intervals [start, stop] that hold them; an interval is read in each bucket it touches.

    Buckets are an eighth of ``width``, the intervals' own scale: few points then meet an interval that doesn't hold them.
    """
    fine = width / FINE
    touched = F.explode(F.sequence(F.floor(F.col(start) / fine), F.floor(F.col(stop) / fine)))
    a = points.withColumn("_bucket", F.floor(F.col(at) / fine))
    b = intervals.withColumn("_bucket", touched)
    return a.join(b, [*keys, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))).drop("_bucket")

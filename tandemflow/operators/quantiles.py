"""Exact percentiles of any number of values for a key, without gathering them in one task.

A sketch of bounded size, merged from partial ones, gives two values that surely lie on either side of
the wanted rank.  Values below them are counted; only those between, a few in ten thousand, are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import between
from .storage import materialised

#: The sketch's ranks are off by at most one in so many.
ACCURACY = 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, n, a column for each of ``wanted``): percentiles at p (n - 1), linear between neighbours; n values that aren't null."""
    rows = materialised(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "percentiles")
    margin = 2.0 / accuracy
    ends = [min(max(p + side * margin, 0.0), 1.0) for p in wanted.values() for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_ends"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    few = F.col("n") <= 4 * accuracy  # all of so few are put in order; of more, the margin is some ranks
    lows = F.array(*(F.when(few | F.lit(e <= 0), F.col("_low")).otherwise(F.col("_ends")[2 * i]) for i, e in enumerate(ends[::2])))
    highs = F.array(*(F.when(few | F.lit(e >= 1), F.col("_high")).otherwise(F.col("_ends")[2 * i + 1]) for i, e in enumerate(ends[1::2])))
    at = F.array(*(F.lit(p) * (F.col("n") - 1) for p in wanted.values()))
    bounds = materialised(sketch.select(*keys, "n", F.arrays_zip(lows.alias("low"), highs.alias("high"), at.alias("at")).alias("_b")), "percentile-bounds")
    joined = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))  # one row
    # Each value that lies between, and how many lie below, for each percentile.
    below = joined.groupBy(*keys).agg(*(F.count_if(F.col("_v") < F.col("_b")[i]["low"]).alias(f"_below{i}") for i in range(len(wanted))))
    near = joined.select(*keys, "_v", F.posexplode("_b").alias("_i", "b")).filter((F.col("_v") >= F.col("b.low")) & (F.col("_v") <= F.col("b.high")))
    counted = near.groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_c"), F.first("b.at").alias("_at"))
    reached = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_to", reached)
    placed = placed.join(below, keys) if keys else placed.crossJoin(F.broadcast(below))  # one row
    before = F.array(*(F.col(f"_below{i}") for i in range(len(wanted))))[F.col("_i")]
    first, last = before + F.col("_to") - F.col("_c"), before + F.col("_to") - 1
    low = F.when((first <= F.floor("_at")) & (F.floor("_at") <= last), F.col("_v"))
    high = F.when((first <= F.ceil("_at")) & (F.ceil("_at") <= last), F.col("_v"))
    found = placed.withColumns({"_lo": low, "_hi": high}).groupBy(*keys, "_i").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.first("_at").alias("_at"))
    value_at = between(F.col("_lo"), F.col("_hi"), F.col("_at") - F.floor("_at"))
    out = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, value_at)).alias(name) for i, name in enumerate(wanted)))
    sizes = bounds.select(*keys, "n")
    return sizes.join(out, keys) if keys else sizes.crossJoin(F.broadcast(out))  # one row


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the median of each key's values."""
    return percentiles(df, keys, value, {name: 0.5}).drop("n")


def medians_of_counts(df: DataFrame, keys: list[str], value: str, count: str, name: str, bins: int = 256) -> DataFrame:
    """(keys, name): the median of values that stand for ``count`` equal ones each; a key has each value once.

    Cuts from a sketch of the values (of any weight) part them evenly; only what shares a bin with the median is put in order.
    """
    rows = materialised(df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(count).alias("_n")), "counts")
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    sketch = F.percentile_approx(finite, F.array(*(F.lit(i / bins) for i in range(1, bins))), F.lit(ACCURACY))
    cuts = materialised(rows.groupBy(*keys).agg(sketch.alias("_cuts"), ((F.sum("_n") - 1) / 2).alias("_at")), "cuts")
    placed = rows.join(cuts, keys).withColumn("_bin", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))).drop("_cuts")
    of_bin = placed.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"), F.first("_at").alias("_at"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holds = (F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_m") > F.floor("_at"))
    middle = materialised(of_bin.withColumn("_before", before).filter(holds).select(*keys, "_bin", "_before"), "bins")  # one or two of a key
    reached = F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = placed.join(middle, [*keys, "_bin"]).withColumn("_to", F.col("_before") + reached)
    at = lambda rank: F.max(F.when((F.col("_to") - F.col("_n") <= rank) & (rank < F.col("_to")), F.col("_v")))
    found = near.groupBy(*keys).agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"))
    return found.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(name))

"""Running totals over a whole ordering without a single-partition sort.

The ordering value's range is cut into equal bins.  Sums of the bins are run over one small
table, rows inside a bin over their own window, and the two are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def binned(df: DataFrame, order: str, keys: list[str], bins: int = BINS) -> DataFrame:
    """``df`` with ``bin`` (0 to bins - 1): where ``order`` lies in its key's range."""
    ends = df.groupBy(*keys).agg(F.min(order).alias("bin_low"), F.max(order).alias("bin_high"))
    joined = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    share = (F.col(order) - F.col("bin_low")) / F.nullif(F.col("bin_high") - F.col("bin_low"), F.lit(0.0))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return joined.withColumn("bin", at).drop("bin_low", "bin_high")


def running(df: DataFrame, order: str, sums: dict[str, Column], keys: list[str], descending: bool = True, bins: int = BINS) -> DataFrame:
    """``df`` with running sums by ``order`` (distinct within the keys), each key on its own."""
    rows = binned(df, order, keys, bins)
    way = (lambda c: F.col(c).desc()) if descending else F.col
    before = Window.partitionBy(*keys).orderBy(way("bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "bin").agg(*(F.sum(c).alias(f"{n}_sum") for n, c in sums.items()))
    offsets = totals.select(*keys, "bin", *(F.coalesce(F.sum(f"{n}_sum").over(before), F.lit(0)).alias(f"{n}_before") for n in sums))
    inside = Window.partitionBy(*keys, "bin").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, [*keys, "bin"])
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"{n}_before"))
    return out.drop(*(f"{n}_before" for n in sums))


def running_min(df: DataFrame, order: str, value: str, name: str, keys: list[str], descending: bool, inclusive: bool = True) -> DataFrame:
    """``df`` (which has ``bin``) with the least ``value`` up to each row, or before it."""
    way = (lambda c: F.col(c).desc()) if descending else F.col
    before = Window.partitionBy(*keys).orderBy(way("bin")).rowsBetween(Window.unboundedPreceding, -1)
    lows = df.groupBy(*keys, "bin").agg(F.min(value).alias("bin_min"))
    lows = lows.select(*keys, "bin", F.min("bin_min").over(before).alias("bin_before"))
    inside = Window.partitionBy(*keys, "bin").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(lows, [*keys, "bin"])
    return out.withColumn(name, F.least(F.min(value).over(inside), "bin_before")).drop("bin_before")

"""Retention-time alignment of maps: landmarks, smoothing, monotony, conversion, normalisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import interpolate
from ..functions.numerics import loess
from . import rangejoin
from .peaks import SMOOTHING, SMOOTHING_SUM
from .quantiles import medians_of_counts, percentiles
from .running import BINS
from .storage import materialised


def landmarks(left: DataFrame, right: DataFrame, mz_tolerance: float, time_tolerance: float, mass_bin: float) -> DataFrame:
    """(mass_bin, t, dt) of features of two maps that match each other and nothing else."""
    pairs = rangejoin.boxes(left, right, ["charge"], mz_tolerance, time_tolerance)
    unique = rangejoin.unique_pairs(pairs.select("l_feature_id", "r_feature_id", "l_t", "r_t", "l_mz"), "l_feature_id", "r_feature_id")
    return unique.select(F.floor(F.col("l_mz") / mass_bin).alias("mass_bin"), F.col("l_t").alias("t"), (F.col("r_t") - F.col("l_t")).alias("dt"))


def time_windows(marks: DataFrame, keys: list[str], width: float, overlap: float, least: int) -> DataFrame:
    """(keys, window, t, dt, n): the median landmark of each time window, where it has enough.

    A window of number w covers [w step, w step + width); a landmark lies in every one that covers it.
    """
    step = width * (1 - overlap)
    last = F.floor(F.col("t") / step)
    first = F.floor((F.col("t") - width) / step) + 1
    spread = marks.withColumn("window", F.explode(F.sequence(first, last)))
    out = spread.groupBy(*keys, "window").agg(((F.min("t") + F.max("t")) / 2).alias("t"), F.median("dt").alias("dt"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least)


def count_windows(marks: DataFrame, keys: list[str], size: int, overlap: float) -> DataFrame:
    """(keys, window, t, dt): the median landmark of every ``size`` landmarks in order of time."""
    step = max(1, int(size * (1 - overlap) + 0.5)) if overlap else size
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "dt")) - 1
    placed = marks.withColumn("_at", at)
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step))
    spread = placed.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("_at") / step))))
    return spread.groupBy(*keys, "window").agg(((F.min("t") + F.max("t")) / 2).alias("t"), F.median("dt").alias("dt"), F.count("*").alias("n"))


def monotone(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Landmarks whose time and moved time both exceed those of the one kept before: a fold over each key's landmarks."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "dt")))
    kind = "array<struct<t:double,dt:double>>"
    start = F.struct(F.lit(float("-inf")).alias("t"), F.lit(float("-inf")).alias("moved"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        keep = (x["t"] > acc["t"]) & (x["t"] + x["dt"] > acc["moved"])
        return F.struct(
            F.when(keep, x["t"]).otherwise(acc["t"]).alias("t"),
            F.when(keep, x["t"] + x["dt"]).otherwise(acc["moved"]).alias("moved"),
            F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    folded = marks.groupBy(*keys).agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("m"))
    return folded.select(*keys, F.explode("m").alias("m")).select(*keys, "m.*")


def stepped(marks: DataFrame, keys: list[str]) -> DataFrame:
    """``marks`` with _step: dt less that of the one before in the key's order of t and dt (nulls last).

    Found in bins of time: a landmark's predecessor is in its bin or is the last of an earlier one.
    """
    ends = materialised(marks.groupBy(*keys).agg(F.min("t").alias("_low"), F.max("t").alias("_high")), "ends")  # few: dealt by key, few tasks would read all rows
    share = (F.col("t") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    at = F.when(F.col("t").isNull(), BINS).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)))
    placed = marks.join(ends, keys).withColumn("_bin", at.cast("int")).drop("_low", "_high")
    last = F.max_by(F.struct("dt"), F.struct(F.isnull("t"), "t", F.isnull("dt"), "dt"))
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    ends_of = placed.groupBy(*keys, "_bin").agg(last.alias("_last")).select(*keys, "_bin", earlier.alias("_earlier"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.col("t").asc_nulls_last(), F.col("dt").asc_nulls_last())
    before = F.when(F.row_number().over(inside) == 1, F.col("_earlier.dt")).otherwise(F.lag("dt").over(inside))
    return placed.join(ends_of, [*keys, "_bin"]).withColumn("_step", F.col("dt") - before).drop("_bin", "_earlier")


def without_outliers(marks: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """Landmarks whose step in dt from the one before stays within the outer fences (3 IQR), pass after pass."""
    for _ in range(passes):
        steps = materialised(stepped(marks, keys), "steps")
        q = materialised(percentiles(steps, keys, "_step", {"_q1": 0.25, "_q3": 0.75}), "fences")
        reach = 3 * (F.col("_q3") - F.col("_q1"))
        inside = F.col("_step").isNull() | F.col("_step").between(F.col("_q1") - reach, F.col("_q3") + reach)
        marks = steps.join(q, keys, "left").filter(inside).select(*marks.columns)
    return marks


def segments(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, dt, next_t, next_dt): the piecewise-linear function through the landmarks."""
    w = Window.partitionBy(*keys).orderBy("t")
    return marks.select(*keys, "t", "dt", F.lead("t").over(w).alias("next_t"), F.lead("dt").over(w).alias("next_dt"))


def converted(features: DataFrame, marks: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``features`` with aligned_t, by the landmarks (distinct t per key); the ends' shifts hold beyond them.

    A segment is read in each time bucket that it touches, so the conversion is an equi-join.
    """
    parts = segments(marks, keys).select(*keys, F.col("t").alias("_t0"), F.col("dt").alias("_d0"), F.col("next_t").alias("_t1"), F.col("next_dt").alias("_d1"))
    ends = marks.groupBy(*keys).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    inside = features.join(ends, keys).withColumn("_at", F.least(F.greatest("t", "_low"), F.col("_high"))).withColumn("_bucket", F.floor(F.col("_at") / width))
    touched = parts.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_t0") / width), F.floor(F.coalesce("_t1", "_t0") / width))))
    hit = inside.join(touched, [*keys, "_bucket"]).filter((F.col("_at") >= F.col("_t0")) & (F.col("_t1").isNull() | (F.col("_at") < F.col("_t1"))))
    shift = interpolate(F.col("_at"), F.col("_t0"), F.col("_d0"), F.col("_t1"), F.col("_d1"))
    return hit.withColumn("aligned_t", F.col("t") + shift).select(*features.columns, "aligned_t")


def reference_map(distances: DataFrame) -> DataFrame:
    """One row: the map with the least mean |dt| to the others. distances: (map_id, dt)."""
    mean = distances.groupBy("map_id").agg(F.avg(F.abs(F.col("dt"))).alias("mean_dt"))
    return mean.orderBy("mean_dt", "map_id").limit(1)


def loess_smoothed(marks: DataFrame, keys: list[str], bandwidth: float = 0.3) -> DataFrame:
    """(keys, t, dt, smooth) by LOESS; each key's landmarks are a pandas group (a map pair's mass bin)."""

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "dt"])
        return pdf.assign(smooth=loess(pdf["t"].to_numpy(dtype=np.float64), pdf["dt"].to_numpy(dtype=np.float64), bandwidth))

    kinds = ", ".join(f"{c} {marks.schema[c].dataType.simpleString()}" for c in [*keys, "t", "dt"])
    return marks.select(*keys, "t", "dt").groupBy(*keys).applyInPandas(smooth, f"{kinds}, smooth double")


def map_factors(features: DataFrame, method: str) -> DataFrame:
    """(map_id, factor) that brings every map to the reference: the middle-ranked by total or median, or map 0 for ratios.

    The windows run over maps, one row each.
    """
    of_map = F.sum(F.col("intensity").cast("decimal(18,4)")).cast("double") if method == "sum" else F.median("intensity")
    totals = features.groupBy("map_id").agg(of_map.alias("v"))
    ranked = Window.partitionBy(F.lit(1)).orderBy("v", "map_id")
    everything = Window.partitionBy(F.lit(1))
    middle = F.max(F.when(F.col("at") == F.floor((F.col("n") + 1) / 2), F.col("v"))).over(everything)
    placed = totals.withColumn("at", F.row_number().over(ranked)).withColumn("n", F.count("*").over(everything))
    return placed.select("map_id", (middle / F.col("v")).alias("factor"))


def ratio_factors(pairs: DataFrame) -> DataFrame:
    """(map_id, factor): the median ratio of reference to child over master features. pairs: (map_id, reference, child).

    A child of zero gives an infinite ratio (or none, NaN, to a reference of zero), above all others.
    Pairs are many more than features: they are counted by their ratio where they are found.
    """
    ratio = F.when(F.col("child") == 0, F.col("reference") * float("inf")).otherwise(F.col("reference") / F.nullif("child", F.lit(0.0)))
    counted = pairs.select("map_id", ratio.alias("_ratio")).filter(F.col("_ratio").isNotNull()).groupBy("map_id", "_ratio").agg(F.count("*").alias("_n"))
    return medians_of_counts(counted, ["map_id"], "_ratio", "_n", "factor")


def savitzky_golay(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``smooth``, the Savitzky-Golay smoothing (5, 5, order 4) of the value; the first and last five stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    half = len(SMOOTHING) // 2
    total = F.col(value) * SMOOTHING[half]
    for i in range(1, half + 1):
        total = total + (F.lag(value, i).over(w) + F.lead(value, i).over(w)) * SMOOTHING[half + i]
    return df.withColumn("smooth", F.coalesce(total / SMOOTHING_SUM, F.col(value)))


def moz_calibration(features: DataFrame, keys: list[str], width: float, overlap: float = 0.5, least: int = 1, most_ppm: float = 500.0) -> DataFrame:
    """(keys, t, ppm): the median m/z error of each time window. features: (keys, t, mz, expected_mz).

    Errors of ``most_ppm`` and more are no calibration points.
    """
    ppm = (F.col("mz") - F.col("expected_mz")) / F.col("expected_mz") * 1e6
    points = features.select(*keys, "t", ppm.alias("dt")).filter(F.abs("dt") < most_ppm)
    return time_windows(points, keys, width, overlap, least).groupBy(*keys, "t").agg(F.avg("dt").alias("ppm"))


def calibrated(features: DataFrame, calibration: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``features`` with calibrated_mz: the m/z less the interpolated error at its time."""
    moved = converted(features, calibration.withColumnRenamed("ppm", "dt"), keys, width)
    ppm = F.col("aligned_t") - F.col("t")
    return moved.withColumn("calibrated_mz", F.col("mz") / (1 + ppm / 1e6)).drop("aligned_t")

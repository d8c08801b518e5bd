"""Signals stored as arrays of peaks: intensities, smoothing, features from isotopes.

A signal is array<struct<time, intensity>> in order of time. All functions are Columns: a signal
never leaves its row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import defined


def apex(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p["intensity"]))


def apex_index(peaks: Column) -> Column:
    """1-based place of the first highest peak."""
    return F.array_position(F.transform(peaks, lambda p: p["intensity"]), apex(peaks)).cast("int")


def _area(points: Column) -> Column:
    """Trapezoids between neighbours."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: (b["time"] - a["time"]) * (a["intensity"] + b["intensity"]) / 2)
    return F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)).otherwise(0.0)


def area(peaks: Column) -> Column:
    return _area(peaks)


def area_above_half(peaks: Column) -> Column:
    """Area of the peak around the apex above half its height, its edges interpolated."""
    half, top = apex(peaks) / 2, apex_index(peaks)
    at = F.sequence(F.lit(1), F.size(peaks))
    value = lambda i: F.element_at(peaks, i)
    below = lambda side: F.filter(at, lambda i: side(i) & (value(i)["intensity"] < half))
    left, right = F.array_max(below(lambda i: i < top)), F.array_min(below(lambda i: i > top))

    def edge(low: Column, high: Column) -> Column:
        """The point at half height between a peak below it and the next one inside."""
        a, b = value(low), value(high)
        t = a["time"] + (b["time"] - a["time"]) * (half - a["intensity"]) / (b["intensity"] - a["intensity"])
        return F.array(F.struct(t.alias("time"), half.alias("intensity")))

    none = F.array().cast("array<struct<time:double,intensity:double>>")
    first, last = F.coalesce(left + 1, F.lit(1)), F.coalesce(right - 1, F.size(peaks))
    inside = F.concat(
        F.when(left.isNotNull(), edge(left, left + 1)).otherwise(none),
        F.slice(peaks, first, last - first + 1),
        F.when(right.isNotNull(), edge(right, right - 1)).otherwise(none),
    )
    return _area(F.transform(inside, lambda p: F.struct(p["time"].alias("time"), (p["intensity"] - half).alias("intensity"))))


def mean_around_apex(peaks: Column) -> Column:
    """Mean of the apex and its neighbours."""
    near = F.slice(peaks, F.greatest(apex_index(peaks) - 1, F.lit(1)), F.when(apex_index(peaks) > 1, 3).otherwise(2))
    return F.aggregate(near, F.lit(0.0), lambda acc, p: acc + p["intensity"]) / F.size(near)


INTENSITIES = {"apex": apex, "area": area, "area_above_half": area_above_half, "top3_mean": mean_around_apex}


#: Savitzky-Golay weights of 5 points on either side and a polynomial of order 4, over 429.
SMOOTHING = (18.0, -45.0, -10.0, 60.0, 120.0, 143.0, 120.0, 60.0, -10.0, -45.0, 18.0)
SMOOTHING_SUM = 429.0


def smoothed(peaks: Column) -> Column:
    """Savitzky-Golay smoothing (5, 5, order 4); the first and last five peaks stay."""

    def one(p: Column, i: Column) -> Column:
        near = F.slice(peaks, i - 4, len(SMOOTHING))
        weighed = F.zip_with(near, F.array(*map(F.lit, SMOOTHING)), lambda x, w: x["intensity"] * w)
        total = F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + x)
        inside = (i >= 5) & (i < F.size(peaks) - 5)
        return F.struct(p["time"].alias("time"), F.when(inside, total / SMOOTHING_SUM).otherwise(p["intensity"]).alias("intensity"))

    return F.transform(peaks, one)


def fitted(peaks: Column, shape: str) -> Column:
    """The intensities of a signal replaced by a curve fitted to its peaks above half the apex: gaussian or quadratic.

    A gaussian is a parabola through the logarithms.  With fewer than three such peaks, or a parabola that
    opens upwards, the signal stays.  Fits of a batch's signals are small and independent.
    """
    if shape not in ("gaussian", "quadratic"):
        raise ValueError(shape)

    @F.pandas_udf("array<double>")
    def fit(times: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, y in zip(times, values, strict=True):
            if t is None or not len(t):
                out.append(y)
                continue
            t, y = np.asarray(t, dtype=np.float64), np.asarray(y, dtype=np.float64)
            use = (y >= y.max() / 2) & (y > 0)
            if use.sum() < 3 or np.ptp(t[use]) == 0:
                out.append(y)
                continue
            middle, spread = t[use].mean(), np.ptp(t[use])
            x = (t - middle) / spread
            c = np.polyfit(x[use], np.log(y[use]) if shape == "gaussian" else y[use], 2)
            curve = np.polyval(c, x)
            out.append(y if c[0] >= 0 else np.exp(np.minimum(curve, 700)) if shape == "gaussian" else np.maximum(curve, 0))
        return pd.Series(out)

    times, values = F.transform(peaks, lambda p: p["time"]), F.transform(peaks, lambda p: p["intensity"])
    return F.zip_with(times, fit(times, values), lambda t, y: F.struct(t.alias("time"), y.alias("intensity")))


def feature_intensity(isotopes: DataFrame, key: str, method: str, n: int = 2) -> DataFrame:
    """(key, intensity) of features from isotopes (key, isotope, intensity). method: all, first_n, highest."""
    df = isotopes.withColumn("intensity", defined(F.col("intensity")))
    if method == "first_n":
        df = df.filter(F.col("isotope") < n)
    how = F.max("intensity") if method == "highest" else F.sum(F.col("intensity").cast("decimal(28,6)")).cast("double")
    return df.groupBy(key).agg(how.alias("intensity"))


def steadiest_isotope(isotopes: DataFrame, key: str) -> DataFrame:
    """(key, isotope): the isotope with the least coefficient of variation over runs. isotopes: (key, isotope, run, intensity)."""
    cv = isotopes.groupBy(key, "isotope").agg((F.stddev_samp("intensity") / F.avg("intensity")).alias("cv"))
    return cv.groupBy(key).agg(F.min_by("isotope", F.struct(F.coalesce("cv", F.lit(float("inf"))).alias("a"), F.col("isotope").alias("b"))).alias("isotope"))


def isotope_chain(features: DataFrame, peaks: DataFrame, key: str, ppm: float, most: int, mass_step: float = 1.0033548) -> DataFrame:
    """(key, isotope, peak_id): peaks at the m/z of each next isotope, up to the first that is missing.

    features: (key, mz, charge); peaks: (peak_id, peak_mz). The expected m/z are made per feature and
    matched in one bucketed join, so no lookup follows another.
    """
    isotope = F.explode(F.sequence(F.lit(0), F.lit(most)))
    wanted = features.withColumn("isotope", isotope).withColumn("at", F.col("mz") + F.col("isotope") * mass_step / F.col("charge"))
    width = 5000.0 * ppm / 1e6
    bucket = F.floor(F.col("at") / width)
    a = wanted.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = peaks.withColumn("_b", F.floor(F.col("peak_mz") / width))
    hit = a.join(b, "_b").filter(F.abs(F.col("peak_mz") - F.col("at")) <= F.col("at") * ppm / 1e6)
    best = hit.groupBy(key, "isotope").agg(F.min_by("peak_id", F.struct(F.abs(F.col("peak_mz") - F.col("at")).alias("d"), F.col("peak_id").alias("i"))).alias("peak_id"))
    unbroken = F.row_number().over(Window.partitionBy(key).orderBy("isotope")) - 1
    return best.withColumn("_n", unbroken).filter("isotope = _n").drop("_n")

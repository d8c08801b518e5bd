"""Peak arrays against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemflow.operators import peaks


def test_intensities(spark):
    t, y = np.arange(7.0), np.array([0.0, 1.0, 4.0, 8.0, 6.0, 2.0, 0.0])
    rows = [(1, [(float(a), float(b)) for a, b in zip(t, y, strict=True)])]
    df = spark.createDataFrame(rows, "id long, p array<struct<time:double,intensity:double>>")
    got = df.select(*(f(F.col("p")).alias(n) for n, f in peaks.INTENSITIES.items()), peaks.smoothed(F.col("p")).alias("s")).head()
    assert got["apex"] == 8
    assert got["area"] == pytest.approx(np.trapezoid(y, t))
    assert got["top3_mean"] == pytest.approx(6)
    x = np.array([2.0, 3.0, 4.0, 4.5])
    assert got["area_above_half"] == pytest.approx(np.trapezoid(np.interp(x, t, y) - 4, x))
    assert [p["intensity"] for p in got["s"]] == y.tolist()


def test_smoothing_and_fits(spark):
    x = np.arange(25.0)
    bell = 50 * np.exp(-(((x - 11.3) / 3.1) ** 2) / 2)
    noisy = bell + np.random.default_rng(1).normal(0, 1, 25)
    rows = [(1, list(zip(x.tolist(), noisy.tolist(), strict=True))), (2, list(zip(x.tolist(), bell.tolist(), strict=True))), (3, [(0.0, 1.0)]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id long, p array<struct<time:double,intensity:double>>")
    p = F.col("p")
    got = {r["id"]: r for r in df.select("id", peaks.smoothed(p).alias("s"), peaks.fitted(p, "gaussian").alias("g"), peaks.fitted(p, "quadratic").alias("q")).collect()}
    values = lambda c: np.array([v["intensity"] for v in c])
    powers = np.vander(np.arange(-5.0, 6.0), 5)
    weights = np.linalg.pinv(powers)[-1]  # the fitted polynomial's value in the middle
    for at in range(5, 20):
        assert values(got[1]["s"])[at] == pytest.approx(weights @ noisy[at - 5 : at + 6])
    assert values(got[1]["s"])[:5].tolist() == noisy[:5].tolist()
    assert values(got[2]["g"]) == pytest.approx(bell, rel=1e-6)
    use = bell >= bell.max() / 2
    assert values(got[2]["q"])[use] == pytest.approx(np.polyval(np.polyfit(x[use], bell[use], 2), x[use]))
    assert [len(got[i][c]) for i in (3, 4) for c in "sgq"] == [1, 1, 1, 0, 0, 0]


def test_isotopes(spark):
    df = spark.createDataFrame([(1, 0, 1, 10.0), (1, 0, 2, 11.0), (1, 1, 1, 5.0), (1, 1, 2, 9.0)], "k long, isotope int, run int, intensity double")
    assert peaks.steadiest_isotope(df, "k").head()["isotope"] == 0
    assert peaks.feature_intensity(df, "k", "first_n", 1).head()["intensity"] == 21
    assert peaks.feature_intensity(df, "k", "highest").head()["intensity"] == 11
    f = spark.createDataFrame([(1, 500.0, 2)], "k long, mz double, charge int")
    p = spark.createDataFrame([(1, 500.0), (2, 500.5017), (3, 501.505)], "peak_id long, peak_mz double")
    assert [r["peak_id"] for r in peaks.isotope_chain(f, p, "k", 10.0, 4).orderBy("isotope").collect()] == [1, 2]

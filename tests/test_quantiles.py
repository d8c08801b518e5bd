"""Exact percentiles against numpy: skewed, tied, tiny and missing values."""

from __future__ import annotations

import numpy as np
import pytest

from tandemflow.operators import quantiles


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    of = {1: rng.lognormal(0, 4, 3000), 2: rng.integers(0, 3, 500).astype(float), 3: np.array([7.0]), 4: np.array([1.0, 2.0]), 5: np.r_[np.zeros(900), 1e9]}
    rows = [(k, float(v)) for k, x in of.items() for v in x] + [(1, None), (6, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    wanted = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.75, "e": 1.0}
    for accuracy in (10000, 50):
        got = {r["k"]: r for r in quantiles.percentiles(df, ["k"], "v", wanted, accuracy).collect()}
        assert got.keys() == of.keys()
        for k, x in of.items():
            assert got[k]["n"] == len(x)
            assert [got[k][n] for n in wanted] == pytest.approx([np.percentile(x, 100 * p) for p in wanted.values()])
    whole = np.concatenate(list(of.values()))
    assert quantiles.medians(df, [], "v", "m").head()["m"] == pytest.approx(np.median(whole))
    assert quantiles.percentiles(df.limit(0), ["k"], "v", wanted).collect() == []

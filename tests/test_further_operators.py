"""Operators without an SQL form, against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemflow.functions import numerics
from tandemflow.operators import alignment, filters, ptm, quant, storage, validators


def test_tails_of_whole_arrays():
    rng = np.random.default_rng(2)
    a, b, x = rng.uniform(0.3, 40, 500), rng.uniform(0.3, 40, 500), rng.random(500)
    assert numerics.incomplete_betas(a, b, x) == pytest.approx([numerics.incomplete_beta(*v) for v in zip(a, b, x, strict=True)], abs=1e-12)
    assert numerics.incomplete_betas(np.array([2.0, 2.0]), np.array([3.0, 3.0]), np.array([0.0, 1.0])).tolist() == [0, 1]
    p = numerics.welch([1.0, 1.0, 1.0], [0.5, 0.0, 1.0], [5, 5, 1], [2.0, 2.0, 2.0], [0.4, 0.0, 1.0], [4, 4, 4])
    assert p[0] == pytest.approx(0.0616, abs=1e-3)
    assert np.isnan(p[1:]).all()


def test_corrected_t_test(spark):
    rng = np.random.default_rng(5)
    of = {k: (rng.normal(100 * k, 5, 5), rng.normal(120 * k, 0.2 if k % 2 else 9, 4)) for k in range(1, 9)}
    rows = [(k, g + 1, float(v)) for k, groups in of.items() for g, values in enumerate(groups) for v in values] + [(99, 1, 1.0), (99, 2, 2.0)]
    df = spark.createDataFrame(rows, "k int, g int, v double")
    model = spark.createDataFrame([(2.0, 10.0), (3.0, 40.0)], "log_abundance double, spread double")
    got = {r["k"]: r["p_value"] for r in quant.group_t_test(df, ["k"], "g", "v", 1, 2, model).collect()}
    assert got[99] is None
    for k, (x, y) in of.items():
        fold = max(x.mean(), y.mean()) / min(x.mean(), y.mean())

        def raised(z):
            cv, expected = 100 * z.std(ddof=1) / z.mean(), 100 * np.interp(math.log10(z.mean()), [2, 3], [10, 40]) / z.mean()
            return ((cv + expected / (1 + math.exp(cv - expected / 2)) / fold) * z.mean() / 100) ** 2

        def p(vx, vy):
            a, b = vx / len(x), vy / len(y)
            return numerics.t_two_sided((x.mean() - y.mean()) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1)))

        assert got[k] == pytest.approx(max(p(x.var(ddof=1), y.var(ddof=1)), p(raised(x), raised(y))))


def test_sequences(spark):
    df = spark.createDataFrame([("PEPTIDE", None), ("AXBXC", "2,X,K,4,X,R"), ("", ""), (None, None), ("ILK", "")], "s string, a string")
    rows = df.select("s", ptm.resolved(F.col("s"), F.col("a")).alias("r"), ptm.peptide_key(F.col("s"), F.lit("p"), True).alias("k"), ptm.isoelectric_point(F.col("s")).alias("pi")).collect()
    got = {r["s"]: r for r in rows}
    assert got["AXBXC"]["r"] == "AKBRC"
    assert got["ILK"]["k"] == "LLK%p"
    assert got["PEPTIDE"]["r"] == "PEPTIDE"
    assert (got[""]["pi"], got[None]["pi"]) == (None, None)
    for s in ("PEPTIDE", "ILK"):
        ph = got[s]["pi"]
        up = sum((1 if len(r) > 1 else s.count(r)) / (1 + 10 ** (ph - pk)) for r, pk in ptm.PK_POSITIVE.items())
        down = sum((1 if len(r) > 1 else s.count(r)) / (1 + 10 ** (pk - ph)) for r, pk in ptm.PK_NEGATIVE.items())
        assert up == pytest.approx(down, abs=1e-6)


def test_calibration_is_applied(spark):
    rows = [(0, 10.0 * i, 500.0 * (1 + (5 + i / 50) / 1e6), 500.0) for i in range(100)] + [(0, 55.0, 600.0, 500.0)]
    f = spark.createDataFrame(rows, "map_id int, t double, mz double, expected_mz double")
    c = alignment.moz_calibration(f, ["map_id"], 100.0)
    out = alignment.calibrated(f, c, ["map_id"], 100.0).filter("mz < 550 AND t BETWEEN 60 AND 900").collect()
    assert len(out) > 80
    assert max(abs(r["calibrated_mz"] - 500) / 500 * 1e6 for r in out) < 0.2


def test_deletion_reaches_down(spark):
    df = lambda rows: spark.createDataFrame(rows, "id int, parent int")
    sets, searches, lists = df([(1, 10), (2, 11), (3, 10)]), df([(5, 1), (6, 2), (7, None)]), df([(8, 5), (9, 6)])
    left = storage.purged(spark.createDataFrame([(10,)], "id int"), [(sets, "id", "parent"), (searches, "id", "parent"), (lists, "id", "parent")])
    assert [sorted(r["id"] for r in x.collect()) for x in left] == [[2], [6, 7], [9]]
    mapping = spark.createDataFrame([(1, 101), (10, 110)], "old_id int, new_id int")
    copy = storage.cloned({"sets": sets}, mapping, {"sets": ["id", "parent"]})["sets"]
    assert sorted(map(tuple, copy.collect())) == [(2, 11), (3, 110), (101, 110)]


def test_modified_by_ids(spark):
    rows = [(1, "AA", 5.0, [1]), (2, "AA", 9.0, []), (3, "BB", 1.0, [2]), (4, "CC", 3.0, None)]
    df = spark.createDataFrame(rows, "peptide_id int, sequence string, abundance double, ptm_ids array<int>")
    valid = lambda mode: {r["peptide_id"] for r in filters.discard_modified_by_ids(df, [1], mode).collect() if r["is_validated"]}
    assert valid("forms") == {2, 3, 4}
    assert valid("all") == {3, 4}
    assert valid("keep") == {2, 3, 4}


def test_rules_without_points(spark):
    empty = spark.createDataFrame([], "n_items int, score double, is_decoy boolean")
    assert validators.sequential_set_rules(empty, 1.0).collect() == []
    only_targets = spark.createDataFrame([(2, 5.0, False), (1, 3.0, False), (2, None, True)], "n_items int, score double, is_decoy boolean")
    got = [tuple(r) for r in validators.sequential_set_rules(only_targets, 1.0).orderBy("rule").collect()]
    assert got == [("remaining", 3.0, False, 2, 0, 0.0), ("several", 5.0, False, 1, 0, 0.0)]

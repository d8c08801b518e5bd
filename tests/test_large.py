"""Operators whose work may not grow faster than their input, on small tables against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemflow.operators import alignment, quant, rangejoin


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_makes_no_pairs(spark):
    rng = np.random.default_rng(5)
    left = [(i, int(rng.integers(2)), float(rng.integers(0, 400)) / 4) for i in range(300)] + [(900, 0, None), (901, 0, float("nan")), (902, 1, -7.0), (902, 1, -7.0)]
    right = [(int(rng.integers(2)), 1000 - i, float(rng.integers(-40, 300)) / 4, f"x{i}") for i in range(200)] + [(0, 1, None, "n"), (0, 2, float("nan"), "n"), (0, 3, float("inf"), "n")]
    a, b = spark.createDataFrame(left, "id long, k int, t double").repartition(3), spark.createDataFrame(right, "k int, rid long, rt double, more string").repartition(3)
    found = rangejoin.nearest(a, b, ["k"], "t", "rt", 2.0, "rid")
    want = []
    for i, k, t in left:
        near = [(abs(t - rt), rid, rt, more) for rk, rid, rt, more in right if rk == k and None not in (t, rt) and abs(t - rt) <= 2]
        want += [(i, k, t, *min(near)[1:])] if near else []
    assert found.columns == ["id", "k", "t", "rid", "rt", "more"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Join" not in plan(found)


def test_boxes_meet_in_time(spark):
    rng = np.random.default_rng(6)
    kind = "feature_id long, charge int, mz double, t double, duration double"
    of = lambda n: [(i, int(rng.integers(1, 3)), float(rng.integers(0, 40)) / 10, float(rng.integers(-9, 90)) * 1800.0, float(rng.choice([60.0, 3600.0, 9000.0]))) for i in range(n)]
    a, b = [*of(150), (500, 1, 1.0, 0.0, None)], [*of(150), (501, 1, 1.0, 0.0, None), (502, 1, 1.0, None, 60.0)]
    shorter = lambda x, y: min(v for v in (x, y) if v is not None)
    for tolerance in (0.0, 7200.0):
        pairs = rangejoin.boxes(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["charge"], 0.5, tolerance)
        want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) < 0.5 and None not in (x[3], y[3]) and (x[4] or y[4]) and abs(x[3] - y[3]) < shorter(x[4], y[4]) + tolerance]
        assert sorted((r[0], r[1]) for r in pairs.select("l_feature_id", "r_feature_id").collect()) == sorted(want)
        assert "_time" in plan(pairs)  # rows of all times don't meet


def test_ratio_factors_with_zeros(spark):
    rng = np.random.default_rng(7)
    of = {1: [(5.0, 0.0), (0.0, 0.0), (1.0, 2.0), (4.0, 2.0), (9.0, 3.0)], 2: [(1.0, 0.0), (2.0, 0.0), (1.0, 1.0)], 3: [(float(x), float(y)) for x, y in rng.integers(1, 60, (4000, 2))], 4: [(1.0, 4.0), (1.0, 2.0)]}
    df = spark.createDataFrame([(k, x, y) for k, v in of.items() for x, y in v], "map_id int, reference double, child double").repartition(3)
    got = {r["map_id"]: r["factor"] for r in alignment.ratio_factors(df).collect()}
    assert got.pop(2) == float("inf")
    assert got == {1: 3.0, 3: np.median([x / y for x, y in of[3]]), 4: 0.375}


def test_grid_is_not_dealt_by_channel(spark):
    rows = [(e, c, float(10 * e + c)) for e in range(40) for c in (1, 2, 3) if (e + c) % 4]
    out = quant.impute_percentile(spark.createDataFrame(rows, "e int, c int, x double"), ["e"], "c", "x", [1, 2, 3, 4])
    low = {c: np.percentile([x for _, k, x in rows if k == c], 1) for c in (1, 2, 3)} | {4: None}
    had = {(e, c): x for e, c, x in rows}
    assert {(r["e"], r["c"]): r["x"] for r in out.collect()} == {(e, c): had.get((e, c), low[c] and pytest.approx(low[c])) for e in range(40) for c in low}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = quant.impute_percentile(spark.createDataFrame(rows, "e int, c int, x double"), ["e"], "c", "x", [1, 2, 3, 4])
        top = plan(again).split("BroadcastHashJoin")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in top and "Exchange" not in top  # few channels: dealt by them, few tasks would read all


def test_gaussian_reads_its_rows_once(spark):
    rows = [(e, c, float(100 * e + c)) for e in range(1, 30) for c in (1, 2, 3) if (e + c) % 3]
    out = quant.impute_gaussian(spark.createDataFrame(rows, "e int, c int, x double"), ["e"], "c", "x", [1, 2, 3])
    assert "Join" not in plan(out)
    had = {(e, c): x for e, c, x in rows}
    for r in out.collect():
        at = (r["e"], r["c"])
        assert r["imputed"] == (at not in had)
        assert r["x"] == had[at] if at in had else r["x"] == pytest.approx(np.mean([x for e, _, x in rows if e == r["e"]]), rel=0.3)


def test_intervals_meet_few_points_outside(spark):
    starts = [(i, float(s), s + 1800.0) for i, s in enumerate(range(0, 40000, 130))]
    points = [(i, float(t)) for i, t in enumerate(range(-100, 42000, 90))]
    a, b = spark.createDataFrame(points, "p long, t double"), spark.createDataFrame(starts, "i long, s double, e double")
    a, b = a.withColumn("k", F.lit(0)), b.withColumn("k", F.lit(0))
    inside = rangejoin.inside_intervals(a, b, ["k"], "t", "s", "e", 3600.0)
    want = [(p, i) for p, t in points for i, s, e in starts if s <= t <= e]
    assert sorted((r["p"], r["i"]) for r in inside.select("p", "i").collect()) == sorted(want)
    met = rangejoin.inside_intervals(a.withColumn("_t", F.col("t")), b, ["k"], "t", "s", "e", 3600.0)
    fine = 3600.0 / rangejoin.FINE
    looked_at = sum(s // fine <= t // fine <= e // fine for _, t in points for _, s, e in starts)
    assert met.count() <= looked_at < 1.4 * len(want)

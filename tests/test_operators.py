"""Literal cases and invariants of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemflow.functions import columns as C
from tandemflow.functions import numerics
from tandemflow.operators import alignment, cluster, fdr, filters, hierarchy, inference, merge, ptm, quant, rangejoin, ranking, spectral, storage
from tandemflow.sources.tables import Tables, in_order


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head()[0]


def sets_of(spark, family: dict[int, list[int]]):
    return inference.samesets(spark.createDataFrame([(k, i) for k, v in family.items() for i in v], "protein_id long, peptide_id long"))


def test_thresholds(spark):
    assert one(spark, C.identity_threshold(F.lit(47.0), 0.05)) == pytest.approx(16.720978, abs=1e-5)
    assert one(spark, C.identity_threshold(F.lit(47.0), 0.01)) == pytest.approx(23.7106, abs=1e-3)
    assert one(spark, C.candidates_of(F.lit(16.720978), 0.05)) == pytest.approx(47, abs=1e-3)
    assert one(spark, C.moved_threshold(F.lit(13.213378), 0.05, 0.01)) == pytest.approx(20.20307, abs=1e-3)
    assert one(spark, C.chance_p(F.lit(16.720978), F.lit(47.0))) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize(
    ("family", "n_sets", "n_subsets", "n_subsumable"),
    [
        ({1: [1, 2, 3, 4], 2: [1, 2, 3, 4]}, 1, 0, 0),
        ({1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4]}, 2, 1, 0),
        ({1: [1, 2, 3], 2: [4, 5, 6], 3: [3, 6]}, 3, 0, 1),
        ({1: [5, 6, 7], 2: [1, 2, 3], 3: [3, 4, 5], 4: [1, 3, 6]}, 4, 0, 1),
        ({1: [1, 2], 2: [3, 4], 3: [5, 6], 4: [1, 3, 5]}, 4, 0, 1),
        ({1: [1, 2], 2: [2, 3], 3: [3, 1]}, 3, 0, 0),
        ({1: [1, 2], 2: [2, 3], 3: [3, 4], 4: [4, 5]}, 4, 0, 0),
    ],
)
def test_set_clusters(spark, family, n_sets, n_subsets, n_subsumable):
    sets = sets_of(spark, family)
    subsets = inference.strict_subsets(sets)
    loose = {r[0] for r in inference.subsumable(sets, subsets).collect()}
    assert (sets.count(), subsets.count(), len(loose)) == (n_sets, n_subsets, n_subsumable)


def test_set_clusters_against_sets(spark):
    rng = random.Random(3)
    family = {k: sorted({rng.randint(1, 9) for _ in range(rng.randint(1, 4))}) for k in range(40)}
    sets = sets_of(spark, family)
    groups = {}
    for k, v in family.items():
        groups.setdefault(tuple(v), []).append(k)
    named = {min(m): set(v) for v, m in groups.items()}
    want = {(a, b) for a, x in named.items() for b, y in named.items() if x < y}
    assert {tuple(r) for r in inference.strict_subsets(sets).collect()} == want


def test_summaries(spark):
    nan = math.nan
    matrix = [[3.99, nan, nan, 3.90], [3.03, nan, 3.25, nan], [1.45, nan, 1.45, 1.46], [0.505, nan, 0.512, 0.523]]
    rows = [(1, i, j, x * 1e8) for i, r in enumerate(matrix) for j, x in enumerate(r) if not math.isnan(x)]
    df = spark.createDataFrame(rows, "e long, r long, c long, x double")
    want = {
        "max_sum": [3.99, None, None, 3.90],
        "mean": [2.24, None, 1.74, 1.96],
        "mean_top3": [2.82, None, 2.35, 2.68],
        "median": [2.24, None, 1.45, 1.46],
        "sum": [8.98, None, 5.21, 5.88],
    }
    got = {m: {r["c"]: r["x"] / 1e8 for r in quant.summarise(df, "e", "r", "c", "x", m).collect()} for m in want}
    got["profile"] = {r["c"]: r["x"] / 1e8 for r in quant.median_profile(df, "e", "r", "c", "x").collect()}
    want["profile"] = [2.82, None, 2.94, 2.99]
    for method, values in want.items():
        for j, x in enumerate(values):
            assert got[method].get(j) == (None if x is None else pytest.approx(x, abs=0.01 * max(v for v in values if v)))
    with pytest.raises(NotImplementedError):
        quant.summarise(df, "e", "r", "c", "x", "best_score")


def test_normalise(spark):
    matrix = [[1, 1.2, 0.8], [1, 1.15, 0.82], [1, 1.25, 0.78], [1, 1.15, None], [1, None, 0.8]]
    rows = [(i, j, float(x)) for i, r in enumerate(matrix) for j, x in enumerate(r) if x is not None]
    out = quant.normalise(spark.createDataFrame(rows, "r long, c long, x double"), ["r"], "c", "x", 0)
    got = {(r["r"], r["c"]): r["abundance"] for r in out.collect()}
    assert got[3, 1] == pytest.approx(0.979167, abs=0.01)
    assert got[4, 2] == pytest.approx(1, abs=0.01)


def test_roc_edges(spark):
    points = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (3, 3), (3, 4), (4, 4), (5, 4), (6, 4), (6, 5), (6, 6)]
    curve = spark.createDataFrame([(float(-i), t, d) for i, (t, d) in enumerate(points)], "threshold double, target long, decoy long")
    kept = {(r["target"], r["decoy"]) for r in fdr.roc_edges(curve, []).collect()}
    assert kept == {(2, 0), (2, 1), (3, 1), (3, 2), (3, 3), (3, 4), (6, 4), (6, 5), (6, 6)}


def test_bh_against_numpy(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.exponential(10, 300), 1)
    got = {r["score"]: r["adjusted"] for r in fdr.bh_adjust(spark.createDataFrame([(float(x),) for x in s], "score double"), []).collect()}
    p = 10 ** (-s / 10)
    order = np.argsort(p)
    adjusted = np.minimum.accumulate((len(p) / np.arange(1, len(p) + 1) * p[order])[::-1])[::-1]
    for i, a in zip(order, adjusted, strict=True):
        assert got[s[i]] <= a + 1e-12
    assert got[s.max()] == pytest.approx(adjusted[0])


def test_fdr_formula(spark):
    assert one(spark, fdr.estimate(F.lit(438), F.lit(251))) == pytest.approx(72.86, abs=0.01)


def test_pretty_rank(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([10.0, 9.95, 9.85, 9.8, 5.0])], "q long, psm_id long, score double")
    ranks = lambda **how: [r["pretty_rank"] for r in ranking.pretty_rank(df, ["q"], **how).orderBy("psm_id").collect()]
    assert ranks() == [1, 1, 2, 2, 3]  # 9.85 is farther than 0.1 from the first of its rank, though not from the one before
    assert ranks(gaps=True) == [1, 1, 3, 3, 5]


def test_specific_sets(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3)], "set_id long, item long")
    scores = spark.createDataFrame([(1, 30.0), (2, 20.0), (3, 10.0)], "set_id long, score double")
    groups = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "set_id long, group long")
    got = {r["set_id"]: r["is_validated"] for r in filters.specific_sets(items, scores, 1, groups).collect()}
    assert got == {3: False, 2: True, 1: True}


def test_status_is_incremental(spark):
    df = spark.createDataFrame([(1.0, True), (5.0, False), (9.0, True)], "score double, is_validated boolean")
    assert [r["is_validated"] for r in filters.score(df, 4.0).collect()] == [False, False, True]
    assert [r["is_validated"] for r in filters.score(df, 4.0, incremental=False).collect()] == [False, True, True]
    stored = filters.apply_stored(df.drop("is_validated"), [("SCORE", 4.0), ("SCORE", 6.0)])
    assert [r["is_validated"] for r in stored.collect()] == [False, False, True]
    assert spark.range(5).filter(filters.tree({"and": ["id > 1", {"not": "id = 3"}]})).count() == 2


def test_boxes_against_loop(spark):
    rng = random.Random(2)
    make = lambda n, off: [(off + i, rng.randint(1, 2), rng.uniform(400, 410), rng.uniform(0, 500), 20.0) for i in range(n)]
    a, b = make(60, 0), make(60, 100)
    frame = lambda rows: spark.createDataFrame(rows, "feature_id long, charge int, mz double, t double, duration double")
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) < 0.5 and abs(x[3] - y[3]) < 120}
    got = [(r["l_feature_id"], r["r_feature_id"]) for r in rangejoin.boxes(frame(a), frame(b), ["charge"], 0.5, 100.0).collect()]
    assert len(got) == len(want)
    assert set(got) == want


def test_islands_and_chains(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.04), (3, 1.08), (4, 2.0), (5, 2.0)], "feature_id long, mz double")
    assert [r["island"] for r in cluster.islands(df.withColumn("k", F.lit(1)), ["k"], "mz", 0.05).orderBy("feature_id").collect()] == [1, 1, 1, 2, 2]
    parts = cluster.median_splits(df.withColumn("k", F.lit(1)), ["k"], 0.1)
    assert parts.select("part").distinct().count() == 2


def test_windows(spark):
    marks = [(1, float(t), math.sin(t / 3) * f) for t in range(20) for f in (0.9, 1.0, 1.1)]
    df = spark.createDataFrame(marks, "k long, t double, dt double")
    assert alignment.count_windows(df, ["k"], 3, 0.0).count() == 20
    assert alignment.time_windows(df, ["k"], 1.0, 0.0, 3).count() == 20
    kept = alignment.monotone(spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, -1.5), (1, 3.0, 0.0)], "k long, t double, dt double"), ["k"])
    assert [r["t"] for r in kept.orderBy("t").collect()] == [1.0, 3.0]


def test_conversion(spark):
    marks = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 3.0)], "k long, t double, dt double")
    f = spark.createDataFrame([(1, 0.0), (1, 15.0), (1, 99.0)], "k long, t double")
    assert [r["aligned_t"] for r in alignment.converted(f, marks, ["k"], 5.0).orderBy("t").collect()] == [1.0, 17.0, 102.0]


def test_numerics():
    assert numerics.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert numerics.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    x = np.arange(30.0)
    assert numerics.loess(x, 2 * x + 1) == pytest.approx(2 * x + 1)
    fitted = numerics.ratio_fit(np.array([[1.0, 2.0, 4.0], [2.0, 4.0, np.nan]]))
    assert fitted[1] / fitted[0] == pytest.approx(2)
    assert fitted[2] / fitted[1] == pytest.approx(2)


def test_normal_tail(spark):
    for z in (0.0, 0.5, 1.96, 4.0):
        assert one(spark, C.normal_two_sided(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
    assert one(spark, C.z_quantile(F.lit(0.975))) == pytest.approx(1.96, abs=1e-3)


def test_coverage_against_sets(spark):
    rng = random.Random(5)
    rows = [(k, s, s + rng.randint(0, 9)) for k in range(4) for s in [rng.randint(0, 60) for _ in range(20)]]
    got = {r["k"]: r["covered"] for r in ptm.coverage(spark.createDataFrame(rows, "k long, start long, stop long"), "k", F.lit(100)).collect()}
    for k in range(4):
        assert got[k] == len({p for kk, s, e in rows if kk == k for p in range(s, e + 1)})


def test_ptm(spark):
    assert one(spark, ptm.mass(F.lit("VLQAELK"))) == pytest.approx(799.480331, abs=0.02)
    assert one(spark, ptm.positions(F.lit("AXCA"), "A")) == [1, 2, 4]
    df = spark.createDataFrame([(1, "AB", ["p1"]), (2, "AB", ["p1"]), (3, "AC", ["p1"])], "peptide_id long, sequence string, ptms array<string>")
    assert {r[0]: r[1] for r in ptm.isomers(df).collect()} == {1: [2], 2: [1]}


def test_hierarchy(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "a")], "parent_id string, child_id string")
    closed = {(r["ancestor"], r["descendant"]) for r in hierarchy.closure(edges).collect()}
    assert ("a", "d") in closed
    assert ("c", "c") in closed  # a cycle ends
    assert [r[0] for r in hierarchy.leaves(edges).collect()] == ["d"]


def test_merging(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "x", 3)], "k long, mode string, n long")
    got = merge.common_or_default(df, ["k"], {"mode": F.lit("MIXED"), "n": F.lit(-1).cast("long")}).head()
    assert (got["mode"], got["n"]) == ("x", -1)


def test_weighted_counts(spark):
    links = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (2, 2, 4), (2, 3, 1)], "protein_id long, peptide_id long, n long")
    got = {r["protein_id"]: (r["basic"], r["specific"], r["weighted"]) for r in spectral.weighted(links).collect()}
    assert got == {1: (7, 3, 6.0), 2: (5, 1, 2.0)}


def test_storage(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id long, v string")
    assert storage.find_or_create(a, a.filter("id = 1"), ["id"]).count() == 1
    mapped = storage.remapped(a, spark.createDataFrame([(1, 9)], "old_id long, new_id long"), "id")
    assert sorted(r["id"] for r in mapped.collect()) == [2, 2, 9]
    assert storage.without_orphans(a, spark.createDataFrame([(1,)], "p long"), "id", "p").count() == 1
    assert storage.object_tree(a.filter("id = 1"), "id", "s").head()["clob_data"] == '{"v":"x"}'


def test_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    joined = t.select({"nation": ["n_name", "n_regionkey"], "region": ["r_name"]}, [("nation.n_regionkey", "region.r_regionkey")])
    assert joined.count() == 25
    assert t.by_ids("nation", spark.createDataFrame([(1,), (2,)], "k int"), "n_nationkey").count() == 2
    order = spark.createDataFrame([(2, 0), (1, 1)], "n_nationkey int, position int")
    assert [r["n_nationkey"] for r in in_order(t.table("nation"), order, "n_nationkey").collect()] == [2, 1]

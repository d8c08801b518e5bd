"""Results at the edges of SQL's own rounding, and work that may not grow faster than its input."""

from __future__ import annotations

import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandemflow.functions.columns import between
from tandemflow.functions import numerics
from tandemflow.operators import alignment, cluster, merge, quant
from tandemflow.plans import pipelines

from tandemflow.plans.abundance import _PROFILE

from .test_large import plan

_STEPS = """, z{n} AS (SELECT *, dt - lag(dt) OVER (PARTITION BY k ORDER BY t, dt) AS step FROM x{p}), y{n} AS (SELECT k, quantile_cont(step, 0.25) AS q1, quantile_cont(step, 0.75) AS q3 FROM z{n} GROUP BY 1)
    , x{n} AS (SELECT k, t, dt FROM z{n} JOIN y{n} USING (k) WHERE step IS NULL OR step BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1))"""


def test_fences_are_those_of_sql(spark):
    rng = np.random.default_rng(11)
    edge = [0.0, 4.5, 5.38, 8.41, 5.3, 0.84, 1.32, 6.25, 2.9, 0.0, 25.702500000000004]  # one ulp above a fence without its product's rounding
    rows = [(0, float(i), x) for i, x in enumerate(edge)]
    rows += [(k, float(rng.integers(0, 400)) / 8, round(float(rng.exponential(40)), 2) * (50 if i % 37 == 0 else 1)) for k in (1, 2) for i in range(900)]
    rows += [(1, None, 3.0), (1, 5.0, None), (1, 5.0, None), (2, 7.0, 1.0), (2, 7.0, 1.0), (3, 1.0, 1.0), (4, None, None)]
    con = duckdb.connect()
    con.register("marks", pa.table({"k": [r[0] for r in rows], "t": pa.array([r[1] for r in rows], pa.float64()), "dt": pa.array([r[2] for r in rows], pa.float64())}))
    want = con.sql("WITH x0 AS (SELECT k, t, dt FROM marks)" + "".join(_STEPS.format(n=i, p=i - 1) for i in (1, 2, 3)) + " SELECT k, t, dt FROM x3").fetchall()
    got = alignment.without_outliers(spark.createDataFrame(rows, "k long, t double, dt double").repartition(3), ["k"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    steps = alignment.stepped(spark.createDataFrame(rows, "k long, t double, dt double"), ["k"])
    assert re.search(r"lag\(dt[^(]*windowspecdefinition\(k#\w+, _bin#", plan(steps))  # a key's landmarks aren't put in order in one task


def test_quartile_rounds_as_sql(spark):
    rng = np.random.default_rng(12)
    pairs = [(float(a), float(b), s) for a, b in np.round(rng.uniform(-500, 500, (400, 2)), 2) for s in (0.0, 0.25, 0.5, 0.75)] + [(1.0, float("inf"), 0.5), (2.0, 2.0, 0.25)]
    con = duckdb.connect()
    want = [con.execute("SELECT quantile_cont(v, ?) FROM (SELECT unnest([?, ?]) AS v)", [s, min(a, b), max(a, b)]).fetchall()[0][0] for a, b, s in pairs]
    df = spark.createDataFrame([(i, min(a, b), max(a, b), s) for i, (a, b, s) in enumerate(pairs)], "i int, a double, b double, s double")
    got = [r["v"] for r in df.select("i", between(F.col("a"), F.col("b"), F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == want


def test_site_clusters_meet_equal_runs(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(260):
        start, n = int(rng.integers(1, 20)), int(rng.integers(0, 9))
        held = sorted(int(p) for p in rng.choice(np.arange(start, start + n + 1), min(n, int(rng.integers(0, 4))), replace=False))
        held += [int(rng.integers(1, 30))] * int(rng.integers(1, 3)) if i % 9 == 0 else []  # outside of the match, or twice
        rows.append((i % 3, int(rng.integers(0, 120)), start, None if i % 50 == 7 else start + n, [(p, "ab"[p % 2]) for p in held]))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "protein_id long, peptide_id long, start int, stop int, sites array<struct<position:int,ptm:string>>").repartition(3)
    k = [(p, q, a, b, tuple(sorted(s))) for p, q, a, b, s in rows if s]
    want = {(p, s, q, "isomorphic") for p, q, _, _, s in k}
    for p, q, a, b, own in k:
        for c in {s for pp, _, _, _, s in k if pp == p}:
            others = [x for x, _ in set(c) - set(own)]
            free = all(x < a for x in others) if b is None else not any(a <= x <= b for x in others)
            if len(c) > len(own) and set(own) <= set(c) and free:
                want.add((p, c, q, "partially isomorphic"))
    out = cluster.site_clusters(df)
    assert sorted((r["protein_id"], tuple(map(tuple, r["sites"])), r["peptide_id"], r["status"]) for r in out.collect()) == sorted(want)
    assert re.search(r"Join \[[^]]*xxhash64|Join \[[^]]*_at#", plan(out)), plan(out)


def test_ratio_fits_of_many_matrices(spark):
    rng = np.random.default_rng(14)
    cells = [(f"e{e}", f"r{r}", int(c), float(rng.choice([0.0, *rng.lognormal(5, 1, 30)]))) for e in range(90) for r in range(e % 5 + 1) for c in (3, 1, 9, 4)[: e % 4 + 1] if rng.random() < 0.7]

    def one(of):  # pair by pair, as a single matrix was fitted
        rows, cols = sorted({r for _, r, _, _ in of}), sorted({c for _, _, c, _ in of})
        x = np.full((len(rows), len(cols)), np.nan)
        for _, r, c, v in of:
            x[rows.index(r), cols.index(c)] = v
        logs, a, b = np.log(np.where(x > 0, x, np.nan)), np.zeros((len(cols),) * 2), np.zeros(len(cols))
        for i in range(len(cols)):
            for j in range(i + 1, len(cols)):
                d = logs[:, j] - logs[:, i]
                d = d[~np.isnan(d)]
                if len(d):
                    a[[i, j], [i, j]] += 1
                    a[[i, j], [j, i]] -= 1
                    b[[j, i]] += np.median(d) * np.array([1, -1])
        linked = a.diagonal() > 0
        if not linked.any():
            return dict(zip(cols, np.nansum(x, axis=0)))
        f = np.where(linked, np.exp(np.linalg.lstsq(a, b, rcond=None)[0]), np.nan)
        return dict(zip(cols, f * np.nansum(x[:, linked]) / np.nansum(f)))

    got = quant.fitted_ratios(spark.createDataFrame(cells, "e string, r string, c int, x double").repartition(3), "e", "r", "c", "x", tasks=3).collect()
    want = {(e, c): v for e in {x[0] for x in cells} for c, v in one([x for x in cells if x[0] == e]).items()}
    assert len(got) == len(want)
    for g in got:
        assert np.nan_to_num(np.nan if g["x"] is None else g["x"], nan=-1.0) == pytest.approx(np.nan_to_num(want[g["e"], g["c"]], nan=-1.0), rel=1e-9)
    begin = time.perf_counter()
    numerics.ratio_fits(rng.lognormal(5, 1, (20000, 4, 5)))
    assert time.perf_counter() - begin < 2.5  # one by one it took more than a tenth of a millisecond a pair


def test_profile_reads_its_rows_once(spark):
    rng = np.random.default_rng(15)
    cells = [(e, r, c, float(rng.choice([1.0, 2.0, 4.0, 7.0]))) for e in range(40) for r in range(5) for c in (2, 5, 6, 9) if rng.random() < 0.7]
    out = quant.median_profile(spark.createDataFrame(cells, "e int, r int, c int, x double").repartition(3), "e", "r", "c", "x")
    con = duckdb.connect()
    con.register("quant", pa.table({"entity_id": [c[0] for c in cells], "row_id": [c[1] for c in cells], "qc_id": [c[2] for c in cells], "raw_abundance": [c[3] for c in cells]}))
    want = con.sql("WITH " + _PROFILE.lstrip(", ")).fetchall()
    got = {(r["e"], r["c"]): r["x"] for r in out.collect()}
    assert got.keys() == {(e, c) for e, c, _ in want}
    assert all(got[e, c] == pytest.approx(x, abs=6e-3) for e, c, x in want)
    assert "ExistingRDD" not in plan(out)  # all reads are of what was written once


def test_tree_merges_leaves_of_one_class_first(spark):
    rng = np.random.default_rng(16)
    edges = [("R", "A"), ("R", "B"), ("A", "x1"), ("A", "x2"), ("A", "x3"), ("B", "x3"), ("B", "y"), ("x1", "z")]  # x3 is below two nodes, x1 holds matches and a child
    psms = [(i, int(rng.integers(0, 6)), float(rng.integers(0, 4)), str(rng.choice(["x1", "x2", "x3", "y", "z", "lost"]))) for i in range(300)]
    seen = []
    real = merge.aggregated_again
    try:
        merge.aggregated_again = lambda df, key: seen.append(df.count()) or real(df, key)
        out = pipelines.merged_tree(spark.createDataFrame(psms, "psm_id long, peptide_id long, score double, leaf string"), spark.createDataFrame(edges, "parent_id string, child_id string"), "leaf")
    finally:
        merge.aggregated_again = real
    holders = {"x1": "AR", "x2": "AR", "x3": "ABR", "y": "BR", "z": ["x1", "A", "R"]}
    met: dict = {}
    for i, p, s, leaf in psms:
        for n in holders.get(leaf, []):
            met.setdefault((n, p), []).append((s, -i))
    assert sorted(map(tuple, out.select("node", "peptide_id", "best_psm_id", "score", "spectral_count").collect())) == sorted((n, p, -max(m)[1], max(m)[0], len(m)) for (n, p), m in met.items())
    assert seen == [6 * (2 + 3 + 2 + 3)]  # x1 and x2 are one class: by leaf it would be 6 * 12

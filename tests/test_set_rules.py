"""The best threshold pair of single- and multi-item sets, against brute force."""

from __future__ import annotations

import random

import pytest

from tandemflow.operators import fdr

FDR = {"two_fold": lambda t, d: 200 * d / (t + d), "plain": lambda t, d: 100 * d / t if t else 1e9, "corrected": lambda t, d: 100 * (d + 1) / t if t else 1e9}


@pytest.mark.parametrize(("method", "expected", "seed"), [("two_fold", 10.0, 1), ("two_fold", 12.5, 2), ("plain", 6.1, 3), ("corrected", 9.0, 4)])
def test_optimal_set_rules_on_skewed_scores(spark, method, expected, seed):
    rng = random.Random(seed)
    rows = [(rng.choice((1, 2, 3)), float(rng.randint(1, 60)), None) for _ in range(400)]
    rows = [(n, s, rng.random() < 0.5 / (1 + s / 10)) for n, s, _ in rows] + [(1, 1e9, False), (2, 1e9, False)]
    curve = lambda kind: [(at, sum(s >= at and not d for _, s, d in kind), sum(s >= at and d for _, s, d in kind)) for at in {s for _, s, _ in kind}]
    single, multi = curve([r for r in rows if r[0] == 1]), curve([r for r in rows if r[0] > 1])
    pairs = [(-(mt + st), FDR[method](mt + st, md + sd), m, s, md + sd) for m, mt, md in multi for s, st, sd in single]
    t, f, m, s, d = min(p for p in pairs if p[1] <= expected)
    got = fdr.optimal_set_rules(spark.createDataFrame(rows + [(1, None, False)], "n_items int, score double, is_decoy boolean"), expected, method).collect()
    assert [tuple(r) for r in got] == [(m, s, -t, d, pytest.approx(f))]

"""Near-duplicates, urls, vectors, quality, components: brute force on small tables, and odd inputs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemflow.llm import ann, components, covertree, neardup, quality, urls

from .conftest import SCHEMA, clashing


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(t: str | None, size: int) -> set:
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def linked(docs: dict, size: int) -> tuple[dict, dict]:
    sets = {k: shingles(t, size) for k, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, roots(docs, links)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for x in links for n in x}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs[len(docs)] = " ".join(own)
    for size in (4, 5):
        rows = neardup.link(spark.createDataFrame([(k, t, None, None, None) for k, t in docs.items()], SCHEMA), size=size).collect()
        sets, want = linked(docs, size)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {k: (len(sets[k]), want[k], want[k] == k) for k in docs}


def test_second_search_in_blocks(spark, monkeypatch):
    """Many variants of one text, most of them not similar enough: bands of several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = {}
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
        docs[k] = " ".join(own)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(spark.createDataFrame([(k, t, None, None, None) for k, t in docs.items()], SCHEMA), size=4).collect()}
    assert got == linked(docs, 4)[1]


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9):
        both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        n = int(900 * (1 - share) / (2 * share))
        x, y = (np.r_[both, rng.integers(0, 1 << 63, n, dtype=np.uint64)] for _ in range(2))
        for samples, bits in ((neardup.SAMPLES, neardup.BITS), (neardup.FINE_SAMPLES, neardup.FINE_BITS)):
            a, b = (neardup.odd_sketch(neardup.samples(np.sort(s), samples), bits) for s in (x, y))
            assert np.bitwise_count(a ^ b).sum() <= neardup.sketch_bound(80, samples, bits)


def test_near_duplicates_odd(odd_docs, no_docs, odd_rows):
    rows = neardup.link(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    sets, want = linked({i: t for i, t, *_ in odd_rows if i is not None}, 5)
    for r in rows:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert neardup.link(no_docs).collect() == []
    kept = neardup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 2


def test_ids_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, None, None, None), (2, a, None, None, None), (2, b, None, None, None), (3, b, None, None, None)]
    got = [(r["doc_id"], r["component_id"]) for r in neardup.link(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 1), (3, 1)]


URLS = [
    "https://a.ORG/x", "http://example.org/es/1", "https://www.example.org/en/12?x", "https://www.example.org/en/2", "http://example.org", "ftp://b.com/fr/", "http://b.com/de/x#y", "http://notexample.org/es/",
    None, "no scheme", "", "http://x.net/casino-bonus/poker", "http://library.x.net/en/history", "a://b://c/d", "https://com/fr/?q", "http://xcom/fr/", "http://a.org?x=/fr/",
]


def judged(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_urls(spark):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    for r in urls.filter_urls(pages).collect():
        host, path, rule, verdict = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
        if r["page_id"] == 11:
            assert r["verdict"] == "block"
        if r["page_id"] == 12:
            assert r["verdict"] == "allow"
    assert urls.filter_urls(pages.limit(0)).collect() == []


def scores_of(weights: np.ndarray, found: list[str]) -> np.ndarray:
    """The model by its definition: n-grams one by one."""
    out = []
    for u in found:
        z = weights[-1]
        for text, salt in zip(urls.split_url(u), (1, 2), strict=True):
            raw = f"^{text}$".encode()
            grams = []
            for n in urls.GRAMS:
                for i in range(len(raw) - n + 1):
                    h = salt * 31 + n
                    for c in raw[i : i + n]:
                        h = (h * 0x100000001B3 & (1 << 64) - 1) ^ c
                    grams.append((h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - urls.BITS)
            z += sum(weights[g] for g in grams) / max(len(grams), 1) ** 0.5
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


def test_url_model_on_held_out_urls(spark):
    kept, left = urls.training_table()
    assert len(left) >= 300
    right = []
    for fold in (0, 1):
        w = urls.train([u for i, u in enumerate(kept) if i % 5 != fold], [u for i, u in enumerate(left) if i % 5 != fold])
        aside = [u for i, u in enumerate(kept) if i % 5 == fold], [u for i, u in enumerate(left) if i % 5 == fold]
        right.append([(scores_of(w, aside[0]) < 0.5).mean(), (scores_of(w, aside[1]) >= 0.5).mean()])
    assert np.mean(right, axis=0)[0] >= 0.98
    assert np.mean(right, axis=0)[1] >= 0.8
    some = [u for u in kept[:150] + left[:150] if not judged(u)[2]]
    w = urls.train()
    rows = urls.filter_urls(spark.createDataFrame(list(enumerate(some)), "page_id long, url string"), weights=w).collect()
    got, want = {r["page_id"]: r for r in rows}, scores_of(w, some)
    assert [got[i]["score"] for i in range(len(some))] == pytest.approx(want)
    assert [got[i]["verdict"] == "block" for i in range(len(some))] == (want >= 0.5).tolist()


def test_nearest_with_repeated_ids(spark):
    """Rows of one id are one candidate, by the nearest vector, and one query, of the smallest."""
    x = np.random.default_rng(4).normal(size=(40, 4)).astype(np.float32)
    ids = [i // 2 for i in range(40)]
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)] * 2
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 5 == 0, shard_rows=15).collect()
    d = x.astype(np.float64)
    for q in (0, 5, 10, 15):
        vector = min(d[2 * q].tolist(), d[2 * q + 1].tolist())
        far = np.sqrt(((d - vector) ** 2).sum(axis=1)).reshape(-1, 2).min(axis=1)
        want = sorted((far[i], i) for i in range(20) if i != q)[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [g[:2] for g in got] == [(n, i) for n, (_, i) in enumerate(want, 1)]
        assert [g[2] for g in got] == pytest.approx([s for s, _ in want], abs=1e-12)
    assert len(found) == 40


def vectors_of(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


ODD_VECTORS = [(900, None, 0), (901, [0.0] * 8, 0), (902, [None] + [1.0] * 7, 0), (903, [float("nan")] + [1.0] * 7, 0), (904, [float("inf")] * 8, 0), (905, [], 0), (906, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:70] = x[0]
    table = clashing(vectors_of(spark, x, ODD_VECTORS))
    rows = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0, shard_rows=150).collect():
        rows[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 600, 100):
        far = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        got = sorted(rows[q])
        assert [g[0] for g in got] == list(range(1, 11))
        hit += len(set(order) & {g[1] for g in got})
        total += 10
        assert [g[2] for g in got] == pytest.approx([far[g[1]] for g in got], abs=1e-12)
    assert hit / total >= 0.95
    assert sorted(rows[0])[0][1:] == (50, 0.0)
    assert 900 not in rows
    assert rows.keys() <= set(range(0, 600, 100)) | {906}
    few = ann.nearest(vectors_of(spark, x[:4]), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert ann.nearest(vectors_of(spark, x[:2]).limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("block", [16, 4096])
def test_cosine_links(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    x = (centres[rng.integers(0, 60, 240)] + rng.normal(scale=0.18, size=(240, 8))).astype(np.float32)
    x[30:45] = x[0]
    x[45] = 3 * x[1]
    table = clashing(vectors_of(spark, x, ODD_VECTORS))
    d = x.astype(np.float64)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    near = u @ u.T >= 0.9
    n = near.sum(axis=1) - 1
    want = roots(range(240), zip(*np.nonzero(near), strict=True))
    seen = 0
    for r in covertree.link(table, block=block).collect():
        seen += 1
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        elif r["vec_id"] >= 900:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert seen == 248
    assert covertree.link(table.limit(0)).collect() == []


def test_cover_tree_is_nested():
    x = covertree.unit(np.random.default_rng(1).normal(size=(300, 3)))
    open_ = [covertree.cover_tree(x)]
    assert len(open_[0].points) == 300
    while open_:
        node = open_.pop()
        assert (covertree._apart(x[node.points], x[node.centre : node.centre + 1]) <= node.radius + 1e-7).all()
        if node.children:
            assert sorted(p for c in node.children for p in c.points) == sorted(node.points)
            assert all(c.radius <= node.radius / 2 + 1e-7 for c in node.children)
        open_ += node.children


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    given = labels.filter(F.col("doc_id") % 3 != 0)
    rows = {r["doc_id"]: r for r in quality.classify(docs, given).collect()}
    assert len(rows) == docs.count()
    held = [(r["quality"], rows[r["doc_id"]]["kept"]) for r in labels.filter(F.col("doc_id") % 3 == 0).collect() if r["quality"] is not None]
    assert sum((q == 1) == k for q, k in held) / len(held) > 0.95


def test_cotraining_beats_labels_alone():
    """Views that are independent given the class: pseudo-labels lift what a few labels give."""
    rng = np.random.default_rng(12)
    n, size = 1200, 60
    y = rng.integers(0, 2, n)

    def view(of: int):
        seen = np.where(rng.random((n, 6)) < 0.7, rng.integers(0, size // 2, (n, 6)) + (size // 2) * y[:, None], rng.integers(0, size, (n, 6)))
        return np.repeat(np.arange(n), 6), seen.ravel(), np.ones(6 * n)

    views = view(quality.CONTENT), view(quality.METADATA)
    given = np.full(n, -1)
    given[:40] = y[:40]
    right = {}
    for rounds in (0, quality.ROUNDS):
        model = quality.cotrain(*views, given, rounds=rounds)
        right[rounds] = ((model.score(*views, n) >= 0.5) == (y == 1))[40:].mean()
        each = [((v.raw(*x, n) >= 0) == (y == 1))[40:].mean() for v, x in zip((model.content, model.metadata), views, strict=True)]
    assert right[quality.ROUNDS] > right[0]
    assert right[quality.ROUNDS] >= max(each) - 0.01


def test_quality_sample_is_bounded(spark):
    rows = [(1, f"a text {i}", "s", "en") for i in range(3000)] + [(i, f"other words {i} " * (i % 3 + 1), "s", "en") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    seen = []
    plain, quality.cotrain = quality.cotrain, lambda *a, **k: seen.append(len(a[2])) or plain(*a, **k)
    try:
        quality.fit(docs, labels, labelled=40, pool=30)
        quality.fit(docs, labels.filter("doc_id < 30"), labelled=40, pool=30)
    finally:
        quality.cotrain = plain
    assert seen == [40, 59]


def test_quality_odd(spark, odd_docs, no_docs, odd_rows):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (3, 0, 0), (4, 0, 1), (None, 1, 0), (5, None, 0), (99999, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd_docs, labels).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, labels).collect() == []

"""Rows that share an id but not a text are no copies of each other."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tandemflow.llm import neardup

from .conftest import SCHEMA
from .test_groups import linked


def words(name: str) -> str:
    return " ".join(f"{name}{i}" for i in range(30))


def test_every_component_of_texts_keeps_one_row(spark):
    a, b = words("a"), words("b")
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ((1, a), (2, a), (2, b), (3, b))], SCHEMA)
    got = sorted((r["doc_id"], r["text"]) for r in neardup.deduplicate(docs).collect())
    assert [t for _, t in got] == [a, b]
    assert got == [(1, a), (2, b)]


def test_texts_of_one_id_stay(spark):
    own = [words(f"t{i}x") for i in range(12)]
    near = own[0].replace("t0x29", "changed")
    rows = [(7, t) for t in [*own, None, "", own[3], None]] + [(8, near), (9, own[1].upper()), (None, own[2])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumn("id", F.lit("x"))
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(7, t) for t in [*own, None, ""]] + [(None, own[2])], key=repr)
    texts = dict(enumerate(t for _, t in rows))
    assert {texts[r] for r in linked(texts, 5)[1].values()} <= {t for _, t in got}


def test_large_group_of_near_copies(spark, monkeypatch):
    """One group of variants around the bound: the links found are fewer than the rows compared, and none is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 4096)
    written = {}
    cut = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    rng = random.Random(8)
    docs = {}
    for k in range(700):
        own = words("w").split()
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        docs[k] = " ".join(own)
    rows = neardup.link(spark.createDataFrame([(k, t, None, None, None) for k, t in docs.items()], SCHEMA), size=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == linked(docs, 4)[1]
    near = written["neardup-near"].count()
    assert near and written["neardup-more"].count() < near
    assert written["neardup-star"].count() <= neardup.BANDS * len(docs)

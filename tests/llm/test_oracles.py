"""The SQL of near-duplicates and of cosine links gives what the operators give, on tables that hold links."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa

from tandemflow.llm import covertree, neardup

from .conftest import SCHEMA


def rows_of(sql: str, **tables: pa.Table) -> list[tuple]:
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    return sorted(con.sql(sql).fetchall())


def test_near_duplicates(spark):
    rng = random.Random(11)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(2, 90))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = "Other"
            docs.append("  ".join(own) if rng.random() < 0.2 else " ".join(own))
    docs += [None, "", " \t", "one", "ONE", "two words"]
    got = sorted(tuple(r) for r in neardup.link(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(docs)], SCHEMA), size=4).collect())
    assert got == rows_of(neardup.ORACLE_SQL, documents=pa.table({"doc_id": range(len(docs)), "text": docs}))
    assert sum(not r[3] for r in got) > 8


def test_cosine_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = [v.astype(np.float32).tolist() for v in centres[rng.integers(0, 20, 150)] + rng.normal(scale=0.2, size=(150, 16))]
    x += [x[0], [2 * c for c in x[1]], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    table = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x, pa.list_(pa.float32()))})
    got = sorted(tuple(r) for r in covertree.link(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")).collect())
    assert got == rows_of(covertree.ORACLE_SQL, embeddings=table)
    assert sum(r[1] > 0 for r in got) > 100

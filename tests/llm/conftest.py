from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("id", "class", "size", "target", "score", "key", "row", "vector", "node", "component", "text_hash", "template", "spans", "repeats", "whole", "bin", "order", "rejected")


def clashing(df):
    """``df`` with extra columns of names that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(20000))
    base = " ".join(rng.choice(words) for _ in range(60))
    near = base.replace(base.split()[-1], "changed", 1)
    texts = [None, "", "   \n\t", "one", "123 !? 456", "é à ñ", long, base, base, base.upper(), near, "a b c d", "😀 <|endoftext|> it's", "MIT License", "\x00 nul\x1f", base + " tail"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[0], (None, base, "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return clashing(spark.createDataFrame(odd_rows, SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()

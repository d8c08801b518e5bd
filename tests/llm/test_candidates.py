"""Tokens without a digit and tokens behind a name are candidates for the test battery."""

from __future__ import annotations

import random
import string

from tandemflow.llm import secrets

from .conftest import SCHEMA

ORDINARY = ["internationalization-and-localization", "counterrevolutionaries", "UNCHARACTERISTICALLY", "some/path/to/a/folder/of/reports", "a-well-known-state-of-the-art-method", "electroencephalographically"]


def test_letters_and_values_behind_names(spark):
    rng = random.Random(9)
    draw = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    letters = [draw(string.ascii_letters, 40) for _ in range(30)]
    values = [draw("0123456789ABCDEF", 40) for _ in range(30)]
    padded = [draw(string.ascii_letters + string.digits + "+/", 42) + "==" for _ in range(30)]
    rows = [f"key {t} end" for t in letters] + [f"see sig={t} end" for t in values] + [f"see sig={t}, end" for t in padded] + [f"an {t} end" for t in ORDINARY]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], SCHEMA)
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(docs).collect()}
    assert sum(spans[i] == "random:4:44" for i in range(30)) >= 27
    assert sum(spans[30 + i] == "random:8:48" for i in range(30)) >= 18
    assert sum(spans[60 + i] == "random:8:52" for i in range(30)) >= 27
    assert not any(spans[90 + i] for i in range(len(ORDINARY)))


def test_tokens_of_a_text(spark):
    token = "aB3" * 8
    text = f"name={token} {token}==; {token}=={token}= short=abc= {token}.{token[:19]}"
    found = spark.createDataFrame([(text,)], "t string").select(secrets.located(secrets.F.col("t"), secrets.TOKEN).alias("x")).head()["x"]
    assert [x["hit"] for x in found] == [token, token + "==", token, token + "=", token]
    assert all(text[x["start"] :].startswith(x["hit"]) for x in found)

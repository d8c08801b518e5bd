"""The randomness test battery against numpy, its measured false-discovery rate, and what it finds beyond the patterns."""

from __future__ import annotations

import random
import re
import string
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tandemflow.llm import secrets

from .conftest import SCHEMA

WORDS = "the river carried small boats past quiet gardens where children waited for evening light and old songs drifted over stone walls toward distant hills".split()
BASE62 = string.ascii_uppercase + string.ascii_lowercase + string.digits


def measured(token: str) -> tuple[str, int, int]:
    """(encoding, length class, bin) by plain formulas."""
    name, _, alphabet, effect = next((e for e in secrets.ENCODINGS if re.search(e[1], token)), secrets.ENCODINGS[-1])
    token = token.lower() if re.fullmatch("[0-9A-F]+", token) else token
    n, k = len(token), len(alphabet)
    counts = np.array([token.count(c) for c in sorted(set(token))])
    chi = (counts**2).sum() * k / n - n
    freedom, far = k - 1, n * effect
    less = NormalDist().cdf((chi - freedom - far) / np.sqrt(2 * (freedom + 2 * far)))
    v = np.array([alphabet.index(c) for c in token]) - (k - 1) / 2
    turns = ((v[1:] > 0) != (v[:-1] > 0)).sum()
    runs = abs(turns - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    serial = abs((v[1:] * v[:-1]).sum()) / ((k * k - 1) / 12) / np.sqrt(n - 1)
    structure = min(1.0, 2 * 2 * NormalDist().cdf(-max(runs, serial)))
    return name, int(np.log2(n)), min(secrets.BINS, max(0, int(np.floor(-10 * np.log10(max(less * 7 / 12 / max(structure, 1e-40), 1e-40))))))


def draws(rng: random.Random) -> tuple[list[str], list[str]]:
    """(random tokens, ordinary ones)."""
    drawn = ["".join(rng.choice(a) for _ in range(rng.randint(20, 70))) for _ in range(60) for a in (BASE62, BASE62 + "+/", "0123456789abcdef")]
    joins = [lambda w: w, str.capitalize, lambda w: w + "-", lambda w: w + "/", lambda w: w.upper(), lambda w: f"{w}{rng.randint(1, 2030)}_"]
    plain = []
    for i in range(900):
        t, n = "", rng.randint(20, 60)
        while len(t) < n:
            t += joins[i % len(joins)](rng.choice(WORDS))
        plain.append(t)
    return drawn, plain + [string.ascii_lowercase, BASE62, "ab" * 20, "0123456789" * 4, "AAAAAAAAAAaaaaaaaaaa0000000000"]


def test_statistics(spark):
    tokens = [t for part in draws(random.Random(2)) for t in part]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()
    for r in got:
        name, length, level = measured(r["t"])
        assert (r["b"]["encoding"], r["b"]["length_class"]) == (name, length)
        assert abs(r["b"]["bin"] - level) <= 1, r["t"]  # the normal tail is an approximation


def test_false_discoveries(spark):
    drawn, plain = draws(random.Random(7))
    docs = spark.createDataFrame([(i, f"see {t} there", None, None, None) for i, t in enumerate(drawn + plain)], SCHEMA)
    found = {r["doc_id"] for r in secrets.digest(docs).filter("spans LIKE '%random%'").select("doc_id").collect()}
    false = sum(i >= len(drawn) for i in found)
    assert false <= secrets.RATE * len(found)
    assert len(found) - false >= 0.5 * len(drawn)


def test_beyond_the_patterns(spark):
    """Tokens that no fixed pattern names are found; runs that show structure are not."""
    rng = random.Random(4)
    tokens = ["".join(rng.choice(BASE62) for _ in range(48)) for _ in range(40)]
    rows = [f"value {t} here" for t in tokens] + [f"value {t} here" for t in (string.ascii_lowercase * 2, "0123456789" * 5, "abc" * 16)]
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], SCHEMA)).collect()}
    assert sum("random:6:54" in spans[i] for i in range(40)) >= 36
    assert not any("random" in spans[40 + i] for i in range(3))

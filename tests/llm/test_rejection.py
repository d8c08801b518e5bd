"""Language ID rejects junk by its calibrated confidence and leaves short clean texts, however few languages it knows."""

from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from tandemflow.llm import langid


@pytest.mark.parametrize("known", [("en", "es"), ("de", "en", "es", "fr")])
def test_junk_goes_and_short_texts_stay(spark, known):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*known))
    model = langid.fit(docs)
    junk = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(20)) for _ in range(200)]
    fresh = docs.filter(langid.held_out(F.col("doc_id"))).select("text").collect()
    short = [" ".join(r["text"].split()[:8]) for r in fresh]
    gone = lambda texts: langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).filter("rejected").count() / len(texts)
    assert len(short) > 80
    assert gone(junk) >= 0.9
    assert gone(short) <= 0.03
    assert gone([r["text"] for r in fresh]) <= 0.02


def test_hot_row_fills_no_sample(spark):
    hot = spark.range(20000).select(F.lit(4).alias("doc_id"), F.lit("en").alias("lang"), F.lit("the same words again").alias("text"))
    rest = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("words of number "), F.col("id").cast("string")).alias("text"))
    taken = langid.sample(hot.unionByName(rest), 600)
    assert taken.count() == 600
    assert taken.filter("text = 'the same words again'").count() <= 1
    assert langid.sample(hot, 600).count() == 1


def test_many_languages_are_all_learned(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8)))
    rows = []
    for n in range(300):
        own = [word() for _ in range(40)]
        rows += [(30 * n + k, f"l{n:03}", " ".join(rng.choice(own) for _ in range(60))) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert len(model.languages) == 300
    assert model.rows.nbytes <= 4 * langid.BUCKETS * langid.MOST_DIM
    judged = langid.predict(docs.filter(langid.held_out(F.col("doc_id"))), model)
    right, n, of = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.count_distinct("lang_pred")).head()
    assert n > 1000
    assert (right, of) >= (0.97, 290)

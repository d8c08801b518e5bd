"""The pipeline's stages, each against brute force on its own input, and the whole."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tandemflow.llm import mixing

from .test_groups import linked
from .test_texts import base_spans

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, sf_docs):
    docs = sf_docs
    language, dedup, scan, mix, tokens = (f for _, f in corpus_pipeline.STAGES)

    out = language(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert out.count() >= 0.98 * docs.count()
    assert language(spark, docs.withColumn("text", F.lit("12 34")), SF_DIR).count() == 0

    out = dedup(spark, docs, SF_DIR)
    want = linked({r["doc_id"]: r["text"] for r in docs.collect()}, 5)[1]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))
    assert out.columns == docs.columns

    out = {r["doc_id"]: r for r in scan(spark, docs, SF_DIR).collect()}
    for r in docs.collect():
        clean = out[r["doc_id"]]
        assert base_spans(clean["text"]) == ""
        assert clean["n_chars"] == len(clean["text"])
        if not base_spans(r["text"]) and clean["text"] != r["text"]:
            assert "[secret]" in clean["text"]

    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix_plan(docs).collect()}
    assert Counter(r["doc_id"] for r in mix(spark, docs, SF_DIR).collect()) == Counter({k: n for k, n in repeats.items() if n})

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in tokens(spark, docs.limit(20), SF_DIR).collect():
        assert r["tokens"] == library.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["tokens"])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns[-2:] == ["n_tokens", "tokens"]
    assert out.count() > 100


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "pipeline" in names


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Columns of names that stages use inside or add stay as they are; nulls, repeats and empty tables pass."""
    names = {c: F.lit("mine") for c in ("tokens", "n_tokens", "decoded", "lang_pred", "bpe_row", "mix_row", "scan_row", "dedup_row", "lang_row", "Text_Hash")}
    for docs in (odd_docs.withColumns(names), no_docs.withColumns(names)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            own = ["bpe_n_tokens", "bpe_tokens"] if name == "bpe_round_trip" else []
            assert out.columns == docs.columns + own, name
            rows = out.collect()
            assert all(r[c] == "mine" for r in rows for c in names), name
            assert all(r["score"] == "x" for r in rows), name
            if name == "language_id":
                assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in rows)
            elif name in ("secret_scan", "bpe_round_trip"):
                assert len(rows) == n
                assert sum(r["text"] is None for r in rows) == (3 if n else 0)
            if name == "bpe_round_trip":
                assert all(r["bpe_n_tokens"] == len(r["bpe_tokens"]) for r in rows)


def test_run_keeps_other_columns(spark, sf_docs, tmp_path):
    sf_docs.withColumn("tokens", F.lit("mine")).withColumn("score", F.lit(-7.0)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*sf_docs.columns, "tokens", "score", "n_tokens", "bpe_tokens"]
    assert [tuple(r) for r in out.select("tokens", "score").distinct().collect()] == [("mine", -7.0)]

"""Blocks of texts that bring no new piece to the tokenizer."""

from __future__ import annotations

from tokenizers import Tokenizer

from tandemflow.llm import bpe

from .conftest import SCHEMA
from .test_texts import BPE


def test_bpe_of_empty_texts_only(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([None, "", None])], SCHEMA).coalesce(1)
    assert [r["n_tokens"] for r in bpe.digest(docs, BPE).collect()] == [0, 0, 0]
    assert [(r["tokens"], r["decoded"]) for r in bpe.encode(docs, BPE).collect()] == [([], "")] * 3


def test_bpe_of_blocks_whose_pieces_are_cached(spark):
    own, library = bpe.Tokenizer(bpe.read(BPE)), Tokenizer.from_file(BPE)
    cache = bpe._Cache(own)
    for texts in (["one two"], ["one two", " two"], [""], ["<|endoftext|>"], ["<|endoftext|>one"], ["three"]):
        ids, bounds = cache.encode(texts)
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    long = "one two three " * 400_000  # over BLOCK_BYTES: each is a block of its own
    docs = spark.createDataFrame([(i, long, None, None, None) for i in range(2)], SCHEMA).coalesce(1)
    a, b = bpe.digest(docs, BPE).collect()
    assert a[1:] == b[1:] and a["n_tokens"] > 1_000_000

"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined to the positions of the same k-grams in a
table of license templates.  A hit votes for the diagonal ``word - template position``.  Votes are
counted on each diagonal, neighbouring diagonals (words put in or left out) are merged, and a
merged span is kept when the words of its hits cover enough of the template and of the span.  The base phrases are templates too, with k of 2: a place is a
diagonal with all votes.

The template table is a parameter of fixed size, not data, so its join side is broadcast.  Only
hits are shuffled.  Each document sends one more row that hits a marker in the template table;
it carries the word count and brings documents without any hit through the same aggregation.

Defined results: a null text is empty and has no words; a document is grouped by id and text
hash, so a null id is a value like any other, repeated ids with other texts stay apart, and
repeated rows come back as often as they were; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as K
from .scratch import cut

PHRASE_K, TEMPLATE_K = 2, 4
#: Words of one row of gram hashes; a longer text gives several rows.
ROW_WORDS = 1 << 16
#: Diagonals this near to each other are one span.
NEAR = 3
#: Least share of a template's words, and of a span's, that hits must cover.
TEMPLATE_SHARE, SPAN_SHARE = 0.7, 0.6


@dataclass(frozen=True)
class Template:
    """A label and the text that stands for it; base phrases must match word for word."""

    label: str
    text: str
    base: bool = False


#: The base phrases, and opening passages and notices of common licenses.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license see the file license for details"),
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)
MARKER = -1


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text_hash, n_words, base, k, grams): the gram at base + i starts at that word."""
    for batch in K.blocks(batches, "text"):
        data, offsets = K.string_buffers(batch.column("text"))
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, K.LETTERED)
        hashes = K.range_hashes(data, starts, ends)
        rows: list[tuple[int, int, int, np.ndarray]] = []
        for i in range(batch.num_rows):
            own = hashes[first[i] : first[i + 1]]
            rows.append((i, 0, 0, np.array([_marker()], dtype=np.uint64)))
            for k in (PHRASE_K, TEMPLATE_K):
                grams = K.gram_hashes(own, k)
                rows += ((i, at, k, grams[at : at + ROW_WORDS]) for at in range(0, len(grams), ROW_WORDS))
        owner = np.array([r[0] for r in rows])
        flat = np.concatenate([r[3] for r in rows]).view(np.int64)
        bounds = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
        n_words = np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(owner)),
                batch.column("text_hash").take(pa.array(owner)),
                pa.array(n_words[owner], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
            ],
            ["id", "text_hash", "n_words", "base", "k", "grams"],
        )


def _marker() -> int:
    return K.word_hash("\x00document\x00")


def template_positions(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int]]:
    """(k, hash, template, position) of every k-gram of every template, and the marker."""
    out = [(0, _marker(), MARKER, 0)]
    for t, template in enumerate(templates):
        hashes = np.array([K.word_hash(w) for w in template.text.split()], dtype=np.uint64)
        k = PHRASE_K if template.base else TEMPLATE_K
        out += ((k, int(h), t, p) for p, h in enumerate(K.gram_hashes(hashes, k)))
    return [(k, h - (1 << 64) if h >> 63 else h, t, p) for k, h, t, p in out]


def hits(docs: DataFrame, templates: tuple[Template, ...], doc_id: str, text: str) -> DataFrame:
    """(id, text_hash, n_words, template, word, position): every k-gram of every text met in a template."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    grams = texts.mapInArrow(_grams, f"id {kind}, text_hash long, n_words long, base long, k int, grams array<long>")
    known = spark.createDataFrame(template_positions(templates), "k int, gram long, template int, position int")
    each = grams.select("id", "text_hash", "n_words", "base", "k", F.posexplode("grams").alias("at", "gram"))
    # The table's size is that of the templates, whatever the number of texts.
    return each.join(F.broadcast(known), ["gram", "k"]).select("id", "text_hash", "n_words", "template", (F.col("base") + F.col("at")).alias("word"), "position")


def spans(found: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(id, text_hash, template, start, end, score) of the verified spans; end is exclusive."""
    spark = found.sparkSession
    # A template's number of k-grams, and k; as small as the template table.
    sizes = spark.createDataFrame(
        [(t, len(x.text.split()) - (PHRASE_K if x.base else TEMPLATE_K) + 1, PHRASE_K if x.base else TEMPLATE_K, x.base) for t, x in enumerate(templates)],
        "template int, n_grams int, k int, exact boolean",
    )
    key = ["id", "text_hash", "template"]
    diagonals = (
        found.filter(F.col("template") != MARKER)
        .withColumn("diagonal", F.col("word") - F.col("position"))
        .groupBy(*key, "diagonal")
        .agg(F.collect_set("position").alias("positions"), F.min("word").alias("low"), F.max("word").alias("high"))
        .join(F.broadcast(sizes), "template")
    )
    ordered = Window.partitionBy(*key).orderBy("low", "diagonal")
    gap = F.col("low") - F.coalesce(F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1 << 40))
    apart = F.col("exact") | (F.abs(F.col("diagonal") - F.lag("diagonal").over(ordered)) > NEAR) | (gap > F.col("n_grams") + F.col("k"))
    merged = (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(ordered))
        .groupBy(*key, "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"),
            F.min("low").alias("start"),
            (F.max("high") + F.max("k")).alias("end"),
            F.max("n_grams").alias("n_grams"),
            F.max("k").alias("k"),
            F.max("exact").alias("exact"),
        )
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + F.col("k") - 1))))))
        .withColumn("share", F.col("covered") / (F.col("n_grams") + F.col("k") - 1))
    )
    near = (F.col("share") >= TEMPLATE_SHARE) & (F.col("covered") / (F.col("end") - F.col("start")) >= SPAN_SHARE)
    verified = F.when(F.col("exact"), F.size("positions") == F.col("n_grams")).otherwise(near)
    return merged.filter(verified).select(*key, "start", "end", F.least(F.col("share"), F.lit(1.0)).alias("score"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans.

    n_base, first_word and last_word are of the base phrases' places; labels are distinct, sorted
    and comma-joined; score is the best span's share of its template, 0 without any.
    """
    found = cut(hits(docs, templates, doc_id, text), "license-hits")
    labels = F.array(*(F.lit(t.label) for t in templates))
    bases = F.array(*(F.lit(t.base) for t in templates))
    span = spans(found, templates).select("id", "text_hash", F.struct(F.col("start"), F.col("end"), labels[F.col("template")].alias("label"), bases[F.col("template")].alias("base"), F.col("score")).alias("span"), F.lit(0).alias("rows"), F.lit(None).cast("long").alias("n_words"))
    rows = found.filter(F.col("template") == MARKER).select("id", "text_hash", F.lit(None).cast(span.schema["span"].dataType).alias("span"), F.lit(1).alias("rows"), "n_words")
    docs_out = span.unionByName(rows).groupBy("id", "text_hash").agg(F.sum("rows").alias("rows"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_list("span")).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda s: s["label"]))), ",")
    return docs_out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        "spans",
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")

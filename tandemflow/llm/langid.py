"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of its subwords: the words, and the byte n-grams of each
word between marks, hashed into ``BUCKETS`` rows.  A linear softmax over the average gives the
languages.  Both layers are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled texts (at most ``SAMPLE`` for each language and ``TOTAL`` for all, but one of each
language at least, chosen by a hash of id and text); every language of the labels is learned.
Executors make the features of whole texts, so the driver gets bucket weights and no text, of a text
the ``FEATURES`` heaviest.  A part of the sample
sets the softmax temperature and the confidence below which a prediction is rejected: the
quantile that keeps all but ``COST`` of the rightly predicted texts, and of their first ``SHORT``
words, as a few words are predicted less surely than a whole text.

As everything behind the embeddings is linear, the model is sent as one row for each bucket: its
language scores, or its embedding where there are more languages than dimensions, so its size
doesn't grow with the labels.  Prediction is one Arrow pass over whole texts without a shuffle;
each distinct word of a block is scored once.

Defined results: a text that is null or has no letter gets ``und``, score 0, and is rejected; a
null id isn't held out and, like rows without a language, never learned from; without any
labelled row everything is ``und``; repeated rows are predicted alike; an empty table gives no
rows; :func:`predict` carries all columns, and puts ``new_`` before an own name that is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as K
from .names import free_name
from .scratch import cut

#: Dimensions of an embedding, for few languages and at most.
BUCKETS, DIM, MOST_DIM = 1 << 16, 16, 48
GRAMS = (2, 3, 4)
#: Labelled texts learned from, for each language and for all, and their heaviest buckets; every CALIBRATE-th text calibrates.
SAMPLE, TOTAL, FEATURES, CALIBRATE = 600, 4800, 1 << 14, 5
EPOCHS, BATCH, RATE = 6, 16, 0.5
#: Part of rightly predicted calibration texts, and of their first SHORT words, that rejection may cost.
COST, SHORT = 0.002, 5
UNKNOWN = "und"

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, code, first): subword buckets of each distinct word, the words of all texts, and each text's first."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, LETTERS)
    hashes = K.range_hashes(data, starts, ends)
    distinct, where, code = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (ends - starts)[where]
    # Each word as <word>, one after another.
    room = np.cumsum(np.r_[0, lengths + 2])
    marked = np.empty(room[-1], dtype=np.uint8)
    marked[room[:-1]], marked[room[1:] - 1] = 60, 62
    inner = np.ones(len(marked), dtype=bool)
    inner[room[:-1]] = inner[room[1:] - 1] = False
    order = np.repeat(starts[where] - np.cumsum(np.r_[0, lengths])[:-1], lengths) + np.arange(lengths.sum())
    marked[inner] = data[order]
    owner = np.repeat(np.arange(len(distinct)), lengths + 2)
    words, buckets = [np.arange(len(distinct))], [(distinct % np.uint64(BUCKETS)).astype(np.int64)]
    wide = marked.astype(np.uint64)
    for n in GRAMS:
        if len(marked) < n:
            continue
        h = np.full(len(marked) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + wide[j : len(marked) - n + 1 + j]
        same = owner[: len(h)] == owner[n - 1 :]
        words.append(owner[: len(h)][same])
        buckets.append((K.mix(h[same]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets), code, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, short, buckets, weights) of each text: what the average is made of."""
    for batch in K.blocks(batches, "text", 1 << 20):
        word, bucket, code, first = subwords(*K.string_buffers(batch.column("text")))
        by_word = np.argsort(word, kind="stable")
        bucket, bounds = bucket[by_word], np.searchsorted(word[by_word], np.arange(word.max(initial=-1) + 2))
        lists, weights = [], []
        for s, e in zip(first[:-1], first[1:], strict=True):
            own, n = np.unique(code[s:e], return_counts=True)
            sizes = np.diff(bounds)[own]
            at = np.repeat(bounds[own] - np.cumsum(np.r_[0, sizes])[:-1], sizes) + np.arange(sizes.sum())
            total = np.bincount(bucket[at], np.repeat(n, sizes), BUCKETS) if len(at) else np.zeros(BUCKETS)
            some = np.flatnonzero(total)
            if len(some) > FEATURES:
                some = np.sort(some[np.argpartition(-total[some], FEATURES)[:FEATURES]])
            lists.append(some.astype(np.int32))
            weights.append((total[some] / max(total[some].sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), batch.column("short"), pa.array(lists, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], ["lang", "order", "short", "buckets", "weights"])


@dataclass(frozen=True)
class Model:
    """A row of each bucket, the softmax layer over rows, its bias, its temperature and the least confidence that isn't rejected."""

    languages: tuple[str, ...]
    rows: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def chances(self, average: np.ndarray) -> np.ndarray:
        z = (average @ self.out + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, per_language: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", total: int = TOTAL) -> DataFrame:
    """(lang, order, text): at most ``per_language`` labelled texts of each language, and ``total`` of all, that aren't held out.

    Repeated rows count once.  Each language's rows are cut by a bound of their hash, set by its number of
    distinct rows, to about twice what is wanted before any is ordered, so that no task orders more.
    """
    usable = F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))
    rows = docs.filter(usable).select(F.xxhash64(F.col(doc_id).cast("string"), text).alias("order"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # At most twice the wanted rows and 64 are expected below the bound, and far too few by no chance worth naming.
    distinct = cut(rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")), "langid-languages")
    wanted = min(per_language, max(1, total // max(1, distinct.count())))
    share = F.least(F.lit(float(2 * wanted + 64)) / F.col("n"), F.lit(1.0))
    below = rows.select("lang", "order").join(distinct, "lang").filter((F.shiftrightunsigned("order", 11) / float(1 << 53)) <= share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = below.select("lang", "order").distinct().withColumn("nth", nth).filter(F.col("nth") <= wanted).select("lang", "order")
    # At most ``total`` rows, or one for each language.
    return rows.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"])


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds by row, buckets, weights) of the rows."""
    flat, weights = table.column("buckets").combine_chunks(), table.column("weights").combine_chunks()
    return np.r_[0, np.cumsum(flat.value_lengths().to_numpy())], flat.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy().astype(np.float64)


def fit(docs: DataFrame, per_language: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 1) -> Model | None:
    """A model from the sample of ``docs``; None without labelled rows."""
    taken = sample(docs, per_language, doc_id, text, lang)
    opening = F.array_join(F.slice(F.split(F.trim("text"), r"\s+", SHORT + 1), 1, SHORT), " ")
    both = taken.withColumn("cut", F.explode(F.array(F.struct(F.lit(False).alias("short"), F.col("text")), F.struct(F.lit(True).alias("short"), opening.alias("text")))))
    counted = both.select("lang", "order", "cut.*").mapInArrow(_counted, "lang string, order long, short boolean, buckets array<int>, weights array<float>")
    table = counted.toArrow().sort_by([("short", "ascending"), ("order", "ascending"), ("lang", "ascending")])
    table, openings = table.slice(0, table.num_rows // 2), table.slice(table.num_rows // 2)
    languages = tuple(sorted(set(table.column("lang").to_pylist())))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in table.column("lang").to_pylist()])
    bounds, ids, weights = _lists(table)
    calibrating = np.arange(len(y)) % CALIBRATE == 0
    if calibrating.all():
        calibrating[:] = False
    rng = np.random.default_rng(seed)
    dim = min(MOST_DIM, max(DIM, len(languages) // 4))
    embedding = rng.normal(0, 0.1, (BUCKETS, dim))
    out, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    learning = np.flatnonzero(~calibrating)
    share = np.bincount(y[learning], minlength=len(languages))
    balance = len(learning) / (len(languages) * np.maximum(share, 1))
    steps, done = EPOCHS * (len(learning) // BATCH + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(learning)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            which = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            bucket, weight = ids[which], weights[which]
            average = np.zeros((len(rows), dim))
            np.add.at(average, owner, embedding[bucket] * weight[:, None])
            z = average @ out + bias
            chance = np.exp(z - z.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(rows)), y[rows]] -= 1
            chance *= balance[y[rows]][:, None]
            back = chance @ out.T
            out -= rate * average.T @ chance
            bias -= rate * chance.sum(axis=0) / len(rows)
            # An average is over hundreds of subwords: their steps are scaled up by as many.
            np.add.at(embedding, bucket, -rate * 20 * back[owner] * weight[:, None])
    folded = len(languages) <= embedding.shape[1]
    embedding, out = (embedding @ out, np.eye(len(languages))) if folded else (embedding, out)
    model = Model(languages, embedding, out, bias, 1.0, 0.0)
    rows = np.flatnonzero(calibrating) if calibrating.any() else learning
    averaged = lambda bounds, ids, weights: np.stack([weights[bounds[r] : bounds[r + 1]] @ embedding[ids[bounds[r] : bounds[r + 1]]] for r in rows])
    average = averaged(bounds, ids, weights)
    loss = lambda t: -np.log(np.maximum(replace(model, temperature=t).chances(average)[np.arange(len(rows)), y[rows]], 1e-12)).mean()
    model = replace(model, temperature=float(min(np.geomspace(0.2, 5, 40), key=loss)))
    least = []
    for chance in (model.chances(average), model.chances(averaged(*_lists(openings)))):
        confident = np.sort(chance.max(axis=1)[chance.argmax(axis=1) == y[rows]])
        least.append(float(confident[int(COST * len(confident))]) if len(confident) else 0.0)
    return replace(model, rows=embedding.astype(np.float32), least=min(least))


def _predictor(model):
    """mapInArrow function over (lang_row, lang_text, lang_known)."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in K.blocks(batches, "lang_text", 2 << 20):
            n = batch.num_rows
            known = batch.column("lang_known").to_numpy(zero_copy_only=False)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if m is None:
                known = np.zeros(n, dtype=bool)
            else:
                word, bucket, code, first = subwords(*K.string_buffers(batch.column("lang_text")))
                size = int(word.max(initial=-1)) + 1
                count = np.bincount(word, minlength=size).astype(float)
                total = np.diff(np.r_[0, np.cumsum(count[code])][first])
                average = np.empty((n, m.rows.shape[1]))
                for j in range(m.rows.shape[1]):
                    of_word = np.bincount(word, m.rows[bucket, j], size)
                    average[:, j] = np.diff(np.r_[0, np.cumsum(of_word[code])][first]) / np.maximum(total, 1)
                chance = m.chances(average)
                best, score = chance.argmax(axis=1), chance.max(axis=1)
            names = np.array(m.languages if m else [""], dtype=object)[best]
            lang = pa.array(np.where(known, names, UNKNOWN), pa.string())
            score = np.where(known, score, 0.0)
            rejected = ~known | (score < (m.least if m else 0))
            yield pa.RecordBatch.from_arrays([batch.column("lang_row"), lang, pa.array(score), pa.array(rejected)], ["lang_row", "lang_pred", "score", "rejected"])

    return predicted


def judge(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as the struct lang_row, with lang_pred, score (calibrated confidence, 0 to 1) and rejected."""
    rows = docs.select(F.struct("*").alias("lang_row"), F.col(text).alias("lang_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lang_known"))
    kind = rows.schema["lang_row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the corpus
    return rows.mapInArrow(_predictor(shared), f"lang_row {kind}, lang_pred string, score double, rejected boolean")


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; an own name that ``docs`` has gets ``new_`` in front."""
    own = (F.col(c).alias(free_name(c, docs.columns, "new_")) for c in ("lang_pred", "score", "rejected"))
    return judge(docs, model, text).select("lang_row.*", *own)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row, by a model learned from ``docs``."""
    model = fit(docs, doc_id=doc_id, text=text, lang=lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")

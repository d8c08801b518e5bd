"""Quality classifier by co-training of a text-content and a page-metadata view.

The content view sees a text's words (hashed, averaged over the text) and how far they repeat.
The metadata view sees what surrounds them: source, language, length, lines, and the shares of
capitals, digits, marks and letters beyond ASCII.  Each view is a logistic regression in numpy.
In each round both views score a pool of unlabelled documents, and each gives the other its
most confident pseudo-labels.  Labelled rows kept aside calibrate each view (Platt scaling), and
the calibrated views are combined as independent evidence.

What is fitted is bounded: at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, chosen
by a hash of their ids, whole texts, brought to the driver as bucket weights.  The models have a fixed
size; scoring is one Arrow pass over whole texts of all documents, without a shuffle.

Defined results: a null text is empty; null metadata is a value of its own; a label that is null or
whose document is missing is not used; labels of one id count once, and not at all if they disagree; of
rows that share an id one is learned from; with labels of
fewer than two classes every score is that class's share, 0.5 without any; a null id is scored
like any other; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .scratch import cut

LABELLED, POOL = 3000, 3000
ROUNDS, GIVEN, CONFIDENT = 5, 60, 0.95
CALIBRATE = 4
BITS = 14
WORDS = 1 << BITS
BINS = 10
#: Content view: hashed words, then bins of repetition. Metadata view: bins of layout, then hashed source and language.
CONTENT, SHARES, NAMES = WORDS + 3 * BINS, 7, 1 << 10
METADATA = SHARES * BINS + NAMES
THRESHOLD = 0.5


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(mask)][offsets])


def _bin(share: np.ndarray) -> np.ndarray:
    return np.clip((share * BINS).astype(np.int64), 0, BINS - 1)


def views(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, weight) of the content and of the metadata view of (text, source, lang)."""
    data, offsets = K.string_buffers(batch.column("text"))
    n = batch.num_rows
    starts, ends, first = K.words(data, offsets, K.SPACED)
    hashes = K.range_hashes(K.LOWER[data], starts, ends)
    n_words = np.diff(first)
    row = np.repeat(np.arange(n), n_words)
    safe = np.maximum(n_words, 1)
    # Distinct words and distinct neighbours of each text.
    own = np.unique(K.mix(hashes ^ K.mix(row.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(row[own], minlength=n)
    again = np.bincount(row[1:], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), n) if len(row) else np.zeros(n)
    lengths = np.bincount(row, np.minimum(ends - starts, 20), n) / safe / 20
    rows = np.arange(n)
    content = (
        np.concatenate([row, rows, rows, rows]),
        np.concatenate([(hashes % np.uint64(WORDS)).astype(np.int64), WORDS + _bin(distinct / safe), WORDS + BINS + _bin(again / safe), WORDS + 2 * BINS + _bin(lengths)]),
        np.concatenate([4 / safe[row], np.ones(3 * n)]),
    )
    size = np.maximum(np.diff(offsets), 1)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower, space, wide = (data >= 97) & (data <= 122), ~K.SPACED[data], data >= 128
    lines = _counts(data == 10, offsets) + 1
    shares = [
        _counts(upper, offsets) / size,
        5 * _counts(digit, offsets) / size,
        2 * _counts(~(upper | digit | lower | space | wide), offsets) / size,
        _counts(wide, offsets) / size,
        _counts(space, offsets) / size * 2,
        np.log2(size) / 20,
        np.log2(size / lines + 1) / 14,
    ]
    names = []
    for column, salt in (("source", 1), ("lang", 2)):
        text = batch.column(column).cast(pa.string())
        d, o = K.string_buffers(text)
        h = K.range_hashes(d, o[:-1], o[1:]) + np.uint64(salt) + np.asarray(text.is_null()).astype(np.uint64) * np.uint64(7)
        names.append(SHARES * BINS + (K.mix(h) % np.uint64(NAMES)).astype(np.int64))
    metadata = (np.tile(rows, SHARES + 2), np.concatenate([i * BINS + _bin(s) for i, s in enumerate(shares)] + names), np.ones(n * (SHARES + 2)))
    return content, metadata


@dataclass
class View:
    """Logistic regression over sparse rows, with its Platt scaling."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[features] * values, n) + self.bias

    def evidence(self, *view) -> np.ndarray:
        """Calibrated log-odds."""
        return np.clip(self.slope * self.raw(*view) + self.shift, -12, 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_view(view: tuple, y: np.ndarray, size: int, steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> View:
    """AdaGrad on the mean log-loss, both classes of one weight. y: a label for each row, negative where not learned from."""
    row, feature, value = view
    learned = y >= 0
    ones, zeros = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / zeros) * learned
    use = learned[row]
    row, feature, value = row[use], feature[use], value[use]
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    b, b2 = 0.0, 1e-8
    for _ in range(steps):
        g = (_sigmoid(np.bincount(row, w[feature] * value, len(y)) + b) - np.maximum(y, 0)) * weight
        grad = np.bincount(feature, g[row] * value, size) + decay * w
        g2 += grad**2
        w -= rate * grad / np.sqrt(g2)
        gb = g.sum()
        b2 += gb**2
        b -= rate * gb / np.sqrt(b2)
    return View(w, b)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of Platt scaling, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * z + b)
        d = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * z).sum() + 0.05 * (a - 1), (p - y).sum() + 0.05 * b])
        h = np.array([[(d * z * z).sum() + 0.05, (d * z).sum()], [(d * z).sum(), d.sum() + 0.05]])
        step = np.linalg.solve(h, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


@dataclass(frozen=True)
class Model:
    content: View
    metadata: View
    prior: float

    def score(self, content: tuple, metadata: tuple, n: int) -> np.ndarray:
        """Chance of good quality: both views' evidence, the prior counted once."""
        return _sigmoid(self.content.evidence(*content, n) + self.metadata.evidence(*metadata, n) - self.prior)


def cotrain(content: tuple, metadata: tuple, y: np.ndarray, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """A model from rows labelled 0, 1 or -1 (the pool)."""
    n = len(y)
    labelled = np.flatnonzero(y >= 0)
    if len(np.unique(y[labelled])) < 2:
        share = float(np.clip(y[labelled].mean(), 0.01, 0.99)) if len(labelled) else 0.5
        prior = float(np.log(share / (1 - share)))
        return Model(View(np.zeros(CONTENT), 0.0, 1.0, prior), View(np.zeros(METADATA), 0.0, 1.0, prior), prior)
    aside = labelled[np.arange(len(labelled)) % CALIBRATE == 0]
    if len(np.unique(y[aside])) < 2:
        aside = labelled
    sees = [y.copy(), y.copy()]
    if len(aside) < len(labelled):
        for s in sees:
            s[aside] = -1
    pool = y < 0
    for turn in range(rounds + 1):
        models = [fit_view(content, sees[0], CONTENT), fit_view(metadata, sees[1], METADATA)]
        if turn == rounds or not pool.any():
            break
        for teacher, view, pupil in ((models[0], content, sees[1]), (models[1], metadata, sees[0])):
            p = _sigmoid(teacher.raw(*view, n))
            for label in (0, 1):
                sure = p if label else 1 - p
                open_ = np.flatnonzero(pool & (pupil < 0) & (sure >= CONFIDENT))
                pupil[open_[np.argsort(-sure[open_], kind="stable")[:given]]] = label
    for model, view in zip(models, (content, metadata), strict=True):
        model.slope, model.shift = calibrate(model.raw(*view, n)[aside], y[aside])
    share = float(np.clip(y[labelled].mean(), 1e-3, 1 - 1e-3))
    return Model(*models, float(np.log(share / (1 - share))))


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, label, content features and weights, metadata features and weights)."""
    for batch in K.blocks(batches, "text", 1 << 20):
        columns = []
        for (row, feature, weight), size in zip(views(batch), (CONTENT, METADATA), strict=True):
            key, at = np.unique(row * size + feature, return_inverse=True)
            total = np.bincount(at, weight, len(key))
            bounds = np.searchsorted(key // size, np.arange(batch.num_rows + 1)).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(bounds), pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(total))]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), *columns], ["order", "label", "cf", "cw", "mf", "mw"])


def _sparse(table: pa.Table, features: str, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = table.column(features).combine_chunks()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64), table.column(weights).combine_chunks().flatten().to_numpy()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", label: str = "quality") -> Model:
    """A model from at most ``labelled`` labelled and ``pool`` unlabelled documents, one row of each id.

    Ids are chosen among those that the documents have; labelled ids never take up room of the pool.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    known = known.select("id", F.when(F.col("label") == F.col("other"), F.col("label")).alias("label"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang")).filter("id IS NOT NULL")
    rows = rows.withColumn("row", F.xxhash64("text", "source", "lang"))
    # Ids and hashes alone are shuffled; an id of many rows is one row before the shuffle.
    ids = cut(rows.groupBy("id").agg(F.min("row").alias("row")).join(known.withColumn("known", F.lit(True)), "id", "left"), "quality-ids")
    first = lambda which, n, salt: which.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n)
    given = first(ids.filter("label IS NOT NULL"), labelled, "quality").select("id", "row", "label")
    free = first(ids.filter("known IS NULL"), pool, "pool").select("id", "row", F.lit(-1).alias("label"))
    # At most labelled + pool rows.
    taken = F.broadcast(cut(given.unionByName(free), "quality-taken"))
    rows = rows.join(taken, ["id", "row"]).dropDuplicates(["id"]).select(F.xxhash64("id", F.lit("quality")).alias("order"), "label", "text", "source", "lang")
    table = rows.mapInArrow(_viewed, "order long, label int, cf array<int>, cw array<double>, mf array<int>, mw array<double>").toArrow()
    table = table.sort_by([("order", "ascending"), ("label", "ascending")]) if table.num_rows else table
    if not table.num_rows:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return cotrain(none, none, np.zeros(0, np.int64))
    return cotrain(_sparse(table, "cf", "cw"), _sparse(table, "mf", "mw"), table.column("label").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, score (chance of good quality), content_score and metadata_score (each view's), kept (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in K.blocks(batches, "text", 2 << 20):
            content, metadata = views(batch)
            n = batch.num_rows
            total = m.score(content, metadata, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total), pa.array(_sigmoid(m.content.evidence(*content, n))), pa.array(_sigmoid(m.metadata.evidence(*metadata, n))), pa.array(total >= threshold)],
                ["doc_id", "score", "content_score", "metadata_score", "kept"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, score double, content_score double, metadata_score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents, scored by a model fitted on the labels."""
    return score(docs, fit(docs, labels))

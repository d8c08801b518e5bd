"""MinHash near-duplicates, with odd sketches for candidate verification.

1. One Arrow pass makes each document's shingle set, a 128-bit digest of it, ``BANDS * ROWS``
   MinHash samples, the key of each band of samples, and an odd sketch: the samples folded into a
   parity bitmap.  Two sketches differ in about one bit for each odd count of samples that only
   one side holds, so the population count of their XOR estimates the samples' overlap, and
   most precisely where it is high.
2. Documents of equal sets become one class, by a partial aggregation on the digest.
3. Every class is compared with the first class of each of its bands, so a band with any number
   of classes gives as many pairs as classes.  Pairs whose sketches are far apart are left out; the
   rest are confirmed on full shingle sets made from the texts.
4. Bands whose classes lie in different components afterwards are searched once more, block by
   block, by sketch and by a finer sketch of more samples.  What looks near to another component is
   sent with its full shingle set, and the task that compares two blocks confirms pairs on the sets until
   they are joined; it gives the links that join them, fewer than it has rows, whatever the number of pairs.
5. Components of the confirmed links.

Bands: two sets of similarity 0.8 share none of 40 bands of 5 samples with a chance of 1e-7.  The
sketch bounds lie 5 standard deviations beyond what a similarity of 0.8 gives.

Defined results: a null or blank text has no shingles and is linked with nothing; a text shorter
than a shingle is one shingle of all its words; a null id is linked with nothing, its component
is null and it is kept; rows that share an id are one node of :func:`link`'s graph, each keeps a row
of its own, but :func:`deduplicate` goes by texts and never takes two texts for copies because
they share an id; an empty table gives no rows; further columns are ignored by :func:`link` and carried by
:func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .components import components
from .scratch import cut

SHINGLE = 5
SIMILAR_PERCENT = 80
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch, and the most that may differ for a pair to be confirmed.
BITS = 512
#: Classes of a band in a block, shingles in a block that is compared exactly (or one longer text), and shingles hashed at once.
BLOCK, BLOCK_SHINGLES, STEP = 1024, 1 << 20, 2048

#: The finer sketch that step 4 makes of classes still in question.
FINE_SAMPLES, FINE_BITS = 2048, 8192

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 31, FINE_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32)


def sketch_bound(percent: int, samples: int = SAMPLES, bits: int = BITS, deviations: float = 5.0) -> int:
    """Most differing bits that sets of the similarity give, but for ``deviations`` standard deviations."""
    j = percent / 100
    items = 2 * samples * (1 - j)  # of one side only: each sample that differs gives two
    left = (1 - 2 / bits) ** items
    from_samples = 2 * np.sqrt(samples * j * (1 - j)) * left
    from_meetings = 2 * np.sqrt(items * items / (2 * bits))  # items that meet on a bit cancel
    return int(bits / 2 * (1 - left) + deviations * np.hypot(from_samples, from_meetings))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = K.string_buffers(column)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, K.SPACED)
    hashes = K.range_hashes(data, starts, ends)
    grams = K.gram_hashes(hashes, size)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= size:
            own = np.sort(grams[s : e - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            out.append(K.gram_hashes(hashes[s:e], e - s) if e > s else np.zeros(0, np.uint64))
    return out


def samples(shingles: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The MinHash samples of a set: for each of the first n permutations of 32 bits, the least value."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    step = STEP * SAMPLES // n
    for at in range(0, len(x), step):
        part = x[at : at + step, None] * _A[:n]
        part += _B[:n]
        np.minimum(least, part.min(axis=0), out=least)
    return least


_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SAMPLE = np.arange(FINE_SAMPLES, dtype=np.uint64) << np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    """64-bit key of each band of a set's samples."""
    out = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).astype(np.uint64).T:
        out = K.mix(out ^ column)
    return out


def odd_sketch(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    bit = (K.mix(_SAMPLE[: len(least)] | least.astype(np.uint64)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def _finely(size: int):
    def finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.blocks(batches, "text"):
            fine = [odd_sketch(samples(s, FINE_SAMPLES), FINE_BITS).view(np.int64) for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(fine, pa.list_(pa.int64()))], ["class", "fine"])

    return finely


def _signed(size: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.blocks(batches, "text"):
            sets = shingle_sets(batch.column("text"), size)
            digests, sketches, keys = [], [], []
            for s in sets:
                if not len(s):
                    digests.append(None)
                    sketches.append(None)
                    keys.append(None)
                    continue
                least = samples(s)
                both = np.array([np.bitwise_xor.reduce(K.mix(s)), K.mix(s * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64)])
                digests.append(both.tobytes())
                sketches.append(odd_sketch(least).view(np.int64))
                keys.append(band_keys(least).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "text_hash", "n_shingles", "class", "sketch", "bands"],
            )

    return signed


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of shingles are as similar as that, by their sizes first."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(size: int, percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in K.blocks([batch], "text_a"):
                for part in K.blocks([half], "text_b"):  # so both sides' texts are bounded
                    sets = zip(shingle_sets(part.column("text_a"), size), shingle_sets(part.column("text_b"), size), strict=True)
                    keep = pa.array([_similar(x, y, percent) for x, y in sets], pa.bool_())
                    yield part.select(["a", "b"]).filter(keep)

    return confirmed


def _shingled(size: int):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.blocks(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.list_(pa.int64()))], ["class", "shingles"])

    return shingled


class _Meeting:
    """The searches of a task: rows by (key, i, j), where each of the left meets each of the right."""

    def __init__(self, table: pa.Table, bound: int, fine_bound: int) -> None:
        self.table = table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        lists = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        self.sketch, self.fine, self.bands = lists("sketch").view(np.uint64), lists("fine").view(np.uint64), lists("bands")
        self.side = table.column("side").to_numpy()
        self.group = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        self.key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        change = np.flatnonzero((self.key[1:] != self.key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        self.ends = [0, *change.tolist(), table.num_rows]
        self.bound, self.fine_bound = bound, fine_bound

    def searches(self) -> Iterator[Iterator[tuple[int, np.ndarray]]]:
        for low, high in zip(self.ends[:-1], self.ends[1:], strict=True):
            yield self._search(low, high)

    def _search(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows of other components that are near by both sketches and share no earlier band)."""
        place = np.arange(low, high)
        left, right = place[self.side[low:high] != 1], place[self.side[low:high] != 0]
        for at in left.tolist():
            others = right[(self.group[right] != self.group[at]) & ((self.side[right] == 1) | (right > at))]
            near = others[np.bitwise_count(self.sketch[others] ^ self.sketch[at]).sum(axis=1) <= self.bound]
            near = near[np.bitwise_count(self.fine[near] ^ self.fine[at]).sum(axis=1) <= self.fine_bound]
            if len(near):
                near = near[self.bands[at][(self.bands[near] == self.bands[at]).argmax(axis=1)] == self.key[low]]
            if len(near):
                yield at, near


def _flagged(bound: int, fine_bound: int):
    """(key, class) of the rows that look near to one of another component."""

    def flagged(table: pa.Table) -> pa.Table:
        meeting = _Meeting(table, bound, fine_bound)
        seen = np.zeros(table.num_rows, dtype=bool)
        for search in meeting.searches():
            for at, near in search:
                seen[at] = seen[near] = True
        return meeting.table.select(["key", "class"]).filter(pa.array(seen))

    return flagged


def _joined(bound: int, fine_bound: int, percent: int):
    """Confirmed links (a, b) between components, no more of a search than join its rows: at most rows less one."""

    def joined(table: pa.Table) -> pa.Table:
        meeting = _Meeting(table, bound, fine_bound)
        lists = meeting.table.column("shingles").combine_chunks()
        values, ends = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        shingles = lambda row: values[ends[row] : ends[row + 1]]
        a, b = [], []
        for search in meeting.searches():
            for at, near in search:
                for other in near.tolist():
                    if meeting.group[at] != meeting.group[other] and _similar(shingles(at), shingles(other), percent):
                        meeting.group[meeting.group == meeting.group[other]] = meeting.group[at]
                        a.append(at)
                        b.append(other)
        nodes = meeting.table.column("class")
        return pa.table({"a": nodes.take(pa.array(a, pa.int64())), "b": nodes.take(pa.array(b, pa.int64()))})

    return joined


def _met(members: DataFrame, weight: Column, block: int, most: int) -> DataFrame:
    """``members`` (key, class, component, ...) dealt so that any two of a key and of different components meet once.

    The rows of a key's largest component needn't meet each other: they are dealt apart, and meet only the
    blocks of the rest.  So where one component holds nearly all, the copies grow with the rows
    and not with their square.  weight: of a row; a block holds about ``block`` of it and a task about ``most``.
    Adds i, j, side (0 left, 1 right, 2 both) and task.
    """
    weighed = members.withColumn("w", weight)
    by_component = weighed.groupBy("key", "component").agg(F.sum("w").alias("w"))
    sizes = by_component.groupBy("key").agg(F.max_by("component", F.struct("w", "component")).alias("largest"), F.max("w").alias("in_largest"), F.sum("w").alias("all"))
    sizes = sizes.filter("all > in_largest").select(
        "key", "largest", F.ceil(F.col("in_largest") / block).cast("int").alias("apart"), F.ceil((F.col("all") - F.col("in_largest")) / block).cast("int").alias("rest")
    )
    sizes = cut(sizes, "neardup-sizes")
    apart = F.col("component") == F.col("largest")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("class"), F.when(apart, F.col("apart")).otherwise(F.col("rest"))).cast("int")
    meets = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    # Blocks of the rest are 0, 1, ...; those of the largest component are -1, -2, ...
    of_largest = F.transform(upto(F.col("rest")), lambda o: meets(-1 - F.col("at"), o, F.lit(0)))
    of_rest = F.concat(
        F.transform(upto(F.col("rest")), lambda o: meets(F.least("at", o), F.greatest("at", o), F.when(F.col("at") == o, 2).when(F.col("at") < o, 0).otherwise(1))),
        F.transform(upto(F.col("apart")), lambda o: meets(-1 - o, F.col("at"), F.lit(1))),
    )
    placed = weighed.join(sizes, "key").withColumn("at", own).withColumn("m", F.explode(F.when(apart, of_largest).otherwise(of_rest)))
    placed = placed.drop("at", "largest", "apart", "rest").select("*", "m.*").drop("m")
    total = by_component.join(sizes, "key").agg(F.sum(F.col("w") * F.when(apart, F.col("rest")).otherwise(F.col("rest") + F.col("apart")))).head()[0] or 0
    return placed.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(int(total) // most + 1))).drop("w")


def _near(a: Column, b: Column, bound: int) -> Column:
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    return differ <= bound


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar by their full shingle sets. texts: (class, text)."""
    joined = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(size, percent), "a binary, b binary")


def link(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept (it is its component's smallest id)."""
    signed, classes, links, shown = _linked(docs, size, percent, doc_id, text)
    # Rows that share an id join the classes of their texts.
    twice = shown.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("id", "a")
    same_id = shown.join(twice, "id").select("a", F.col("class").alias("b"))
    found = _components(classes, links.unionByName(same_id)).select("class", F.col("survivor.id").alias("component_id"))
    out = signed.select("id", "n_shingles", "class").join(found, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component of texts: that of the smallest id, then text hash.

    Of rows that share id and text, one stays.
    """
    signed, classes, links, shown = _linked(docs, size, percent, doc_id, text)
    found = _components(classes, links)
    gone = shown.join(found, "class").select("id", "text_hash", "survivor").filter(F.struct("id", "text_hash") != F.col("survivor")).select("id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("dedup_row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"))
    kept = rows.join(gone, ["id", "text_hash"], "left_anti")
    again = signed.filter("id IS NOT NULL").groupBy("id", "text_hash").count().filter("count > 1").select("id", "text_hash")
    if again.head(1):
        repeats = kept.join(again, ["id", "text_hash"], "left_semi")
        one = repeats.groupBy("id", "text_hash").agg(F.min_by("dedup_row", F.xxhash64(F.to_json("dedup_row"))).alias("dedup_row"))
        kept = kept.join(again, ["id", "text_hash"], "left_anti").unionByName(one)
    return kept.select("dedup_row.*")


def _components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, survivor) of each class: the smallest (id, text_hash) of its component."""
    found = classes.select("class", "first").join(components(links).withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = found.groupBy("component").agg(F.min("first").alias("survivor"))
    return found.join(smallest, "component").select("class", "survivor")


def _linked(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a row per document, a row per class, the confirmed links of classes, the rows that can be linked)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = cut(rows.mapInArrow(_signed(size), f"id {kind}, text_hash long, n_shingles long, class binary, sketch array<long>, bands array<long>"), "neardup-signed")
    shown = signed.filter("class IS NOT NULL AND id IS NOT NULL").select("id", "text_hash", "class", "sketch", "bands")
    classes = cut(
        shown.groupBy("class").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "neardup-classes",
    )
    bound = sketch_bound(percent)

    # Bands with more than one class, and the first class of each.
    in_bands = classes.select("class", F.explode("bands").alias("key"))
    heads = in_bands.groupBy("key").agg(F.min("class").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = cut(in_bands.join(heads.select("key", "head"), "key"), "neardup-shared")
    sketches = classes.select("class", "sketch")
    star = shared.filter("class <> head").select(F.col("class").alias("b"), F.col("head").alias("a")).distinct()
    star = (
        star.join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("class").alias("b"), F.col("sketch").alias("sb")), "b")
        .filter(_near(F.col("sa"), F.col("sb"), bound))
        .select("a", "b")
    )
    star = cut(star, "neardup-star")
    texts = cut(_texts(rows, classes, shared.select("class").distinct()), "neardup-texts")
    links = cut(_confirm(star, texts, size, percent), "neardup-links")
    grouped = components(links)

    # Bands whose classes are still in several components: who looks near, then exactly, block against block.
    label = shared.join(grouped.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    label = cut(label.select("key", "class", "component"), "neardup-labels")
    split = label.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
    open_ = cut(label.join(split, "key"), "neardup-open")
    if not open_.head(1):
        return signed, classes, links, shown
    fine_bound = sketch_bound(percent, FINE_SAMPLES, FINE_BITS)
    wide = texts.join(open_.select("class").distinct(), "class").mapInArrow(_finely(size), "class binary, fine array<long>")
    wide = cut(wide.join(classes.select("class", "sketch", "bands"), "class"), "neardup-fine")
    dealt = _met(open_, F.lit(1), BLOCK, 2 * BLOCK).join(wide, "class")
    near = dealt.groupBy("task").applyInArrow(_flagged(bound, fine_bound), "key long, class binary")
    near = cut(near.distinct(), "neardup-near")
    sets = cut(texts.join(near.select("class").distinct(), "class").mapInArrow(_shingled(size), "class binary, shingles array<long>"), "neardup-sets")
    members = open_.join(near, ["key", "class"]).join(sets.select("class", F.size("shingles").alias("n")), "class")
    dealt = _met(members, F.col("n") + FINE_BITS // 64, BLOCK_SHINGLES, 2 * BLOCK_SHINGLES).drop("n").join(wide, "class").join(sets, "class")
    more = dealt.groupBy("task").applyInArrow(_joined(bound, fine_bound, percent), "a binary, b binary")
    return signed, classes, links.unionByName(cut(more, "neardup-more")), shown


def _texts(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text) of the classes wanted: the text of the class's first row."""
    named = classes.join(wanted, "class").select("class", "first.id", "first.text_hash")
    return rows.join(named, ["id", "text_hash"]).select("class", "text").dropDuplicates(["class"])


#: The links by all pairs that share a shingle, for op5 (shingles of four words).
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n FROM s),
k AS (SELECT doc_id, g, md5(array_to_string(list_sort(g), chr(1))) AS k FROM s WHERE len(g) > 0),
c AS (SELECT min(doc_id) AS id, k, any_value(g) AS g, len(any_value(g)) AS n FROM k GROUP BY k),
e AS (SELECT id, n, unnest(g) AS x FROM c),
pairs AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b),
root AS (SELECT a AS id, least(a, min(b)) AS root FROM r GROUP BY a),
class AS (SELECT k.doc_id, c.id FROM k JOIN c USING (k))
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(root, class.id, n.doc_id) AS component_id, n.doc_id = coalesce(root, class.id, n.doc_id) AS kept
FROM n LEFT JOIN class ON class.doc_id = n.doc_id LEFT JOIN root ON root.id = class.id
"""

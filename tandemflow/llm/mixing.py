"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source gets a share of all words in proportion to its weight.  A source is read at most
``max_epochs`` times: its target stops there, and what it can't take goes to the others by
weight until no target is above its cap.  Sorted by cap over weight, that fixed point has a
closed form in running sums, so no iteration is needed.

A source's target is then taken as whole passes over all its documents and one fractional pass
over a seeded random order of them, up to the rest of the target.  The order is that of a hash,
and its running word count is made in two levels (hash ranges of a source, then rows in a
range), so that a source with a third of all rows is spread over thousands of ranges.

Defined results: a null text has size 0; a null source is a source, ordered last; a null id is
hashed as an empty string; repeated rows are separate documents; an empty table gives no rows.
Columns beyond the named ones are ignored by :func:`mix_plan` and carried by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hex digits of the hash that name a range: 4,096 ranges for each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_key, source_size, target) of each source of ``sized`` (source_key, size).

    One row for each source: the windows below run over sources, never over documents.
    """
    everything = Window.partitionBy(F.lit(1))
    turn = F.pmod(F.row_number().over(everything.orderBy(F.col("source_key") == "", "source_key")) - 1, F.lit(len(weights)))
    sources = (
        sized.groupBy("source_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("at", F.row_number().over(everything.orderBy(F.col("cap") / F.col("weight"), F.col("source_key") == "", "source_key")))
    )
    before = everything.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    among = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    free = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("at", "level"))
    first = F.min(F.col("free")).over(everything)
    return (
        sources.withColumn("level", left / among)
        .withColumn("free", free)
        .withColumn("first", first)
        .select(
            "source_key",
            "source_size",
            F.when(F.col("at") >= F.col("first.at"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"),
        )
    )


def _keyed(docs: DataFrame, carried: list[Column], doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """The carried columns, size, source_key ('' for null, else '=' and the source) and the seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return docs.select(
        *carried,
        F.col(doc_id).alias("mix_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source_key"),
        word_count(F.col(text)).alias("size"),
        order.alias("mix_order"),
        F.substring(order, 1, RANGE_DIGITS).alias("mix_range"),
    )


def _repeats(keyed: DataFrame, sums: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``keyed`` with source_size, target and repeats. sums: its sizes by (source_key, mix_range)."""
    ranges = Window.partitionBy("source_key").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "mix_range", F.coalesce(F.sum("size").over(ranges), F.lit(0)).alias("range_at"))
    offsets = offsets.join(source_targets(sums, weights, max_epochs), "source_key")
    rows = Window.partitionBy("source_key", "mix_range").orderBy("mix_order", F.col("mix_id"), F.col("size").desc())
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    reached = F.col("range_at") + F.sum("size").over(rows.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    return (
        keyed.join(offsets, ["source_key", "mix_range"])
        .withColumn("whole", whole)
        .withColumn("reached", reached)
        .withColumn("repeats", (F.col("whole") + (F.col("reached") <= F.col("target") - F.col("whole") * F.col("source_size")).cast("int")).cast("long"))
        .withColumn("repeats", F.least(F.col("repeats"), F.lit(max_epochs).cast("long")))
    )


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), repeats."""
    keyed = cut(_keyed(docs, [], doc_id, text, source, seed), "mix")
    sums = keyed.groupBy("source_key", "mix_range").agg(F.sum("size").alias("size"))
    return _repeats(keyed, sums, weights, max_epochs).select(
        F.col("mix_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, all columns, each as often as the mix takes it."""
    keyed = _keyed(docs, [F.struct("*").alias("mix_row")], doc_id, text, source, seed)
    sums = _keyed(docs, [], doc_id, text, source, seed).groupBy("source_key", "mix_range").agg(F.sum("size").alias("size"))
    taken = _repeats(keyed, sums, weights, max_epochs).filter("repeats > 0")
    return taken.select("mix_row", F.explode(F.expr("sequence(1L, repeats)")).alias("mix_pass")).select("mix_row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
sources AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighed AS (SELECT *, (1 + (row_number() OVER (ORDER BY k = '', k) - 1) % 3)::DOUBLE AS w, source_size * 3e0 AS cap FROM sources),
placed AS (SELECT *, row_number() OVER (ORDER BY cap / w, k = '', k) AS nth FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0e0)) AS level
  FROM placed WINDOW b AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM levels WHERE cap >= level * w),
targets AS (SELECT k, source_size, CASE WHEN l.nth >= f.nth THEN f.level * w ELSE cap END AS target FROM levels l CROSS JOIN first_free f),
running AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(s.size) OVER (PARTITION BY s.k ORDER BY s.o, s.doc_id, s.size DESC ROWS UNBOUNDED PRECEDING) - s.size / 2e0 AS reached
  FROM sized s JOIN targets t USING (k)),
counted AS (SELECT *, least(3, whole + CASE WHEN reached <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS repeats FROM running)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats FROM counted
"""

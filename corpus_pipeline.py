"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

Part of the llm subpackage.  Each stage takes (spark, docs, sf_dir); it returns the columns of
documents, and the last adds the token ids.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it back as the next one's input.

Defined results, for every stage: an empty table stays empty; all columns of the input stay,
whatever their names, and only the last stage adds some (``n_tokens`` and ``tokens``; a name that is taken
gets ``bpe_`` in front).  A null, blank or letterless text is rejected by language ID; in the
later stages a null text is no copy of anything, holds no secret, has size 0 and no tokens, and stays
null.  Rows with a null id are kept by near-duplicates each; rows of one id are told apart by their
texts, and of rows that repeat id and text one stays.  Ties go to the smaller id, then text hash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemflow.llm import bpe, langid, mixing, neardup, secrets
from tandemflow.llm.names import free_name
from tandemflow.llm.scratch import cut

TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects; the model is learned from the stage's own input."""
    model = langid.fit(docs)
    return langid.judge(docs, model).filter(~F.col("rejected")).select("lang_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (shingles of five words, similarity 0.8)."""
    return neardup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out and repeats documents so that the sources come near their target weights."""
    return mixing.mix(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids and their number; the text is the one decoded from the ids."""
    rows = bpe.encoded_rows(docs, public_tokenizers.path(TOKENIZER))
    text = F.when(F.col("bpe_row.text").isNotNull(), F.col("decoded"))
    own = {"n_tokens": F.size("tokens").cast("long"), "tokens": F.col("tokens")}
    added = (c.alias(free_name(name, docs.columns, "bpe_")) for name, c in own.items())
    return rows.select(F.col("bpe_row").withField("text", text).alias("bpe_row"), *added).select("bpe_row.*", *(free_name(name, docs.columns, "bpe_") for name in own))


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]

#: Stages 1 to 3 and 5 aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

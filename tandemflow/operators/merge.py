"""Merging result sets: one match per peptide, union, proteins by accession, common settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(psms: DataFrame, key: list[str], child: str = "rs_id") -> DataFrame:
    """One match per key: the best of all children, the number of matches and the children it comes from."""
    best = F.max_by(F.struct("psm_id", "score"), F.struct("score", (-F.col("psm_id")).alias("t"))).alias("best")
    out = psms.groupBy(*key).agg(best, F.count("*").alias("spectral_count"), F.array_sort(F.collect_set(child)).alias("children"))
    return out.select(*key, F.col("best.psm_id").alias("best_psm_id"), F.col("best.score").alias("score"), "spectral_count", "children")


def aggregated_again(merged: DataFrame, key: list[str]) -> DataFrame:
    """Rows of :func:`aggregate` merged further: the best of the best, and the sum of the counts."""
    best = F.max_by(F.struct("best_psm_id", "score"), F.struct("score", (-F.col("best_psm_id")).alias("t"))).alias("best")
    out = merged.groupBy(*key).agg(best, F.sum("spectral_count").alias("spectral_count"))
    return out.select(*key, "best.best_psm_id", "best.score", "spectral_count")


def union(psms: list[DataFrame], new_id: list[str]) -> DataFrame:
    """All matches of all children; the new id is a hash of what names a match across them."""
    out = psms[0]
    for df in psms[1:]:
        out = out.unionByName(df)
    return out.withColumn("merged_id", F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in new_id))))


def proteins(df: DataFrame, accession: str, description: Column, order: Column) -> DataFrame:
    """One row per accession: first description that isn't empty, best score, distinct peptides, matches."""
    text = F.min_by(F.nullif(description, F.lit("")), F.when(F.nullif(description, F.lit("")).isNotNull(), order))
    return df.groupBy(accession).agg(
        text.alias("description"), F.max("score").alias("score"), F.count_distinct("peptide_id").alias("n_peptides"), F.count("*").alias("n_matches")
    )


def common_or_default(df: DataFrame, key: list[str], columns: dict[str, Column]) -> DataFrame:
    """For each column its value if all children have the same, else the default."""
    return df.groupBy(*key).agg(*(F.when(F.min(c) == F.max(c), F.min(c)).otherwise(default).alias(c) for c, default in columns.items()))


def decoy_mode(df: DataFrame, key: list[str], mode: str = "mode") -> DataFrame:
    """The children's target/decoy mode, MIXED if they differ."""
    return common_or_default(df, key, {mode: F.lit("MIXED")})


def validated_only(psms: DataFrame, proteins_: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A result set restricted to valid matches, their protein links and the proteins that still have one."""
    valid = psms.filter("is_validated")
    links = matches.join(valid.select("peptide_id").distinct(), "peptide_id", "left_semi")
    return valid, proteins_.join(links.select("protein_id").distinct(), "protein_id", "left_semi"), links

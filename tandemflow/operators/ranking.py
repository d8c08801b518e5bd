"""Ranks and best-of choices within a group (a query, a peptide)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pretty_rank(df: DataFrame, key: list[str], score: str = "score", item: str = "psm_id", tolerance: float = 0.1, gaps: bool = False, name: str = "pretty_rank", carry: list[str] | None = None) -> DataFrame:
    """Rank within the key by descending score, where scores within the tolerance of a rank's first share it.

    The comparison is with the rank's first score, not the one before, so it is a fold over the
    sorted scores of one key (a query has few matches); it makes one number for each rank, which the rows
    take by their place. gaps: ranks count all rows before. carry: further columns that come along; every row comes out once.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i"), *(carry or []))), False)
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("rank"), F.lit(float("inf")).alias("first"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["rank"] == 0) | (acc["first"] - x["s"] > tolerance)
        return F.struct(
            (acc["seen"] + 1).alias("seen"),
            F.when(new, acc["rank"] + 1).otherwise(acc["rank"]).alias("rank"),
            F.when(new, x["s"]).otherwise(acc["first"]).alias("first"),
            F.when(new, F.concat(acc["starts"], F.array(acc["seen"]))).otherwise(acc["starts"]).alias("starts"),
        )

    folded = df.groupBy(*key).agg(rows.alias("_rows")).withColumn("_starts", F.aggregate("_rows", start, step, lambda acc: acc["starts"]))
    each = folded.select(*key, "_starts", F.posexplode("_rows").alias("_at", "r"))
    before = F.filter("_starts", lambda x: x <= F.col("_at"))
    rank = F.element_at(before, -1) + 1 if gaps else F.size(before)
    return each.select(*key, (-F.col("r.i")).alias(item), rank.alias(name), *(F.col(f"r.{c}").alias(c) for c in carry or []))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order; a partial sort keeps only leaders before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")


def single_per_query(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One match per query: score, then the protein's number of matches, then signed mass error, then peptide."""
    counts = df.groupBy("protein_id").agg(F.count("*").alias("protein_matches"))
    order = [F.col("score").desc(), F.col("protein_matches").desc_nulls_last(), F.col("delta_moz"), F.col("peptide_id"), F.col("psm_id")]
    return first_of(df.join(counts, "protein_id", "left"), key or ["query_id"], order)


def same_sequence_as_best(df: DataFrame, key: list[str], sequence: str = "peptide_id") -> DataFrame:
    """All rows of the key with the sequence of its best row."""
    best = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col(sequence), F.col("psm_id"))
    return df.withColumn("_best", F.first(sequence).over(best)).filter(F.col("_best") == F.col(sequence)).drop("_best")


def renumber(df: DataFrame, key: list[str], order: list[Column], name: str = "new_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("int"))


def best_per(df: DataFrame, key: list[str], by: list[str], tie: str = "psm_id") -> DataFrame:
    """The row of each key with the greatest ``by``, then the smallest ``tie``; a partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by, (-F.col(tie)).alias("_tie"))).alias("best"))
    return picked.select(*key, "best.*")

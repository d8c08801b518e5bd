"""Parsimonious inference: groups of equal sets, subsets, subsumable sets, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialised


def samesets(items: DataFrame, holder: str = "protein_id", item: str = "peptide_id", members: bool = True) -> DataFrame:
    """(set_id, items, n_members, members): holders of equal item sets are one set, named by the smallest.

    members: with all holders as an array, which any number of holders can share; else they are only counted.
    """
    sets = items.groupBy(holder).agg(F.array_sort(F.collect_set(item)).alias("items"))
    of_set = [F.min(holder).alias("set_id"), F.count("*").alias("n_members")] + ([F.array_sort(F.collect_list(holder)).alias("members")] if members else [])
    return sets.groupBy("items").agg(*of_set).select("set_id", "items", "n_members", *(["members"] if members else []))


def representatives(items: DataFrame, holder: str = "protein_id", item: str = "peptide_id") -> DataFrame:
    """(set_id, holder): the set that each holder belongs to; no set's holders are gathered."""
    sets = items.groupBy(holder).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.join(sets.groupBy("items").agg(F.min(holder).alias("set_id")), "items").select("set_id", holder)


def set_items(sets: DataFrame) -> DataFrame:
    """(set_id, item, n_sets): each item of each set, with how many sets have it."""
    each = sets.select("set_id", F.explode("items").alias("item"))
    return each.join(each.groupBy("item").agg(F.count("*").alias("n_sets")), "item")


def strict_subsets(sets: DataFrame) -> DataFrame:
    """(subset_id, overset_id) of sets inside larger ones.

    A superset holds the set's rarest item: only sets that hold it are looked at, so frequent
    items join nothing unless a set has no other.
    """
    each = set_items(sets)
    rarest = each.groupBy("set_id").agg(F.min(F.struct("n_sets", "item")).alias("r"))
    small = sets.join(rarest.filter("r.n_sets > 1"), "set_id").select(F.col("set_id").alias("subset_id"), F.col("items").alias("small"), F.col("r.item").alias("item"))
    large = each.select("set_id", "item").join(sets.select("set_id", "items"), "set_id").select(F.col("set_id").alias("overset_id"), F.col("items").alias("large"), "item")
    inside = (F.size("large") > F.size("small")) & (F.size(F.array_except("small", "large")) == 0)
    return small.join(large, "item").filter(inside).select("subset_id", "overset_id")


def subsumable(sets: DataFrame, subsets: DataFrame) -> DataFrame:
    """(set_id) of sets without an item of their own, inside no other, all of whose items sets with one have."""
    each = set_items(sets)
    specific = each.filter("n_sets = 1").select("set_id").distinct()
    covered = each.join(specific, "set_id", "left_semi").select("item").distinct()
    unspecific = sets.select("set_id").join(specific, "set_id", "left_anti").join(subsets.select(F.col("subset_id").alias("set_id")).distinct(), "set_id", "left_anti")
    open_ = each.join(unspecific, "set_id", "left_semi").join(covered, "item", "left_anti").select("set_id").distinct()
    return unspecific.join(open_, "set_id", "left_anti")


def infer(items: DataFrame, holder: str = "protein_id", item: str = "peptide_id", keep_subsumable: bool = True) -> DataFrame:
    """One row per set: set_id (its representative), n_items, n_members, n_specific and status."""
    sets = materialised(samesets(items, holder, item, members=False), "samesets")
    subsets = materialised(strict_subsets(sets), "subsets")
    inside = subsets.select(F.col("subset_id").alias("set_id")).distinct().withColumn("in_other", F.lit(True))
    loose = subsumable(sets, subsets).withColumn("loose", F.lit(True))
    own = set_items(sets).groupBy("set_id").agg(F.count_if(F.col("n_sets") == 1).alias("n_specific"))
    status = F.when(F.col("in_other"), "subset").when(F.col("loose"), "subsumable").otherwise("main")
    out = sets.join(inside, "set_id", "left").join(loose, "set_id", "left").join(own, "set_id")
    out = out.select("set_id", F.size("items").cast("long").alias("n_items"), "n_members", "n_specific", status.alias("status"))
    return out if keep_subsumable else out.filter("status <> 'subsumable'")


def valid_set_counts(items: DataFrame, valid: DataFrame) -> DataFrame:
    """(item, n_sets, n_valid): sets of each item, and valid ones. items: (set_id, item); valid: (set_id, is_validated)."""
    joined = items.join(valid, "set_id")
    return joined.groupBy("item").agg(F.count_distinct("set_id").alias("n_sets"), F.count_distinct(F.when(F.col("is_validated"), F.col("set_id"))).alias("n_valid"))


def typical(members: DataFrame, key: str, accession: str, rules: list[str]) -> DataFrame:
    """(key, typical): by the first rule that any member's accession matches, then the smallest accession."""
    rule = F.coalesce(*(F.when(F.col(accession).rlike(r), F.lit(i)) for i, r in enumerate(rules)), F.lit(len(rules)))
    return members.groupBy(key).agg(F.min_by(accession, F.struct(rule.alias("r"), F.col(accession).alias("a"))).alias("typical"))


def razor(items: DataFrame, scores: DataFrame) -> DataFrame:
    """(item, set_id): each item to the set with most items of its own, then the best score, then the smallest id."""
    items = materialised(items.distinct(), "razor-items")
    n_sets = items.groupBy("item").agg(F.count("set_id").alias("n_sets"))
    specific = items.join(n_sets, "item").withColumn("own", (F.col("n_sets") == 1).cast("int"))
    strength = specific.groupBy("set_id").agg(F.sum("own").alias("n_specific"))
    ranked = specific.join(strength, "set_id").join(scores, "set_id")
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.col("n_specific").desc(), F.col("score").desc(), "set_id"))
    return ranked.withColumn("_at", first).filter("_at = 1").select("item", "set_id")

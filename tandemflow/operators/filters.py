"""Filters as status columns: a filter never drops rows, it sets ``is_validated``.

``incremental`` combines a filter with the status so far; otherwise it starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import adjusted_evalue, identity_threshold, moved_threshold


def flag(df: DataFrame, keep: Column, incremental: bool = True, status: str = "is_validated") -> DataFrame:
    """Sets the status to ``keep``, and to the status so far if that is there and wanted."""
    before = F.col(status) if incremental and status in df.columns else F.lit(True)
    return df.withColumn(status, before & F.coalesce(keep, F.lit(False)))


def score(df: DataFrame, least: float, column: str = "score", **how) -> DataFrame:
    return flag(df, F.col(column) >= least, **how)


def sequence_length(df: DataFrame, least: int, column: str = "sequence", **how) -> DataFrame:
    return flag(df, F.length(column) >= least, **how)


def evalue(df: DataFrame, most: float, column: str = "evalue", **how) -> DataFrame:
    return flag(df, F.col(column) <= most, **how)


def evalue_from_properties(df: DataFrame, most: float, properties: str = "properties", path: str = "$.evalue", **how) -> DataFrame:
    """The e-value in a JSON property bag."""
    return flag(df, F.get_json_object(properties, path).cast("double") <= most, **how)


def adjusted_evalue_filter(df: DataFrame, most: float, column: str = "score", lowest: str = "lowest_threshold", **how) -> DataFrame:
    return flag(df, adjusted_evalue(F.col(column), F.col(lowest)) <= most, **how)


def identity_p_value(df: DataFrame, p: float, column: str = "score", candidates: str = "candidates", **how) -> DataFrame:
    """Score at or above the identity threshold of the query's number of candidates."""
    return flag(df, F.col(column) >= identity_threshold(F.col(candidates), p), **how)


def homology_p_value(df: DataFrame, p: float, column: str = "score", homology: str = "homology", candidates: str = "candidates", p_of_homology: float = 0.05, **how) -> DataFrame:
    """Score at or above the homology threshold; where that is 0 or missing, the identity threshold."""
    moved = moved_threshold(F.nullif(F.col(homology), F.lit(0.0)), p_of_homology, p)
    return flag(df, F.col(column) >= F.coalesce(moved, identity_threshold(F.col(candidates), p)), **how)


def isotope_offset(df: DataFrame, most: int, column: str = "isotope_offset", **how) -> DataFrame:
    """A missing offset is 0."""
    return flag(df, F.coalesce(F.col(column), F.lit(0)) <= most, **how)


def precursor_fraction(df: DataFrame, least: float, column: str = "pif", **how) -> DataFrame:
    return flag(df, F.col(column) > least, **how)


def group_count(df: DataFrame, key: str, counted: Column, least: int, distinct: bool = False, status: str = "is_validated") -> DataFrame:
    """One row per group with the count of ``counted`` and whether it reaches ``least``."""
    n = F.count_distinct(counted) if distinct else F.count(counted)
    return df.groupBy(key).agg(n.alias("n")).withColumn(status, F.col("n") >= least)


def specific_sets(items: DataFrame, scores: DataFrame, least: int, groups: DataFrame, set_id: str = "set_id", item: str = "item") -> DataFrame:
    """(set_id, is_validated): from the lowest score up, a set with fewer than ``least`` items in no other valid set goes.

    Each step depends on those before, but only within a connected group of sets: groups (set_id,
    group) tells them apart, and each group runs on its own.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        of_set = pdf.groupby(set_id)[item].agg(set)
        order = pdf.drop_duplicates(set_id).sort_values(["score", set_id])[set_id]
        holders = pdf.groupby(item)[set_id].nunique().to_dict()
        valid = {}
        for s in order:
            valid[s] = sum(holders[i] <= 1 for i in of_set[s]) >= least
            if not valid[s]:
                for i in of_set[s]:
                    holders[i] -= 1
        return pd.DataFrame({set_id: list(valid), "is_validated": list(valid.values())})

    rows = items.select(set_id, item).distinct().join(scores.select(set_id, "score"), set_id).join(groups.select(set_id, "group"), set_id)
    kind = rows.schema[set_id].dataType.simpleString()
    return rows.groupBy("group").applyInPandas(greedy, f"{set_id} {kind}, is_validated boolean")


def decoy_split(df: DataFrame, accession: str, pattern: str) -> DataFrame:
    """``is_decoy`` by a pattern on the accession."""
    return df.withColumn("is_decoy", F.col(accession).rlike(pattern))


def without_both(df: DataFrame, key: str, flag_column: str) -> DataFrame:
    """Members of both sides of a split, by key."""
    return df.groupBy(key).agg(F.max(flag_column).alias("in_decoy"), F.max(~F.col(flag_column)).alias("in_target"))


def missed_cleavages(sequence: Column) -> Column:
    """Cleavage residues that aren't last."""
    return F.regexp_count(sequence, F.lit("[RK](?=.)"))


def discard_missed_cleavage(df: DataFrame, mode: str, sequence: str = "sequence", abundance: str = "abundance") -> DataFrame:
    """mode forms: peptides with missed cleavages; all: also what they contain; keep: all but the most abundant of a family."""
    cleaved = F.regexp_extract_all(F.col(sequence), F.lit("(.*?[RK]|.+$)"), F.lit(1))
    marked = df.withColumn("mc", F.size(cleaved) > 1).withColumn("pieces", cleaved)
    if mode == "forms":
        return flag(marked, ~F.col("mc")).drop("mc", "pieces")
    families = marked.filter("mc").select(F.explode("pieces").alias(sequence), F.col(sequence).alias("parent"))
    if mode == "all":
        within = families.select(sequence).distinct().withColumn("of_family", F.lit(True))
        return flag(marked.join(within, sequence, "left"), ~F.col("mc") & F.col("of_family").isNull()).drop("mc", "pieces", "of_family")
    members = marked.join(families, sequence).select("parent", sequence, abundance).unionByName(marked.filter("mc").select(F.col(sequence).alias("parent"), sequence, abundance))
    best = members.groupBy("parent").agg(F.max_by(sequence, F.struct(abundance, sequence)).alias("best"))
    losers = members.join(best, "parent").filter(F.col(sequence) != F.col("best")).select(sequence).distinct().withColumn("loser", F.lit(True))
    return flag(marked.join(losers, sequence, "left"), F.col("loser").isNull()).drop("mc", "pieces", "loser")


def discard_modified(df: DataFrame, pattern: str, mode: str = "forms", ptm: str = "ptm_string", sequence: str = "sequence", abundance: str = "abundance", item: str = "peptide_id") -> DataFrame:
    """mode forms: peptides whose PTM string matches; all: every form of such a sequence; keep: all but its most abundant form."""
    hit = F.coalesce(F.col(ptm).rlike(pattern), F.lit(False))
    if mode == "forms":
        return flag(df, ~hit)
    best = F.max_by(item, F.struct(F.col(abundance), (-F.col(item)).alias("i"))).alias("best_form") if mode == "keep" else F.lit(None).alias("best_form")
    of_sequence = df.groupBy(sequence).agg(F.max(hit).alias("modified_form"), best)
    joined = df.join(of_sequence, sequence, "left")
    keep = ~F.col("modified_form") | (F.coalesce(F.col(item) == F.col("best_form"), F.lit(False)) if mode == "keep" else F.lit(False))
    return flag(joined, keep).drop("modified_form", "best_form")


def discard_modified_by_ids(df: DataFrame, ptm_ids: list[int], mode: str = "forms", ptms: str = "ptm_ids", **how) -> DataFrame:
    """:func:`discard_modified` for peptides that carry any of the given PTMs."""
    marked = df.withColumn("_hit", F.when(F.arrays_overlap(ptms, F.array(*map(F.lit, ptm_ids))), "1").otherwise("0"))
    return discard_modified(marked, "1", mode, ptm="_hit", **how).drop("_hit")


def unspecific(df: DataFrame, item: str, holder: str) -> DataFrame:
    """Items held by one holder only are kept."""
    holders = df.groupBy(item).agg(F.count_distinct(holder).alias("n_holders"))
    return flag(df.join(holders, item), F.col("n_holders") == 1)


def shared(df: DataFrame, key: str, shared_by: str) -> DataFrame:
    """Rows whose key belongs to more than one ``shared_by`` aren't kept."""
    return unspecific(df, key, shared_by).drop("n_holders")


def intensity_level(df: DataFrame, threshold: Column, above: bool = True, column: str = "intensity") -> DataFrame:
    """Selection level 2 on the wanted side of the threshold, else 1."""
    keep = F.col(column) > threshold if above else F.col(column) < threshold
    return df.withColumn("selection_level", F.when(keep, 2).otherwise(1))


def relative_intensity_level(df: DataFrame, percent: float, keys: list[str], column: str = "intensity") -> DataFrame:
    """Threshold: so many percent of the keys' median."""
    medians = df.groupBy(*keys).agg((F.median(column) * percent / 1e2).alias("threshold"))
    return intensity_level(df.join(medians, keys), F.col("threshold"), column=column).drop("threshold")


def tree(node: dict | str) -> Column:
    """A Column from a tree of {and|or: [...]}, {not: ...} and SQL predicates."""
    if isinstance(node, str):
        return F.expr(node)
    (kind, parts), *_ = node.items()
    if kind == "not":
        return ~tree(parts)
    columns: Iterator[Column] = map(tree, parts)
    out = next(columns)
    for c in columns:
        out = out & c if kind == "and" else out | c
    return out


#: Stored filter name -> function(df, threshold).
FILTERS: dict[str, Callable[..., DataFrame]] = {
    "SCORE": score,
    "PEP_SEQ_LENGTH": sequence_length,
    "MASCOT_EVALUE": evalue,
    "MASCOT_ADJUSTED_EVALUE": adjusted_evalue_filter,
    "SCORE_IT_P-VALUE": identity_p_value,
    "SCORE_HT_P-VALUE": homology_p_value,
    "ISOTOPE_OFFSET": isotope_offset,
    "PIF": precursor_fraction,
}


def apply_stored(df: DataFrame, stored: list[tuple[str, float]]) -> DataFrame:
    """Filters as (name, threshold) pairs, in order, each narrowing the status."""
    for name, threshold in stored:
        df = FILTERS[name](df, threshold)
    return df

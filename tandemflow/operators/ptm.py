"""Modification sites, sequence coverage, masses and readable forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles

#: Monoisotopic residue masses and water, in dalton.
RESIDUE_MASS = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406,
    "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111,
    "Y": 163.06333, "W": 186.07931,
}
WATER = 18.010565
PROTON = 1.007276


def mass(sequence: Column) -> Column:
    """Monoisotopic mass of a peptide; null with an unknown residue."""
    masses = F.create_map(*(F.lit(x) for kv in RESIDUE_MASS.items() for x in kv))
    residues = F.transform(F.split(sequence, ""), lambda r: masses[r])
    return F.aggregate(residues, F.lit(WATER), lambda acc, x: acc + x)


def mz(m: Column, charge: Column) -> Column:
    return (m + charge * PROTON) / charge


def positions(sequence: Column, residue: str) -> Column:
    """1-based positions of a residue, or of the wildcard X."""
    at = F.sequence(F.lit(1), F.length(sequence))
    return F.when(F.length(sequence) > 0, F.filter(at, lambda i: F.substring(sequence, i, 1).isin(residue, "X"))).otherwise(F.array().cast("array<int>"))


def readable(ptms: Column) -> Column:
    """'Name (residue position)' joined, in order of position. ptms: array<struct<position, residue, name>>."""
    where = lambda p: F.when(p["position"] == 0, "N-term").when(p["position"] == -1, "C-term").otherwise(F.concat(p["residue"], p["position"].cast("string")))
    return F.array_join(F.transform(F.array_sort(ptms), lambda p: F.concat(p["name"], F.lit(" ("), where(p), F.lit(")"))), "; ")


def sites(matches: DataFrame) -> DataFrame:
    """(protein_id, ptm, position, n_peptides, best): matches (protein_id, peptide_id, start, ptm, ptm_position, score)."""
    at = F.col("start") + F.col("ptm_position") - 1
    return matches.groupBy("protein_id", "ptm", at.alias("position")).agg(
        F.count_distinct("peptide_id").alias("n_peptides"), F.max("score").alias("score"), F.max_by("peptide_id", F.struct(F.col("score"), (-F.col("peptide_id")).alias("t"))).alias("best_peptide")
    )


def isomers(peptides: DataFrame) -> DataFrame:
    """(peptide_id, isomers): other peptides of the same sequence and the same PTMs, elsewhere. peptides: (peptide_id, sequence, ptms array<string>)."""
    key = peptides.withColumn("_k", F.concat_ws("|", "sequence", F.array_join(F.array_sort("ptms"), ";")))
    groups = key.groupBy("_k").agg(F.array_sort(F.collect_list("peptide_id")).alias("_g"))
    return key.join(groups.filter(F.size("_g") > 1), "_k").select("peptide_id", F.array_except("_g", F.array("peptide_id")).alias("isomers"))


def coverage(intervals: DataFrame, key: str, length: Column) -> DataFrame:
    """(key, covered, coverage): residues in the union of [start, stop], and their floored percentage."""
    w = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start") - 1, F.max("stop").over(w))
    fresh = F.greatest(F.lit(0), F.col("stop") - reached)
    spans = intervals.groupBy(key, "start").agg(F.max("stop").alias("stop"), F.max(length).alias("_len"))
    out = spans.withColumn("_fresh", fresh).groupBy(key).agg(F.sum("_fresh").cast("long").alias("covered"), F.max("_len").alias("_len"))
    return out.select(key, "covered", F.floor(100 * F.col("covered") / F.col("_len")).cast("long").alias("coverage"))


def isotope_deviation(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, rmsd): of observed from expected isotope shares. df: (key, observed, expected)."""
    return df.groupBy(*key).agg(F.sqrt(F.avg(F.pow(F.col("observed") - F.col("expected"), F.lit(2)))).alias("rmsd"))


def aggregated_sites(sites: DataFrame) -> DataFrame:
    """(accession, ptm, position, confidence, best_psm_id, n_children, peptide_ids): sites of all children, by what names them.

    The best match is the one of the best localisation, then score, then the smallest id.
    sites: (child, accession, ptm, position, best_psm_id, confidence, score, peptide_ids array).
    """
    best = F.max_by("best_psm_id", F.struct("confidence", "score", (-F.col("best_psm_id")).alias("t")))
    each = sites.groupBy("accession", "ptm", "position").agg(F.max("confidence").alias("confidence"), best.alias("best_psm_id"), F.count_distinct("child").alias("n_children"))
    ids = sites.select("accession", "ptm", "position", F.explode("peptide_ids").alias("p")).groupBy("accession", "ptm", "position").agg(F.array_sort(F.collect_set("p")).alias("peptide_ids"))
    return each.join(ids, ["accession", "ptm", "position"], "left")


def deviation_bound(df: DataFrame, key: str = "feature_id", charges: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """One row (n, bound): the outlier bound Q3 + 1.5 IQR of the isotope patterns' deviations. df: (key, charge, observed, expected)."""
    each = isotope_deviation(df.filter(F.col("charge").isin(*charges)), [key])
    q = percentiles(each, [], "rmsd", {"q1": 0.25, "q3": 0.75})
    return q.select("n", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("bound"))


def peptide_key(sequence: Column, ptm_string: Column, insensitive: bool = False) -> Column:
    """What makes peptides the same: sequence and PTM string; insensitive: I and L are one residue."""
    return F.concat_ws("%", F.translate(sequence, "I", "L") if insensitive else sequence, F.coalesce(ptm_string, F.lit("")))


def resolved(sequence: Column, ambiguity: Column) -> Column:
    """The sequence with its ambiguous residues replaced. ambiguity: 'position,from,to,...' in triplets; null or empty changes nothing."""
    parts = F.split(ambiguity, r"\s*,\s*")
    triplets = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 3).cast("int") - 1), lambda i: F.struct(parts[3 * i].cast("int").alias("at"), parts[3 * i + 2].alias("to")))
    put = lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["at"] - 1), x["to"], F.substring(acc, x["at"] + 1, F.length(acc)))
    return F.when(F.length(ambiguity) > 0, F.aggregate(triplets, sequence, put)).otherwise(sequence)


#: pK of the ends and of the residues that carry a charge.
PK_POSITIVE = {"N-term": 8.0, "K": 10.0, "R": 12.0, "H": 6.5}
PK_NEGATIVE = {"C-term": 3.1, "D": 4.4, "E": 4.4, "C": 8.5, "Y": 10.0}


def isoelectric_point(sequence: Column) -> Column:
    """The pH at which a peptide's charges cancel, by bisection."""
    counted = lambda r: F.lit(1.0) if len(r) > 1 else F.regexp_count(sequence, F.lit(r)).cast("double")
    counts = F.struct(*(counted(r).alias(f"c{i}") for i, r in enumerate([*PK_POSITIVE, *PK_NEGATIVE])))

    def charge(ph: Column, n: Column) -> Column:
        total = F.lit(0.0)
        for i, pk in enumerate(PK_POSITIVE.values()):
            total = total + n[f"c{i}"] / (1 + F.pow(F.lit(10.0), ph - pk))
        for i, pk in enumerate(PK_NEGATIVE.values(), len(PK_POSITIVE)):
            total = total - n[f"c{i}"] / (1 + F.pow(F.lit(10.0), pk - ph))
        return total

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        up = charge(middle, acc["n"]) > 0
        return F.struct(F.when(up, middle).otherwise(acc["low"]).alias("low"), F.when(up, acc["high"]).otherwise(middle).alias("high"), acc["n"].alias("n"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), counts.alias("n"))
    return F.when(F.length(sequence) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, halve, lambda acc: (acc["low"] + acc["high"]) / 2))

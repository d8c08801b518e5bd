"""Clusters of features: chains along one value, summaries, profiles, cross assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import binned, running
from .storage import materialised


def islands(df: DataFrame, keys: list[str], value: str, gap: float, name: str = "island") -> DataFrame:
    """``df`` with the number of its island: a new one begins where the value is more than ``gap`` above the one before.

    Found on distinct values, in bins: a row's predecessor is in its bin or is the last of an earlier one.
    """
    distinct = binned(df.select(*keys, value).distinct(), value, keys)
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = distinct.groupBy(*keys, "bin").agg(F.max(value).alias("_last"))
    ends = ends.select(*keys, "bin", F.max("_last").over(before).alias("_earlier"))
    inside = Window.partitionBy(*keys, "bin").orderBy(value)
    previous = F.coalesce(F.lag(value).over(inside), F.col("_earlier"))
    marked = distinct.join(ends, [*keys, "bin"]).withColumn("_new", F.coalesce(F.col(value) - previous > gap, F.lit(True)).cast("long"))
    numbered = running(marked.drop("bin", "_earlier"), value, {name: F.col("_new")}, keys, descending=False)
    return df.join(numbered.select(*keys, value, name), [*keys, value])


def time_chains(df: DataFrame, keys: list[str], tolerance: float, t: str = "t", duration: str = "duration", item: str = "feature_id") -> DataFrame:
    """``df`` with the number of its time chain within the keys (an island of few rows).

    A row joins if it begins no later than the last member's end and a tolerance.
    """
    w = Window.partitionBy(*keys).orderBy(t, item)
    apart = F.col(t) > F.lag(F.col(t) + F.col(duration)).over(w) + tolerance
    return df.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("chain", F.sum("_new").over(w)).drop("_new")


def median_splits(df: DataFrame, keys: list[str], tolerance: float, value: str = "mz", item: str = "feature_id") -> DataFrame:
    """(keys, item, part): chains split until all members lie within the tolerance of their part's median.

    Recursive by nature: each chain is a pandas group of its own.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, open_ = [], [pdf.sort_values([value, item])]
        while open_:
            p = open_.pop()
            inside = (p[value] - p[value].median()).abs() <= tolerance
            if inside.all() or not inside.any():
                parts.append(p)
            else:
                middle = p[value].median()
                open_ += [x for x in (p[inside], p[~inside & (p[value] < middle)], p[~inside & (p[value] > middle)]) if len(x)]
        parts.sort(key=lambda p: (p[value].iloc[0], p[item].iloc[0]))
        return pd.concat([p[[*keys, item]].assign(part=i) for i, p in enumerate(parts)])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, item])
    return df.select(*keys, item, value).groupBy(*keys).applyInPandas(split, f"{schema}, part int")


def summaries(df: DataFrame, keys: list[str], item: str = "feature_id") -> DataFrame:
    """One row per cluster: size, summed and largest intensity, that member, median time."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.col("intensity").cast("decimal(18,4)")).cast("double").alias("intensity"),
        F.max("intensity").alias("most_intense"),
        F.max_by(item, F.struct(F.col("intensity"), (-F.col(item)).alias("t"))).alias("best_feature"),
        F.median("t").alias("t"),
    )


def master_map(maps: list[DataFrame], match) -> DataFrame:
    """Features of the first map, and of each further one those that ``match(masters, map)`` (a DataFrame of feature_id) doesn't find."""
    masters = maps[0]
    for m in maps[1:]:
        masters = masters.unionByName(m.join(match(masters, m).select("feature_id").distinct(), "feature_id", "left_anti"))
    return masters


def profile_key(states: Column) -> Column:
    """An array of ratio states as one cluster key."""
    return F.array_join(states, "|")


def cross_assignment(df: DataFrame, item: list[str], run: str, runs: list[int], value: str) -> DataFrame:
    """(item, run, source_run): for each run where an item is missing, the run where it is most intense."""
    present = df.groupBy(*item).agg(F.collect_set(run).alias("_in"), F.max_by(run, F.struct(value, (-F.col(run)).alias("t"))).alias("source_run"))
    every = F.array(*map(F.lit, runs))
    return present.select(*item, F.explode(F.array_except(every, "_in")).alias(run), "source_run")


def peptide_clusters(peptides: DataFrame, method: str) -> DataFrame:
    """(set_id, cluster, peptide_id): quantified peptides of each set, by sequence, set, ptm_pattern or profile.

    peptides: (set_id, accession, peptide_id) and, by method, sequence, ptms array<struct<position, name>>, starts
    array<int> (in the protein), states array<string>.  By pattern, peptides of equal PTMs at equal places are MODIFIED;
    an unmodified one (the largest id of its sequence) with the sequence of a pattern's first peptide is the
    pattern's UNMODIFIED form; the others go by the accession.
    """
    if method == "sequence":
        return peptides.select("set_id", F.col("sequence").alias("cluster"), "peptide_id")
    if method == "set":
        return peptides.select("set_id", F.col("accession").alias("cluster"), "peptide_id")
    if method == "profile":
        return peptides.select("set_id", F.array_join("states", ";").alias("cluster"), "peptide_id")
    if method != "ptm_pattern":
        raise ValueError(method)
    place = lambda p: F.concat(p["name"], F.lit("@"), F.array_join(F.transform("starts", lambda s: (s + p["position"] - 1).cast("string")), ","))
    marked = peptides.withColumn("pattern", F.array_join(F.transform(F.array_sort("ptms"), place), "; "))
    modified = marked.filter("pattern <> ''")
    first = modified.groupBy("set_id", "pattern").agg(F.min_by("sequence", "peptide_id").alias("sequence"))
    plain = marked.filter("pattern = ''")
    partner = plain.groupBy("set_id", "sequence").agg(F.max("peptide_id").alias("peptide_id")).join(first, ["set_id", "sequence"])
    rest = plain.join(partner.select("set_id", "peptide_id").distinct(), ["set_id", "peptide_id"], "left_anti")
    return (
        modified.select("set_id", F.concat(F.lit("MODIFIED "), F.col("pattern")).alias("cluster"), "peptide_id")
        .unionByName(partner.select("set_id", F.concat(F.lit("UNMODIFIED "), F.col("pattern")).alias("cluster"), "peptide_id"))
        .unionByName(rest.select("set_id", F.col("accession").alias("cluster"), "peptide_id"))
    )


def site_clusters(matches: DataFrame, partial: bool = True) -> DataFrame:
    """(protein_id, sites, peptide_id, status): peptides of a protein that carry the same PTM sites.

    matches: (protein_id, peptide_id, start, stop, sites array<struct<position, ptm>>).  Matches of equal sites are
    isomorphic: one cluster.  partial: a match whose sites are part of a cluster's joins it as partially isomorphic, if it
    doesn't reach to any of the other sites; if it does, it conflicts.  Going from most sites to fewest a
    cluster never depends on the one before, so there is no order.  A match's sites lie between its start and its
    stop, so those it joins have just these sites there: they are a run of the cluster's, and matches meet equal runs only.
    """
    sorted_ = materialised(matches.filter(F.size("sites") > 0).select("protein_id", "peptide_id", "start", "stop", F.sort_array("sites").alias("sites")), "site-matches")
    peptide = ["protein_id", "peptide_id"]
    repeated = materialised(sorted_.groupBy(*peptide).agg(F.count("*").alias("n")).filter("n > 1").select(*peptide), "repeated")

    def once(rows: DataFrame) -> DataFrame:
        """Distinct rows; only peptides that match a protein more than once can give one twice."""
        several = rows.join(repeated, [F.equal_null(rows[c], repeated[c]) for c in peptide], "left_semi")
        return rows.join(repeated, [F.equal_null(rows[c], repeated[c]) for c in peptide], "left_anti").unionByName(several.distinct())

    same = once(sorted_.select("protein_id", "sites", "peptide_id", F.lit("isomorphic").alias("status")))
    if not partial:
        return same
    clusters = materialised(sorted_.select("protein_id", F.col("sites").alias("cluster")).distinct(), "site-clusters")
    small = sorted_.select("protein_id", "peptide_id", "start", "stop", F.col("sites").alias("own"))
    within = F.coalesce(F.forall("own", lambda s: s["position"].between(F.col("start"), F.col("stop"))), F.lit(False))
    runs = clusters.withColumn("_c", F.array_distinct("cluster")).select("*", F.explode(F.sequence(F.lit(1), F.size("_c"))).alias("_i"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(1), F.size("_c") - F.col("_i") + 1)).alias("_n")).filter(F.col("_n") < F.size("cluster"))
    runs = runs.select("protein_id", "cluster", F.slice("_c", F.col("_i"), F.col("_n")).alias("_run"), F.get("_c", F.col("_i") - 2)["position"].alias("_before"), F.get("_c", F.col("_i") + F.col("_n") - 1)["position"].alias("_after"))
    runs, met = runs.withColumn("_at", F.xxhash64("_run")), small.filter(within).withColumn("_set", F.array_distinct("own")).withColumn("_at", F.xxhash64("_set"))
    apart = (F.col("_before").isNull() | (F.col("_before") < F.col("start"))) & (F.col("_after").isNull() | (F.col("_after") > F.col("stop")))
    joined = met.join(runs, ["protein_id", "_at"]).filter((F.col("_set") == F.col("_run")) & (F.size("cluster") > F.size("own")) & apart).select("protein_id", "peptide_id", "cluster")
    outside = small.filter(~within)
    if outside.head(1):  # sites that aren't in their match: it meets the clusters that hold its first one
        inside = (F.size("cluster") > F.size("own")) & (F.size(F.array_except("own", "cluster")) == 0)
        reached = F.exists(F.array_except("cluster", "own"), lambda s: s["position"].between(F.col("start"), F.col("stop")))
        holders = clusters.withColumn("first", F.explode(F.array_distinct("cluster")))
        joined = joined.unionByName(outside.withColumn("first", F.col("own")[0]).join(holders, ["protein_id", "first"]).filter(inside & ~reached).select("protein_id", "peptide_id", "cluster"))
    return same.unionByName(once(joined.select("protein_id", F.col("cluster").alias("sites"), "peptide_id", F.lit("partially isomorphic").alias("status"))))

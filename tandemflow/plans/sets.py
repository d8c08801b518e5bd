"""Catalogue: inference, set scores, merging, hierarchies, spectral counts (q16 to q37)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import filters, hierarchy, inference, merge, scoring, spectral
from .registry import query
from .views import Views

_SETS = """, s AS (SELECT protein_id, list_sort(list(DISTINCT peptide_id)) AS items FROM occurrence GROUP BY 1),
    g AS (SELECT min(protein_id) AS set_id, items, list_sort(list(protein_id)) AS members FROM s GROUP BY items),
    e AS (SELECT set_id, unnest(items) AS item FROM g), c AS (SELECT item, count(*) AS n FROM e GROUP BY 1),
    k AS (SELECT e.set_id, e.item, c.n FROM e JOIN c USING (item)), spec AS (SELECT DISTINCT set_id FROM k WHERE n = 1),
    sub AS (SELECT a.set_id AS subset_id, b.set_id AS overset_id FROM e a JOIN e b ON a.item = b.item AND a.set_id <> b.set_id
      JOIN g ga ON ga.set_id = a.set_id JOIN g gb ON gb.set_id = b.set_id
      GROUP BY 1, 2 HAVING count(*) = max(len(ga.items)) AND max(len(gb.items)) > max(len(ga.items))),
    cov AS (SELECT DISTINCT item FROM e WHERE set_id IN (SELECT set_id FROM spec)),
    uns AS (SELECT set_id FROM g WHERE set_id NOT IN (SELECT set_id FROM spec) AND set_id NOT IN (SELECT subset_id FROM sub)),
    sm AS (SELECT set_id FROM uns WHERE set_id NOT IN (SELECT set_id FROM e WHERE item NOT IN (SELECT item FROM cov)))
    """


@query("q16_samesets", "occurrence", _SETS + "SELECT set_id, CAST(len(items) AS BIGINT) AS n_items, CAST(len(members) AS BIGINT) AS n_members, array_to_string(members, ',') AS members FROM g")
def q16(v: Views):
    sets = inference.samesets(v.occurrence)
    return sets.select("set_id", F.size("items").cast("long").alias("n_items"), F.size("members").cast("long").alias("n_members"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("q17_strict_subsets", "occurrence", _SETS + "SELECT subset_id, overset_id FROM sub")
def q17(v: Views):
    return inference.strict_subsets(inference.samesets(v.occurrence, members=False))


@query("q18_subsumable", "occurrence", _SETS + "SELECT set_id FROM sm")
def q18(v: Views):
    sets = inference.samesets(v.occurrence, members=False)
    return inference.subsumable(sets, inference.strict_subsets(sets))


@query(
    "q19_protein_sets", "occurrence",
    _SETS + """SELECT g.set_id, CAST(len(items) AS BIGINT) AS n_items, CAST(len(members) AS BIGINT) AS n_members,
    (SELECT count(*) FROM k WHERE k.set_id = g.set_id AND k.n = 1) AS n_specific,
    CASE WHEN g.set_id IN (SELECT subset_id FROM sub) THEN 'subset' WHEN g.set_id IN (SELECT set_id FROM sm) THEN 'subsumable' ELSE 'main' END AS status FROM g""",
)
def q19(v: Views):
    return inference.infer(v.occurrence)


@query("q20_representative", "occurrence", _SETS + "SELECT set_id AS representative, unnest(members) AS protein_id FROM g")
def q20(v: Views):
    return inference.representatives(v.occurrence).select(F.col("set_id").alias("representative"), "protein_id")


_BEST = """, b AS (SELECT protein_id, peptide_id, max(score) AS score, max(15e0 + 5e0 * charge) AS threshold FROM psm GROUP BY 1, 2)
    """


def _best(v: Views):
    return v.psm.groupBy("protein_id", "peptide_id").agg(F.max("score").alias("score"), F.max(15e0 + 5e0 * F.col("charge")).alias("threshold"))


_X = "CAST(sum(CAST({} AS DECIMAL(18,5))) AS DOUBLE)"


@query("q21_set_score_standard", "psm", _BEST + f"SELECT protein_id, {_X.format('score')} AS set_score, count(*) AS n_items FROM b GROUP BY 1")
def q21(v: Views):
    return scoring.standard(_best(v), "protein_id")


@query(
    "q22_mudpit", "psm",
    _BEST + f"""SELECT protein_id, floor(coalesce({_X.format('score - threshold')} FILTER (score > threshold) + {_X.format('threshold')} FILTER (score > threshold)
    / count(*) FILTER (score > threshold), 0e0) * 1e3 + 5e-1) / 1e3 AS set_score FROM b GROUP BY 1""".replace(" AS DOUBLE) FILTER (score > threshold)", " AS DOUBLE)").replace("DECIMAL(18,5)))", "DECIMAL(18,5))) FILTER (score > threshold)"),
)
def q22(v: Views):
    return scoring.mudpit(_best(v), "protein_id").withColumn("set_score", rounded(F.col("set_score"), 3))


@query(
    "q23_modified_mudpit", "psm",
    _BEST + """SELECT protein_id, coalesce(CAST(sum(CAST(CASE WHEN score - threshold + 5e0 > 0 THEN score - threshold + 5e0 END AS DECIMAL(18,5))) AS DOUBLE), 0e0) AS set_score
    FROM b GROUP BY 1""",
)
def q23(v: Views):
    return scoring.modified_mudpit(_best(v), "protein_id", offset=5.0)


@query(
    "q24_fisher", "psm",
    """, b AS (SELECT query_id, peptide_id, max(score) / 1e1 AS score FROM psm GROUP BY 1, 2),
    r AS (SELECT query_id, row_number() OVER w AS n, sum(score * ln(10) / 10) OVER w AS c FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT query_id, floor(greatest(0, max((c - ln(list_sum(list_transform(range(n), lambda k: exp(k * ln(c) - lgamma(k + 1)))))) * 10 / ln(10))) * 1e6 + 5e-1) / 1e6 AS set_score
    FROM r GROUP BY 1""",
)
def q24(v: Views):
    best = v.psm.groupBy("query_id", "peptide_id").agg((F.max("score") / 1e1).alias("score"))
    return scoring.fisher(best, "query_id").withColumn("set_score", rounded(F.col("set_score"), 6))


@query(
    "q25_sidak_instance", "psm",
    """, i AS (SELECT peptide_id, count(*) AS n, 1e0 - pow(1e0 - pow(1e1, max(score) / 1e1 / -1e1), count(*)) AS p FROM psm GROUP BY 1)
    SELECT peptide_id, n, floor(p * 1e6 + 5e-1) / 1e6 AS p_value, floor(-1e1 * log10(p) * 1e4 + 5e-1) / 1e4 AS instance_score FROM i""",
)
def q25(v: Views):
    out = scoring.sidak(v.psm.select("peptide_id", (F.col("score") / 1e1).alias("score")), "peptide_id")
    return out.select("peptide_id", "n", rounded(F.col("p_value"), 6).alias("p_value"), rounded(F.col("instance_score")).alias("instance_score"))


@query("q26_count_filters", "psm", "SELECT query_id, count(DISTINCT peptide_id) AS n, count(DISTINCT peptide_id) >= 3 AS is_validated FROM psm GROUP BY 1")
def q26(v: Views):
    return filters.group_count(v.psm, "query_id", F.col("peptide_id"), 3, distinct=True)


@query(
    "q27_validated_set_counts", "psm",
    """, s AS (SELECT query_id, max(score) >= 9e1 AS ok FROM psm GROUP BY 1)
    SELECT peptide_id AS item, count(DISTINCT query_id) AS n_sets, count(DISTINCT query_id) FILTER (ok) AS n_valid FROM psm JOIN s USING (query_id) GROUP BY 1""",
)
def q27(v: Views):
    valid = v.psm.groupBy(F.col("query_id").alias("set_id")).agg((F.max("score") >= 90).alias("is_validated"))
    return inference.valid_set_counts(v.psm.select(F.col("query_id").alias("set_id"), F.col("peptide_id").alias("item")), valid)


@query(
    "q28_typical_protein", "",
    """SELECT s_nationkey AS set_id, min_by(s_name, (CASE WHEN regexp_matches(s_name, '77$') THEN '0' WHEN regexp_matches(s_name, '[13]$') THEN '1' ELSE '2' END) || s_name) AS typical
    FROM supplier GROUP BY 1""",
)
def q28(v: Views):
    return inference.typical(v.table("supplier").select(F.col("s_nationkey").alias("set_id"), "s_name"), "set_id", "s_name", ["77$", "[13]$"])


@query(
    "q29_merge_aggregation", "psm",
    """SELECT peptide_id, arg_max(psm_id, (score, -psm_id)) AS best_psm_id, max(score) AS score, count(*) AS spectral_count,
    array_to_string(list_sort(list(DISTINCT rs_id)), ',') AS children FROM psm GROUP BY 1""",
)
def q29(v: Views):
    return merge.aggregate(v.psm, ["peptide_id"]).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("q30_merge_union", "psm", "SELECT md5(concat_ws(':', rs_id, psm_id)) AS merged_id, psm_id, rs_id, score FROM psm WHERE rs_id IN (1995, 1996)")
def q30(v: Views):
    part = lambda year: v.psm.filter(F.col("rs_id") == year).select("psm_id", "rs_id", "score")
    return merge.union([part(1995), part(1996)], ["rs_id", "psm_id"])


@query(
    "q31_protein_merge", "psm",
    """SELECT protein_id, min(s_name) AS description, max(score) AS score, count(DISTINCT peptide_id) AS n_peptides, count(*) AS n_matches
    FROM psm JOIN supplier ON s_suppkey = protein_id GROUP BY 1""",
)
def q31(v: Views):
    names = v.table("supplier").select(F.col("s_suppkey").alias("protein_id"), "s_name")
    return merge.proteins(v.psm.select("protein_id", "peptide_id", "score", "rs_id").join(names, "protein_id"), "protein_id", F.col("s_name"), F.col("rs_id"))


@query(
    "q32_common_or_default", "psm",
    """SELECT query_id, CASE WHEN min(charge) = max(charge) THEN min(charge) ELSE 0 END AS charge, CASE WHEN min(rs_id) = max(rs_id) THEN min(rs_id) ELSE -1 END AS rs_id
    FROM psm GROUP BY 1""",
)
def q32(v: Views):
    return merge.common_or_default(v.psm, ["query_id"], {"charge": F.lit(0), "rs_id": F.lit(-1)})


_CLOSED = """, t(ancestor, descendant, depth) AS (SELECT parent_id, child_id, 1 FROM edge UNION ALL SELECT t.ancestor, e.child_id, t.depth + 1 FROM t JOIN edge e ON e.parent_id = t.descendant)
    """


@query("q33_hierarchy_closure", "edge", _CLOSED + "SELECT ancestor, descendant, depth FROM t", recursive=True)
def q33(v: Views):
    return hierarchy.closure(v.edge)


@query(
    "q34_leaf_spectral_count", "edge psm",
    _CLOSED + """SELECT ancestor, peptide_id, count(*) AS n FROM t JOIN orders ON descendant = concat('C', CAST(o_custkey AS STRING)) JOIN psm ON query_id = o_orderkey
    WHERE score >= 5e1 GROUP BY 1, 2""",
    recursive=True,
)
def q34(v: Views):
    leaf = v.table("orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("leaf"))
    facts = v.psm.filter("score >= 50").select("query_id", "peptide_id").join(leaf, "query_id")
    return hierarchy.roll_up(hierarchy.closure(v.edge), facts, "leaf", ["peptide_id"])


@query("q35_unassigned_queries", "psm", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT query_id FROM psm)")
def q35(v: Views):
    return v.table("orders").select("o_orderkey").join(v.psm.select(F.col("query_id").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(
    "q36_weighted_spectral_count", "psm",
    """, l AS (SELECT query_id AS protein_id, peptide_id, count(*) AS n FROM psm GROUP BY 1, 2),
    h AS (SELECT peptide_id, count(*) AS holders FROM l GROUP BY 1),
    m AS (SELECT * FROM l JOIN h USING (peptide_id)),
    o AS (SELECT protein_id, sum(CASE WHEN holders = 1 THEN n ELSE 0 END) AS spec, sum(n) AS basic FROM m GROUP BY 1),
    j AS (SELECT m.*, o.spec, o.basic, sum(o.spec) OVER (PARTITION BY peptide_id) AS all_spec FROM m JOIN o USING (protein_id))
    SELECT protein_id, CAST(max(basic) AS BIGINT) AS basic, CAST(max(spec) AS BIGINT) AS specific,
      floor(sum(n * CASE WHEN all_spec > 0 THEN spec / all_spec ELSE 1e0 / holders END) * 1e9 + 5e-1) / 1e9 AS weighted FROM j GROUP BY 1""",
)
def q36(v: Views):
    links = v.psm.groupBy(F.col("query_id").alias("protein_id"), "peptide_id").agg(F.count("*").alias("n"))
    return spectral.weighted(links).withColumn("weighted", rounded(F.col("weighted"), 9))


@query("q37_count_by_charge_channel", "psm", "SELECT peptide_id, charge, rs_id, count(*) AS n FROM psm GROUP BY 1, 2, 3")
def q37(v: Views):
    return spectral.by_channel(v.psm, ["peptide_id", "charge", "rs_id"])

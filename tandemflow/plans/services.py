"""Whole services as one plan each: ingest, set profiles, master maps; and their catalogue entries (q116 to q122, p06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, hierarchy, inference, quant, rangejoin, ranking
from ..operators.storage import materialised
from .registry import query
from .views import Views


def ingested(matches: DataFrame, proteins: DataFrame, decoy_pattern: str, accession: str, tolerance: float = 0.1) -> DataFrame:
    """A result file's matches as stored: decoys told by their protein's accession, ranked among their own kind, queries numbered.

    Queries are numbered within their result set by their order; matches get pretty ranks by query and side.
    matches: (psm_id, rs_id, query_id, protein_id, score); proteins: (protein_id, accession).
    """
    sides = proteins.select("protein_id", F.col(accession).rlike(decoy_pattern).alias("is_decoy"))
    ranked = ranking.pretty_rank(matches.join(sides, "protein_id"), ["query_id", "is_decoy"], tolerance=tolerance, carry=["rs_id", "score"])
    numbers = ranking.renumber(matches.select("rs_id", "query_id").distinct(), ["rs_id"], [F.col("query_id")], "initial_id")
    return ranked.join(numbers, ["rs_id", "query_id"]).select("psm_id", "rs_id", "query_id", "initial_id", "is_decoy", "pretty_rank", "score")


@query(
    "q116_ingest", "psm",
    """, s AS (SELECT psm_id, rs_id, query_id, regexp_matches(s_name, '[13579]$') AS is_decoy, score FROM psm JOIN supplier ON s_suppkey = protein_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_decoy ORDER BY score DESC, psm_id) AS k FROM s),
    f(psm_id, rs_id, query_id, is_decoy, score, k, r, lead_score) AS (SELECT psm_id, rs_id, query_id, is_decoy, score, k, 1, score FROM o WHERE k = 1
      UNION ALL SELECT o.psm_id, o.rs_id, o.query_id, o.is_decoy, o.score, o.k, CASE WHEN f.lead_score - o.score > 1e0 THEN f.r + 1 ELSE f.r END, CASE WHEN f.lead_score - o.score > 1e0 THEN o.score ELSE f.lead_score END
      FROM f JOIN o ON o.query_id = f.query_id AND o.is_decoy = f.is_decoy AND o.k = f.k + 1),
    n AS (SELECT rs_id, query_id, CAST(row_number() OVER (PARTITION BY rs_id ORDER BY query_id) AS INT) AS initial_id FROM (SELECT DISTINCT rs_id, query_id FROM psm))
    SELECT psm_id, rs_id, query_id, initial_id, is_decoy, CAST(r AS INT) AS pretty_rank, score FROM f JOIN n USING (rs_id, query_id)""",
    recursive=True,
)
def q116(v: Views):
    proteins = v.table("supplier").select(F.col("s_suppkey").alias("protein_id"), "s_name")
    return ingested(v.psm.select("psm_id", "rs_id", "query_id", "protein_id", "score"), proteins, "[13579]$", "s_name", 1.0)


@query("q117_leaves", "edge", "SELECT DISTINCT child_id FROM edge WHERE child_id NOT IN (SELECT parent_id FROM edge)")
def q117(v: Views):
    return hierarchy.leaves(v.edge)


@query(
    "q118_nearest_scan", "feature",
    """SELECT a.feature_id, b.feature_id AS scan_id FROM feature a JOIN feature b ON a.map_id = b.map_id AND b.feature_id % 3 = 0 AND a.feature_id % 3 <> 0 AND abs(a.t - b.t) <= 18e2
    QUALIFY row_number() OVER (PARTITION BY a.feature_id ORDER BY abs(a.t - b.t), b.feature_id) = 1""",
)
def q118(v: Views):
    scans = v.feature.filter("feature_id % 3 = 0").select("map_id", F.col("feature_id").alias("scan_id"), F.col("t").alias("scan_t"))
    return rangejoin.nearest(v.feature.filter("feature_id % 3 <> 0").select("feature_id", "map_id", "t"), scans, ["map_id"], "t", "scan_t", 1800.0, "scan_id").select("feature_id", "scan_id")


_REPORTERS = [20.0, 40.0, 60.0, 80.0]


@query(
    "q119_reporter_peaks", "feature",
    f"""SELECT map_id, charge, reporter, feature_id AS peak_id, intensity FROM feature JOIN (SELECT CAST(unnest({_REPORTERS}) AS DOUBLE) AS reporter) ON abs(mz - reporter) <= 5e-1
    QUALIFY row_number() OVER (PARTITION BY map_id, charge, reporter ORDER BY abs(mz - reporter), feature_id) = 1""",
)
def q119(v: Views):
    wanted = v.feature.select("map_id", "charge").distinct().withColumn("reporter", F.explode(F.array(*map(F.lit, _REPORTERS))))
    found = v.feature.select("map_id", "charge", F.col("feature_id").alias("peak_id"), "mz", "intensity")
    return rangejoin.nearest(wanted, found, ["map_id", "charge"], "reporter", "mz", 0.5, "peak_id").select("map_id", "charge", "reporter", "peak_id", "intensity")


@query(
    "q120_single_per_rank", "psm",
    """, n AS (SELECT protein_id, count(*) AS c FROM psm GROUP BY 1)
    SELECT query_id, rank, psm_id FROM psm JOIN n USING (protein_id) QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY score DESC, c DESC, delta_moz, peptide_id, psm_id) = 1""",
)
def q120(v: Views):
    return ranking.single_per_query(v.psm, ["query_id", "rank"]).select("query_id", "rank", "psm_id")


@query(
    "q121_typed_select", "",
    """SELECT o.o_orderkey AS orders_o_orderkey, c.c_custkey AS customer_c_custkey, n.n_name AS nation_n_name, r.r_name AS region_r_name FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice > 2e5""",
)
def q121(v: Views):
    named = {t: v.table(t) for t in ("orders", "customer", "nation", "region")}
    p = {t: df.select(*(F.col(c).alias(f"{t}_{c}") for c in df.columns)) for t, df in named.items()}
    joined = p["orders"].filter("orders_o_totalprice > 2e5").join(p["customer"], F.col("orders_o_custkey") == F.col("customer_c_custkey"))
    joined = joined.join(p["nation"], F.col("customer_c_nationkey") == F.col("nation_n_nationkey")).join(p["region"], F.col("nation_n_regionkey") == F.col("region_r_regionkey"))
    return joined.select("orders_o_orderkey", "customer_c_custkey", "nation_n_name", "region_r_name")


@query(
    "q122_master_map", "feature",
    """, a AS (SELECT * FROM feature WHERE map_id = 0), b AS (SELECT * FROM feature WHERE map_id = 1), c AS (SELECT * FROM feature WHERE map_id = 2),
    m1 AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.charge = b.charge AND abs(a.mz - b.mz) < 5e-2 AND abs(a.t - b.t) < least(a.duration, b.duration) + 72e2)),
    m2 AS (SELECT * FROM m1 UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.charge = c.charge AND abs(m1.mz - c.mz) < 5e-2 AND abs(m1.t - c.t) < least(m1.duration, c.duration) + 72e2))
    SELECT map_id, count(*) AS n, min(feature_id) AS first_feature FROM m2 GROUP BY 1""",
)
def q122(v: Views):
    match = lambda masters, m: rangejoin.boxes(masters, m, ["charge"], 0.05, 7200.0).select(F.col("r_feature_id").alias("feature_id"))
    masters = cluster.master_map([v.feature.filter(F.col("map_id") == i) for i in range(3)], match)
    return masters.groupBy("map_id").agg(F.count("*").alias("n"), F.min("feature_id").alias("first_feature"))


def set_profiles(abundances: DataFrame, items: DataFrame, scores: DataFrame, groups: DataFrame, first: int, over: float = 1.5) -> DataFrame:
    """(set_id, ratio, state) of sets from their items' abundances: razor items, sums by channel, normalised, groups compared.

    abundances: (item, channel, value); items: (set_id, item); scores: (set_id, score); groups: (channel, group).
    """
    owned = abundances.join(inference.razor(items, scores), "item")
    level = materialised(owned.groupBy("set_id", "channel").agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("value")), "levels")
    normal = quant.normalise(level, ["set_id"], "channel", "value", first)
    return quant.group_ratio(normal.join(materialised(groups, "groups"), "channel"), ["set_id"], "group", "abundance", 2, 1, over)


@query(
    "p06_set_profiles", "psm channel",
    """, i AS (SELECT DISTINCT query_id AS set_id, peptide_id AS item FROM psm), c AS (SELECT item, count(*) AS n FROM i GROUP BY 1),
    s AS (SELECT set_id, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS k FROM i JOIN c USING (item) GROUP BY 1), b AS (SELECT query_id AS set_id, max(score) AS score FROM psm GROUP BY 1),
    z AS (SELECT item, set_id FROM i JOIN s USING (set_id) JOIN b USING (set_id) QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC, score DESC, set_id) = 1),
    a AS (SELECT set_id, rs_id AS channel, CAST(sum(CAST(score AS DECIMAL(28,6))) AS DOUBLE) AS v FROM psm JOIN z ON item = peptide_id GROUP BY 1, 2),
    f AS (SELECT a.channel AS channel, median(r.v / a.v) AS factor FROM a JOIN a r ON r.set_id = a.set_id AND r.channel = 1995 GROUP BY 1),
    m AS (SELECT set_id, qc_id, group_number, v * coalesce(factor, 1) AS v FROM a LEFT JOIN f ON f.channel = a.channel JOIN channel q ON q.qc_id = a.channel),
    r AS (SELECT set_id, median(v) FILTER (group_number = 2) / median(v) FILTER (group_number = 1) AS ratio FROM m GROUP BY 1)
    SELECT set_id, floor(ratio * 1e6 + 4321e-4) / 1e6 AS ratio, CASE WHEN ratio >= 15e-1 THEN 1 WHEN ratio <= 1 / 15e-1 THEN -1 WHEN ratio IS NOT NULL THEN 0 END AS state FROM r""",
)
def p06(v: Views):
    abundances = v.psm.groupBy(F.col("peptide_id").alias("item"), F.col("rs_id").alias("channel")).agg(F.sum(F.col("score").cast("decimal(28,6)")).alias("value"))
    scores = v.psm.groupBy(F.col("query_id").alias("set_id")).agg(F.max("score").alias("score"))
    items = v.psm.select(F.col("query_id").alias("set_id"), F.col("peptide_id").alias("item"))
    groups = v.channel.select(F.col("qc_id").alias("channel"), F.col("group_number").alias("group"))
    return set_profiles(abundances, items, scores, groups, 1995).withColumn("ratio", F.floor(F.col("ratio") * 1e6 + 4321e-4) / 1e6)

"""Catalogue: further filters, profiles, windows and rules (q72 to q82)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import alignment, cluster, fdr, filters, peaks, quant
from .features import _SMOOTH, _landmarks
from .registry import query
from .views import Views


@query(
    "q72_profile_clusters", "quant",
    """, m AS (SELECT entity_id, qc_id, median(raw_abundance) AS a FROM quant GROUP BY 1, 2),
    s AS (SELECT m.entity_id, m.qc_id, CASE WHEN m.a / r.a >= 15e-1 THEN '1' WHEN m.a / r.a <= 1 / 15e-1 THEN '-1' ELSE '0' END AS s FROM m JOIN m r ON r.entity_id = m.entity_id AND r.qc_id = 1995)
    SELECT profile, count(*) AS n, min(entity_id) AS first_entity FROM (SELECT entity_id, string_agg(s, '|' ORDER BY qc_id) AS profile FROM s GROUP BY 1) GROUP BY 1""",
)
def q72(v: Views):
    level = quant.summarise(v.quant, "entity_id", "row_id", "qc_id", "raw_abundance", "median")
    first = level.filter("qc_id = 1995").select("entity_id", F.col("raw_abundance").alias("a0"))
    r = F.col("raw_abundance") / F.col("a0")
    state = F.when(r >= 1.5, "1").when(r <= 1 / 1.5, "-1").otherwise("0")
    states = level.join(first, "entity_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("qc_id", state.alias("s")))).alias("s"))
    keyed = states.select("entity_id", cluster.profile_key(F.transform("s", lambda x: x["s"])).alias("profile"))
    return keyed.groupBy("profile").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_entity"))


@query(
    "q73_relative_intensity", "feature",
    """, m AS (SELECT map_id, median(intensity) * 50 / 1e2 AS threshold FROM feature GROUP BY 1)
    SELECT feature_id, CASE WHEN intensity > threshold THEN 2 ELSE 1 END AS selection_level FROM feature JOIN m USING (map_id)""",
)
def q73(v: Views):
    return filters.relative_intensity_level(v.feature, 50, ["map_id"]).select("feature_id", "selection_level")


@query(
    "q74_unspecific_peptides", "occurrence",
    """, n AS (SELECT peptide_id, count(DISTINCT protein_id) AS n_holders FROM occurrence GROUP BY 1)
    SELECT protein_id, peptide_id, n_holders, n_holders = 1 AS is_validated FROM occurrence JOIN n USING (peptide_id)""",
)
def q74(v: Views):
    return filters.unspecific(v.occurrence, "peptide_id", "protein_id")


@query(
    "q75_fdr_methods", "psm",
    """, c AS (SELECT rs_id, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM psm GROUP BY 1)
    SELECT rs_id, 1e2 * d / t AS plain, 2e2 * d / (t + d) AS two_fold, 1e2 * (d + 1) / (2e0 * t) AS corrected FROM c""",
)
def q75(v: Views):
    n = fdr.counts(v.psm, ["rs_id"])
    by = lambda m, **how: fdr.estimate(F.col("target"), F.col("decoy"), m, **how).alias(m)
    return n.select("rs_id", by("plain"), by("two_fold"), by("corrected", ratio=2.0))


@query(
    "q76_count_windows", "feature",
    """, o AS (SELECT map_id, intensity, t, row_number() OVER (PARTITION BY map_id ORDER BY t, intensity) - 1 AS k FROM feature),
    w AS (SELECT map_id, t, intensity AS dt, CAST(unnest(range(CAST(greatest(0, ceil((k - 49) / 25e0)) AS BIGINT), CAST(floor(k / 25e0) AS BIGINT) + 1)) AS BIGINT) AS win FROM o)
    SELECT map_id, win AS "window", floor((min(t) + max(t)) / 2 * 1e1 + 5e-1) / 1e1 AS t, median(dt) AS dt, count(*) AS n FROM w GROUP BY 1, 2""",
)
def q76(v: Views):
    marks = v.feature.select("map_id", "t", F.col("intensity").alias("dt"))
    return alignment.count_windows(marks, ["map_id"], 50, 0.5).select("map_id", "window", rounded(F.col("t"), 1).alias("t"), "dt", "n")


@query(
    "q77_monotone_landmarks", "feature",
    _SMOOTH + """, o AS (SELECT mass_bin, t, dt, row_number() OVER (PARTITION BY mass_bin ORDER BY t, dt) AS k FROM s),
    f(mass_bin, k, t, dt, lt, lm, keep) AS (
      SELECT mass_bin, k, t, dt, t, t + dt, true FROM o WHERE k = 1
      UNION ALL SELECT o.mass_bin, o.k, o.t, o.dt, CASE WHEN o.t > lt AND o.t + o.dt > lm THEN o.t ELSE lt END, CASE WHEN o.t > lt AND o.t + o.dt > lm THEN o.t + o.dt ELSE lm END,
        o.t > lt AND o.t + o.dt > lm FROM f JOIN o ON o.mass_bin = f.mass_bin AND o.k = f.k + 1)
    SELECT mass_bin, floor(t * 1e1 + 5e-1) / 1e1 AS t, floor(dt * 1e1 + 5e-1) / 1e1 AS dt FROM f WHERE keep""",
    recursive=True,
)
def q77(v: Views):
    kept = alignment.monotone(alignment.time_windows(_landmarks(v), ["mass_bin"], 86400.0, 0.5, 3), ["mass_bin"])
    return kept.select("mass_bin", rounded(F.col("t"), 1).alias("t"), rounded(F.col("dt"), 1).alias("dt"))


@query(
    "q78_optimal_set_rules", "psm",
    """, s AS (SELECT query_id, is_decoy, count(DISTINCT peptide_id) AS n_items, max(score) AS score FROM psm GROUP BY 1, 2),
    g AS (SELECT n_items = 1 AS single, score, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM s GROUP BY 1, 2),
    c AS (SELECT single, score, CAST(sum(t) OVER w AS BIGINT) AS t, CAST(sum(d) OVER w AS BIGINT) AS d FROM g WINDOW w AS (PARTITION BY single ORDER BY score DESC)),
    p AS (SELECT m.score AS multi_at, o.score AS single_at, m.t + o.t AS target, m.d + o.d AS decoy, 2e2 * (m.d + o.d) / (m.t + o.t + m.d + o.d) AS fdr FROM c m, c o WHERE NOT m.single AND o.single),
    b AS (SELECT max(target) AS target FROM p WHERE fdr <= 66)
    SELECT p.* FROM p JOIN b USING (target) WHERE fdr <= 66 ORDER BY fdr, multi_at, single_at LIMIT 1""",
)
def q78(v: Views):
    sets = v.psm.groupBy("query_id", "is_decoy").agg(F.count_distinct("peptide_id").alias("n_items"), F.max("score").alias("score"))
    return fdr.optimal_set_rules(sets, 66.0)


@query(
    "q79_peak_apex", "",
    """, e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS y FROM embeddings)
    SELECT vec_id, list_max(y) AS apex, CAST(list_position(y, list_max(y)) AS INT) AS apex_at FROM e""".replace(", e AS", "WITH e AS", 1),
)
def q79(v: Views):
    signal = F.transform("embedding", lambda x, i: F.struct(i.cast("double").alias("time"), F.abs(x.cast("double")).alias("intensity")))
    return v.table("embeddings").select("vec_id", signal.alias("p")).select("vec_id", peaks.apex(F.col("p")).alias("apex"), peaks.apex_index(F.col("p")).alias("apex_at"))


@query(
    "q80_peak_area", "",
    """SELECT vec_id, floor(list_sum(list_transform(range(1, len(embedding)), lambda i: (abs(embedding[i]::DOUBLE) + abs(embedding[i + 1]::DOUBLE)) / 2)) * 1e6 + 5e-1) / 1e6 AS area FROM embeddings""",
)
def q80(v: Views):
    signal = F.transform("embedding", lambda x, i: F.struct(i.cast("double").alias("time"), F.abs(x.cast("double")).alias("intensity")))
    return v.table("embeddings").select("vec_id", rounded(peaks.area(signal), 6).alias("area"))


@query(
    "q81_time_chains", "feature",
    """, m AS (SELECT feature_id, map_id, charge, t, CASE WHEN t > lag(t + duration) OVER w + 18e2 THEN 1 WHEN lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM feature
      WINDOW w AS (PARTITION BY map_id, charge ORDER BY t, feature_id))
    SELECT feature_id, CAST(sum(n) OVER (PARTITION BY map_id, charge ORDER BY t, feature_id) AS BIGINT) AS chain FROM m""",
)
def q81(v: Views):
    return cluster.time_chains(v.feature, ["map_id", "charge"], 1800.0).select("feature_id", "chain")


@query(
    "q82_reference_map", "feature",
    """, d AS (SELECT a.map_id, b.t - a.t AS dt FROM feature a JOIN feature b ON a.charge = b.charge AND a.map_id <> b.map_id AND abs(a.mz - b.mz) < 5e-1 AND abs(a.t - b.t) < least(a.duration, b.duration) + 72e2)
    SELECT map_id, floor(avg(abs(dt)) * 1e2 + 5e-1) / 1e2 AS mean_dt FROM d GROUP BY 1 ORDER BY avg(abs(dt)), map_id LIMIT 1""",
)
def q82(v: Views):
    from ..operators import rangejoin

    pairs = rangejoin.boxes(v.feature, v.feature, ["charge"], 0.5, 7200.0).filter("l_map_id <> r_map_id")
    best = alignment.reference_map(pairs.select(F.col("l_map_id").alias("map_id"), (F.col("r_t") - F.col("l_t")).alias("dt")))
    return best.select("map_id", rounded(F.col("mean_dt"), 2).alias("mean_dt"))

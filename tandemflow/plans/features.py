"""Catalogue: range joins, clusters, alignment, map normalisation, sites, scalar functions (q38 to q45, q55 to q59)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import first_match, rounded
from ..operators import alignment, cluster, filters, ptm, rangejoin
from .registry import query
from .views import Views

_PAIRS = """, p AS (SELECT a.feature_id AS l, b.feature_id AS r, a.t AS lt, b.t AS rt, a.mz AS lmz, a.intensity AS li, b.intensity AS ri, b.map_id AS child FROM feature a
      JOIN feature b ON a.charge = b.charge AND abs(a.mz - b.mz) < 5e-1 AND abs(a.t - b.t) < least(a.duration, b.duration) + 72e2 AND a.map_id = 0 AND b.map_id {which})
    """


def _map(v: Views, which: int):
    return v.feature.filter(F.col("map_id") == which)


@query("q38_range_join_features", "feature", _PAIRS.format(which="= 1") + "SELECT l AS l_feature_id, r AS r_feature_id FROM p")
def q38(v: Views):
    return rangejoin.boxes(_map(v, 0), _map(v, 1), ["charge"], 0.5, 7200.0).select("l_feature_id", "r_feature_id")


@query(
    "q39_nearest_in_time", "feature",
    """SELECT a.feature_id, b.feature_id AS near_id FROM feature a JOIN feature b ON a.charge = b.charge AND a.map_id = 0 AND b.map_id = 1 AND abs(a.t - b.t) <= 36e2
    QUALIFY row_number() OVER (PARTITION BY a.feature_id ORDER BY abs(a.t - b.t), b.feature_id) = 1""",
)
def q39(v: Views):
    right = _map(v, 1).select("charge", F.col("feature_id").alias("near_id"), F.col("t").alias("near_t"))
    return rangejoin.nearest(_map(v, 0).select("feature_id", "charge", "t"), right, ["charge"], "t", "near_t", 3600.0, "near_id").select("feature_id", "near_id")


_ISLANDS = """, i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY map_id, charge ORDER BY mz) AS BIGINT) AS island FROM
      (SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY map_id, charge ORDER BY mz, feature_id) <= 5e-2 THEN 0 ELSE 1 END AS brk FROM feature))
    """


@query("q40_mz_islands", "feature", _ISLANDS + "SELECT feature_id, island FROM i")
def q40(v: Views):
    return cluster.islands(v.feature, ["map_id", "charge"], "mz", 0.05).select("feature_id", "island")


@query(
    "q41_cluster_summary", "feature",
    _ISLANDS + """SELECT map_id, charge, island, count(*) AS n, CAST(sum(CAST(intensity AS DECIMAL(18,4))) AS DOUBLE) AS intensity, max(intensity) AS most_intense,
    arg_max(feature_id, (intensity, -feature_id)) AS best_feature, floor(median(t) * 1e1 + 5e-1) / 1e1 AS t FROM i GROUP BY 1, 2, 3""",
)
def q41(v: Views):
    placed = cluster.islands(v.feature, ["map_id", "charge"], "mz", 0.05)
    return cluster.summaries(placed, ["map_id", "charge", "island"]).withColumn("t", rounded(F.col("t"), 1))


_LANDMARKS = _PAIRS.format(which="= 1") + """, u AS (SELECT CAST(floor(lmz / 5e1) AS BIGINT) AS mass_bin, lt AS t, rt - lt AS dt FROM p
      WHERE l IN (SELECT l FROM p GROUP BY 1 HAVING count(*) = 1) AND r IN (SELECT r FROM p GROUP BY 1 HAVING count(*) = 1))
    """


def _landmarks(v: Views):
    return alignment.landmarks(_map(v, 0), _map(v, 1), 0.5, 7200.0, 50.0)


@query("q42_alignment_landmarks", "feature", _LANDMARKS + "SELECT mass_bin, floor(t * 1e1 + 5e-1) / 1e1 AS t, floor(dt * 1e1 + 5e-1) / 1e1 AS dt FROM u")
def q42(v: Views):
    return _landmarks(v).select("mass_bin", rounded(F.col("t"), 1).alias("t"), rounded(F.col("dt"), 1).alias("dt"))


_SMOOTH = _LANDMARKS + """, w AS (SELECT mass_bin, unnest(range(CAST(floor((t - 864e2) / 432e2) AS BIGINT) + 1, CAST(floor(t / 432e2) AS BIGINT) + 1)) AS win, t, dt FROM u),
    s AS (SELECT mass_bin, win, (min(t) + max(t)) / 2 AS t, median(dt) AS dt, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
    """


@query("q43_time_window_smooth", "feature", _SMOOTH + 'SELECT mass_bin, win AS "window", floor(t * 1e1 + 5e-1) / 1e1 AS t, floor(dt * 1e1 + 5e-1) / 1e1 AS dt, n FROM s')
def q43(v: Views):
    out = alignment.time_windows(_landmarks(v), ["mass_bin"], 86400.0, 0.5, 3)
    return out.select("mass_bin", "window", rounded(F.col("t"), 1).alias("t"), rounded(F.col("dt"), 1).alias("dt"), "n")


@query(
    "q44_interpolate_time", "feature",
    _SMOOTH + """, d AS (SELECT mass_bin, t, min(dt) AS dt FROM s GROUP BY 1, 2),
    g AS (SELECT mass_bin, t AS t0, dt AS d0, lead(t) OVER w AS t1, lead(dt) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY mass_bin ORDER BY t)),
    e AS (SELECT mass_bin, min(t) AS lo, max(t) AS hi FROM d GROUP BY 1),
    f AS (SELECT feature_id, f.t, least(greatest(f.t, lo), hi) AS pos, e.mass_bin FROM feature f JOIN e ON e.mass_bin = floor(mz / 5e1))
    SELECT feature_id, floor((f.t + CASE WHEN t1 IS NULL OR pos <= t0 THEN d0 ELSE d0 + (d1 - d0) * (pos - t0) / (t1 - t0) END) * 1e1 + 5e-1) / 1e1 AS aligned_t
    FROM f JOIN g ON g.mass_bin = f.mass_bin AND pos >= t0 AND (t1 IS NULL OR pos < t1)""",
)
def q44(v: Views):
    marks = alignment.time_windows(_landmarks(v), ["mass_bin"], 86400.0, 0.5, 3).groupBy("mass_bin", "t").agg(F.min("dt").alias("dt"))
    features = v.feature.select("feature_id", "t", F.floor(F.col("mz") / 50).alias("mass_bin"))
    return alignment.converted(features, marks, ["mass_bin"], 86400.0).select("feature_id", rounded(F.col("aligned_t"), 1).alias("aligned_t"))


_FACTOR = """, v AS (SELECT map_id, {of_map} AS v FROM feature GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v, map_id) AS k, count(*) OVER () AS n FROM v)
    SELECT map_id, floor((SELECT v FROM r WHERE k = floor((n + 1) / 2)) / v * 1e9 + 5e-1) / 1e9 AS factor FROM r"""


@query("q45_map_norm_sum", "feature", _FACTOR.format(of_map="CAST(sum(CAST(intensity AS DECIMAL(18,4))) AS DOUBLE)"))
def q45a(v: Views):
    return alignment.map_factors(v.feature, "sum").withColumn("factor", rounded(F.col("factor"), 9))


@query("q45_map_norm_median", "feature", _FACTOR.format(of_map="median(intensity)"))
def q45b(v: Views):
    return alignment.map_factors(v.feature, "median").withColumn("factor", rounded(F.col("factor"), 9))


@query(
    "q45_map_norm_ratio", "feature",
    _PAIRS.format(which="> 0") + "SELECT child AS map_id, floor(median(li / ri) * 1e9 + 5e-1) / 1e9 AS factor FROM p GROUP BY 1",
)
def q45c(v: Views):
    pairs = rangejoin.boxes(_map(v, 0), v.feature.filter("map_id > 0"), ["charge"], 0.5, 7200.0)
    ratios = alignment.ratio_factors(pairs.select(F.col("r_map_id").alias("map_id"), F.col("l_intensity").alias("reference"), F.col("r_intensity").alias("child")))
    return ratios.withColumn("factor", rounded(F.col("factor"), 9))


@query(
    "q55_ptm_sites", "psm",
    """, m AS (SELECT protein_id, peptide_id, rank * 10 AS start, score, unnest(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = 'e')) AS pos
      FROM psm JOIN part ON p_partkey = peptide_id)
    SELECT protein_id, 'e' AS ptm, CAST(start + pos - 1 AS BIGINT) AS position, count(DISTINCT peptide_id) AS n_peptides, max(score) AS score, arg_max(peptide_id, (score, -peptide_id)) AS best_peptide
    FROM m GROUP BY 1, 2, 3""",
)
def q55(v: Views):
    found = v.table("part").select(F.col("p_partkey").alias("peptide_id"), F.explode(ptm.positions(F.col("p_name"), "e")).alias("ptm_position"))
    matches = v.psm.select("protein_id", "peptide_id", (F.col("rank") * 10).alias("start"), "score").join(found, "peptide_id").withColumn("ptm", F.lit("e"))
    return ptm.sites(matches).withColumn("position", F.col("position").cast("long"))


@query(
    "q56_missed_cleavage", "",
    """SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS sequence,
      NOT regexp_matches(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '[RK].') AS is_validated FROM part""",
)
def q56(v: Views):
    parts = v.table("part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("sequence"))
    return filters.discard_missed_cleavage(parts, "forms")


@query(
    "q57_title_parse", "",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)\\.html', 1), ''), nullif(regexp_extract(url, '/([0-9]+)/$', 1), ''), nullif(regexp_extract(url, '/([0-9]+)', 1), '')) AS first_number
    FROM pages""",
)
def q57(v: Views):
    return v.table("pages").select("page_id", first_match(F.col("url"), [r"/([0-9]+)\.html", r"/([0-9]+)/$", r"/([0-9]+)"]).alias("first_number"))


@query(
    "q58_coverage", "psm",
    """, i AS (SELECT protein_id, unnest(range(peptide_id * 7 % 900, peptide_id * 7 % 900 + 5 + rank)) AS residue FROM psm)
    SELECT protein_id, count(DISTINCT residue) AS covered, CAST(floor(100 * count(DISTINCT residue) / 1000) AS BIGINT) AS coverage FROM i GROUP BY 1""",
)
def q58(v: Views):
    start = F.col("peptide_id") * 7 % 900
    intervals = v.psm.select("protein_id", start.alias("start"), (start + 4 + F.col("rank")).alias("stop"))
    return ptm.coverage(intervals, "protein_id", F.lit(1000))


@query("q59_json_props", "", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def q59(v: Views):
    parsed = v.table("events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("q62_loess")
def q62(v: Views):
    return alignment.loess_smoothed(alignment.time_windows(_landmarks(v), ["mass_bin"], 86400.0, 0.5, 3), ["mass_bin"])


@query(
    "q63_savgol", "",
    """SELECT event_id, floor(coalesce((143 * value + 120 * (lag(value, 1) OVER w + lead(value, 1) OVER w) + 60 * (lag(value, 2) OVER w + lead(value, 2) OVER w) - 10 * (lag(value, 3) OVER w + lead(value, 3) OVER w)
      - 45 * (lag(value, 4) OVER w + lead(value, 4) OVER w) + 18 * (lag(value, 5) OVER w + lead(value, 5) OVER w)) / 429, value) * 1e6 + 5e-1) / 1e6 AS smooth
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def q63(v: Views):
    out = alignment.savitzky_golay(v.table("events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", rounded(F.col("smooth"), 6).alias("smooth"))


@query(
    "q66_cross_assignment", "psm",
    """, m AS (SELECT peptide_id, charge, arg_max(rs_id, (score, -rs_id)) AS source_run, list(DISTINCT rs_id) AS present FROM psm GROUP BY 1, 2)
    SELECT peptide_id, charge, source_run, CAST(unnest(list_filter(range(1995, 2002), lambda r: NOT list_contains(present, r))) AS INT) AS rs_id FROM m""",
)
def q66(v: Views):
    return cluster.cross_assignment(v.psm.select("peptide_id", "charge", "rs_id", "score"), ["peptide_id", "charge"], "rs_id", list(range(1995, 2002)), "score")

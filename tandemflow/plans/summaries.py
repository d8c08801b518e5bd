"""Catalogue: summaries, labels, samples, clusters of peptides and sites, calibration (q100 to q115)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import alignment, cluster, peaks, ptm, quant, rangejoin
from .abundance import _PROFILE
from .registry import query
from .views import Views

_SUM = "CAST(sum(CAST({} AS DECIMAL(28,6))) AS DOUBLE)"
_CHILDREN = """, ch AS (SELECT peptide_id * 10 + charge AS master_id, CASE WHEN peptide_id % 5 <> 0 THEN peptide_id END AS peptide_id, rs_id AS channel, score AS value FROM psm),
    ion AS (SELECT coalesce(CAST(peptide_id AS STRING), concat('-', CAST(master_id AS STRING))) AS peptide_key, master_id, channel, sum(CAST(value AS DECIMAL(28,6))) AS v, count(*) AS m FROM ch GROUP BY 1, 2, 3),
    n AS (SELECT peptide_key, count(DISTINCT master_id) AS n_ions FROM ion GROUP BY 1)
    """


def _children(v: Views):
    master = F.col("peptide_id") * 10 + F.col("charge")
    return v.psm.select(master.alias("master_id"), F.when(F.col("peptide_id") % 5 != 0, F.col("peptide_id")).alias("peptide_id"), F.col("rs_id").alias("channel"), F.col("score").alias("value"), F.lit(1).alias("n_matches"))


@query("q100_label_free_sum", "psm", _CHILDREN + "SELECT peptide_key, channel, CAST(sum(v) AS DOUBLE) AS value, n_ions FROM ion JOIN n USING (peptide_key) GROUP BY 1, 2, 4")
def q100(v: Views):
    return quant.label_free(_children(v), "channel", "value")


@query(
    "q101_label_free_best_ion", "psm",
    _CHILDREN.rstrip() + """, b AS (SELECT peptide_key, master_id FROM ion GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY peptide_key ORDER BY count(*) DESC, sum(m) DESC, sum(v) DESC, master_id) = 1)
    SELECT peptide_key, channel, CAST(sum(v) AS DOUBLE) AS value, n_ions FROM ion JOIN b USING (peptide_key, master_id) JOIN n USING (peptide_key) GROUP BY 1, 2, 4""",
)
def q101(v: Views):
    return quant.label_free(_children(v), "channel", "value", "best_ion")


@query(
    "q102_residue_labels", "psm",
    f"""SELECT rs_id, charge, concat('S', CAST(peptide_id AS STRING), CASE WHEN rank = 2 OR rank = 5 THEN '%9' ELSE '' END) AS form, CASE rank % 3 WHEN 0 THEN 'heavy' WHEN 1 THEN 'light' ELSE 'medium' END AS label,
    {_SUM.format('score')} AS score, count(*) AS n FROM psm GROUP BY ALL""",
)
def q102(v: Views):
    ids = F.when(F.col("rank") % 3 == 0, F.array(F.lit(1))).when(F.col("rank") % 3 == 1, F.array().cast("array<int>")).otherwise(
        F.when(F.col("rank").isin(2, 5), F.array(F.lit(2), F.lit(9))).otherwise(F.array(F.lit(2)))
    )
    ions = v.psm.select("rs_id", "charge", F.concat(F.lit("S"), F.col("peptide_id").cast("string")).alias("sequence"), ids.alias("ptm_ids"), "score")
    return quant.label_channels(ions, {"light": [], "medium": [2], "heavy": [1]}, "score", ["rs_id", "charge"])


_SAMPLES = """, s0 AS (SELECT entity_id, row_id, (qc_id - 1994) // 2 AS sample, median(raw_abundance) AS x, count(*) AS n FROM quant GROUP BY 1, 2, 3),
    keep AS (SELECT entity_id, row_id FROM s0 GROUP BY 1, 2 HAVING max(n) >= 2), s1 AS (SELECT s0.* FROM s0 JOIN keep USING (entity_id, row_id)),
    many AS (SELECT entity_id, count(*) AS r FROM keep GROUP BY 1), col AS (SELECT entity_id, sample FROM s1 JOIN many USING (entity_id) GROUP BY 1, 2, r HAVING 2 * count(*) >= r),
    qs AS (SELECT entity_id, row_id, CAST(sample AS INT) AS qc_id, x AS raw_abundance FROM s1 JOIN col USING (entity_id, sample))"""


@query("q103_biological_profile", "quant", _SAMPLES + _PROFILE.replace("FROM quant", "FROM qs").replace("* 1e2 + 5e-1", "* 1e2 + 4321e-4"))
def q103(v: Views):
    sampled = v.quant.withColumn("sample", F.expr("(qc_id - 1994) div 2").cast("int"))
    out = quant.biological_profile(sampled, "entity_id", "row_id", "qc_id", "sample", "raw_abundance")
    return out.select("entity_id", F.col("sample").alias("qc_id"), (F.floor(F.col("raw_abundance") * 1e2 + 4321e-4) / 1e2).alias("raw_abundance"))


@query(
    "q104_sample_ratio", "quant channel",
    """, m AS (SELECT entity_id, group_number, qc_id, median(raw_abundance) AS a FROM quant JOIN channel USING (qc_id) GROUP BY 1, 2, 3),
    r AS (SELECT entity_id, median(CASE WHEN group_number = 2 THEN a END) / median(CASE WHEN group_number = 1 THEN a END) AS ratio FROM m GROUP BY 1)
    SELECT entity_id, floor(ratio * 1e9 + 5e-1) / 1e9 AS ratio, CASE WHEN ratio >= 2e0 THEN 1 WHEN ratio <= 1 / 2e0 THEN -1 WHEN ratio IS NOT NULL THEN 0 END AS state FROM r""",
)
def q104(v: Views):
    grouped = v.quant.join(v.channel, "qc_id")
    return quant.sample_group_ratio(grouped, ["entity_id"], "group_number", "qc_id", "raw_abundance", 2, 1).withColumn("ratio", rounded(F.col("ratio"), 9))


@query(
    "q105_relative_error_bins", "quant channel",
    """, m AS (SELECT entity_id, median(CASE WHEN group_number = 2 THEN raw_abundance END) AS a, median(CASE WHEN group_number = 1 THEN raw_abundance END) AS b FROM quant JOIN channel USING (qc_id) GROUP BY 1),
    l AS (SELECT log10(greatest(a, b)) AS x, ln(a / b) AS s FROM m WHERE a / b > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
    SELECT CAST(least(floor((x - lo) / (hi - lo) * 5), 4) AS INT) AS bin, count(*) AS n, floor(avg(x) * 1e6 + 5e-1) / 1e6 AS log_abundance,
      floor(quantile_cont(s, 0.25) * 1e6 + 5e-1) / 1e6 AS q1, floor(quantile_cont(s, 0.5) * 1e6 + 5e-1) / 1e6 AS q2, floor(quantile_cont(s, 0.75) * 1e6 + 5e-1) / 1e6 AS q3 FROM l, e GROUP BY 1""",
)
def q105(v: Views):
    of = lambda g: F.median(F.when(F.col("group_number") == g, F.col("raw_abundance")))
    m = v.quant.join(v.channel, "qc_id").groupBy("entity_id").agg(of(2).alias("a"), of(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    bins = quant.relative_error_bins(m.select(F.greatest("a", "b").alias("abundance"), (F.col("a") / F.col("b")).alias("ratio")), "abundance", "ratio", 5)
    return bins.select("bin", "n", *(rounded(F.col(c), 6).alias(c) for c in ("log_abundance", "q1", "q2", "q3")))


_PEPS = """, p AS (SELECT DISTINCT protein_id AS set_id, concat('P', CAST(protein_id AS STRING)) AS accession, peptide_id, concat('S', CAST(peptide_id % 50 AS STRING)) AS sequence,
    peptide_id % 3 = 0 AS modified, CAST(peptide_id % 4 + peptide_id % 20 + 1 AS BIGINT) AS place FROM psm)"""


def _peptides(v: Views):
    i = F.col("peptide_id")
    ptm_ = F.struct((i % 4 + 1).cast("int").alias("position"), F.lit("Phospho").alias("name"))
    return v.psm.select(
        F.col("protein_id").alias("set_id"), F.concat(F.lit("P"), F.col("protein_id").cast("string")).alias("accession"), "peptide_id", F.concat(F.lit("S"), (i % 50).cast("string")).alias("sequence"),
        F.when(i % 3 == 0, F.array(ptm_)).otherwise(F.array().cast("array<struct<position:int,name:string>>")).alias("ptms"), F.array((i % 20 + 1).cast("int")).alias("starts"),
    ).distinct()


@query(
    "q106_ptm_pattern_clusters", "psm",
    _PEPS + """, m AS (SELECT *, concat('Phospho@', CAST(place AS STRING)) AS pattern FROM p WHERE modified), f AS (SELECT set_id, pattern, arg_min(sequence, peptide_id) AS sequence FROM m GROUP BY 1, 2),
    q AS (SELECT set_id, sequence, max(peptide_id) AS peptide_id FROM p WHERE NOT modified GROUP BY 1, 2), u AS (SELECT q.set_id, pattern, peptide_id FROM q JOIN f USING (set_id, sequence))
    SELECT set_id, concat('MODIFIED ', pattern) AS cluster, peptide_id FROM m UNION ALL SELECT set_id, concat('UNMODIFIED ', pattern), peptide_id FROM u
    UNION ALL SELECT set_id, accession, peptide_id FROM p WHERE NOT modified AND (set_id, peptide_id) NOT IN (SELECT set_id, peptide_id FROM u)""",
)
def q106(v: Views):
    return cluster.peptide_clusters(_peptides(v), "ptm_pattern")


@query(
    "q107_sequence_and_set_clusters", "psm",
    _PEPS + """, a AS (SELECT set_id, sequence AS cluster FROM p UNION ALL SELECT set_id, accession FROM p) SELECT set_id, cluster, count(*) AS n FROM a GROUP BY 1, 2""",
)
def q107(v: Views):
    p = _peptides(v)
    both = cluster.peptide_clusters(p, "sequence").unionByName(cluster.peptide_clusters(p, "set"))
    return both.groupBy("set_id", "cluster").agg(F.count("*").alias("n"))


@query(
    "q108_aggregated_sites", "psm",
    """, c AS (SELECT rs_id AS child, protein_id AS accession, charge AS ptm, peptide_id % 30 AS position, psm_id, rank / 7e0 AS confidence, score, peptide_id FROM psm),
    s AS (SELECT child, accession, ptm, position, arg_max(psm_id, (confidence, score, -psm_id)) AS best_psm_id, max(confidence) AS confidence, arg_max(score, (confidence, score, -psm_id)) AS score,
      list(DISTINCT peptide_id) AS peptide_ids FROM c GROUP BY 1, 2, 3, 4)
    SELECT accession, ptm, position, max(confidence) AS confidence, arg_max(best_psm_id, (confidence, score, -best_psm_id)) AS best_psm_id, count(DISTINCT child) AS n_children,
      array_to_string(list_sort(list_distinct(flatten(list(peptide_ids)))), ',') AS peptide_ids FROM s GROUP BY 1, 2, 3""",
)
def q108(v: Views):
    each = v.psm.select(F.col("rs_id").alias("child"), F.col("protein_id").alias("accession"), F.col("charge").alias("ptm"), (F.col("peptide_id") % 30).alias("position"), "psm_id", (F.col("rank") / 7e0).alias("confidence"), "score", "peptide_id")
    by = F.struct("confidence", "score", (-F.col("psm_id")).alias("t"))
    children = each.groupBy("child", "accession", "ptm", "position").agg(
        F.max_by("psm_id", by).alias("best_psm_id"), F.max("confidence").alias("confidence"), F.max_by("score", by).alias("score"), F.collect_set("peptide_id").alias("peptide_ids")
    ).select("child", "accession", "ptm", "position", "best_psm_id", F.col("confidence"), "score", "peptide_ids")
    return ptm.aggregated_sites(children).withColumn("peptide_ids", F.array_join(F.col("peptide_ids").cast("array<string>"), ","))


_SITES = """, m AS (SELECT DISTINCT protein_id, peptide_id, peptide_id % 40 + 1 AS start, peptide_id % 40 + 5 + peptide_id % 7 AS stop FROM psm),
    s AS (SELECT *, list_filter(range(start, stop + 1), lambda i: i % 3 = 0 AND NOT (peptide_id % 4 = 0 AND i % 2 = 0)) AS sites FROM m),
    k AS (SELECT * FROM s WHERE len(sites) > 0), c AS (SELECT DISTINCT protein_id, sites FROM k)"""


@query(
    "q109_site_clusters", "psm",
    _SITES + """, r AS (SELECT protein_id, sites, peptide_id, 'isomorphic' AS status FROM k
    UNION ALL SELECT DISTINCT c.protein_id, c.sites, k.peptide_id, 'partially isomorphic' FROM c JOIN k ON k.protein_id = c.protein_id AND len(c.sites) > len(k.sites) AND list_has_all(c.sites, k.sites)
      AND len(list_filter(c.sites, lambda x: NOT list_contains(k.sites, x) AND x BETWEEN k.start AND k.stop)) = 0)
    SELECT protein_id, array_to_string(sites, ',') AS sites, peptide_id, status FROM r""",
)
def q109(v: Views):
    i = F.col("peptide_id")
    m = v.psm.select("protein_id", "peptide_id", (i % 40 + 1).cast("int").alias("start"), (i % 40 + 5 + i % 7).cast("int").alias("stop")).distinct()
    at = F.filter(F.sequence("start", "stop"), lambda x: (x % 3 == 0) & ~((i % 4 == 0) & (x % 2 == 0)))
    matches = m.withColumn("sites", F.transform(at, lambda x: F.struct(x.alias("position"), F.lit("Phospho").alias("ptm"))))
    out = cluster.site_clusters(matches)
    return out.withColumn("sites", F.array_join(F.transform("sites", lambda s: s["position"].cast("string")), ","))


@query(
    "q110_identity_between_maps", "feature",
    """SELECT a.feature_id AS l_feature_id, b.feature_id AS r_feature_id FROM feature a JOIN feature b ON a.map_id = 0 AND b.map_id = 1 AND a.charge = b.charge AND floor(a.mz) = floor(b.mz) AND abs(a.t - b.t) <= 36e2""",
)
def q110(v: Views):
    f = v.feature.withColumn("peptide", F.floor("mz"))
    return rangejoin.by_identity(f.filter("map_id = 0"), f.filter("map_id = 1"), ["peptide", "charge"], 3600.0)


@query(
    "q111_moz_calibration", "feature",
    """, e AS (SELECT map_id, t, (mz - round(mz)) / round(mz) * 1e6 AS ppm FROM feature WHERE round(mz) > 0), p AS (SELECT * FROM e WHERE abs(ppm) < 2e4),
    w AS (SELECT map_id, t, ppm, unnest(range(CAST(floor((t - 864e2) / 432e2) AS BIGINT) + 1, CAST(floor(t / 432e2) AS BIGINT) + 1)) AS win FROM p),
    g AS (SELECT map_id, win, (min(t) + max(t)) / 2 AS t, median(ppm) AS ppm FROM w GROUP BY 1, 2)
    SELECT map_id, t, floor(avg(ppm) * 1e4 + 5e-1) / 1e4 AS ppm FROM g GROUP BY 1, 2""",
)
def q111(v: Views):
    f = v.feature.withColumn("expected_mz", F.round("mz")).filter("expected_mz > 0")
    out = alignment.moz_calibration(f, ["map_id"], 86400.0, most_ppm=2e4)
    return out.select("map_id", "t", rounded(F.col("ppm")).alias("ppm"))


@query(
    "q112_isotope_deviation_bound", "",
    """WITH e AS (SELECT vec_id, unnest(embedding[1:4])::DOUBLE AS x FROM embeddings), r AS (SELECT vec_id, sqrt(avg(pow(abs(x) - 25e-2, 2))) AS rmsd FROM e WHERE vec_id % 4 IN (2, 3) GROUP BY 1),
    q AS (SELECT count(*) AS n, quantile_cont(rmsd, 0.25) AS q1, quantile_cont(rmsd, 0.75) AS q3 FROM r) SELECT n, floor((q3 + 15e-1 * (q3 - q1)) * 1e6 + 5e-1) / 1e6 AS bound FROM q""",
)
def q112(v: Views):
    each = v.table("embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("charge"), F.explode(F.slice("embedding", 1, 4)).alias("x"))
    bound = ptm.deviation_bound(each.select("vec_id", "charge", F.abs(F.col("x").cast("double")).alias("observed"), F.lit(0.25).alias("expected")), "vec_id")
    return bound.withColumn("bound", rounded(F.col("bound"), 6))


@query(
    "q115_ratio_z", "quant channel",
    """, m AS (SELECT entity_id, median(CASE WHEN group_number = 2 THEN raw_abundance END) AS a, median(CASE WHEN group_number = 1 THEN raw_abundance END) AS b FROM quant JOIN channel USING (qc_id) GROUP BY 1),
    l AS (SELECT entity_id, ln(a / b) AS x FROM m WHERE a > 0 AND b > 0), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM l),
    z AS (SELECT entity_id, (x - q2) / ((q3 - q1) / 1349e-3) AS z FROM l, q)
    SELECT entity_id, floor(z * 1e6 + 4321e-4) / 1e6 AS z, floor((1 - 2 / pi() * atan(abs(z))) * 1e6 + 4321e-4) / 1e6 AS cauchy_p FROM z""",
)
def q115(v: Views):
    z = quant.ratio_z(quant.group_ratio(v.quant.join(v.channel, "qc_id"), ["entity_id"], "group_number", "raw_abundance", 2, 1))
    at = lambda c: F.floor(c * 1e6 + 4321e-4) / 1e6
    return z.select("entity_id", at(F.col("z")).alias("z"), at(quant.cauchy_p(F.col("z"))).alias("cauchy_p"))


@query(
    "q113_fraction_most_intense", "quant",
    "SELECT entity_id, qc_id, max(raw_abundance) AS raw_abundance FROM quant GROUP BY 1, 2",
)
def q113(v: Views):
    return quant.merged_fractions(v.quant, ["entity_id", "qc_id"], "raw_abundance", "most_intense")


@query(
    "q114_peak_top3_and_smoothing", "",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS y FROM embeddings), p AS (SELECT *, list_position(y, list_max(y)) AS a FROM e)
    SELECT vec_id, floor(list_avg(y[greatest(a - 1, 1):least(a + 1, len(y))]) * 1e6 + 5e-1) / 1e6 AS top3,
      floor((143 * y[20] + 120 * (y[19] + y[21]) + 60 * (y[18] + y[22]) - 10 * (y[17] + y[23]) - 45 * (y[16] + y[24]) + 18 * (y[15] + y[25])) / 429 * 1e6 + 5e-1) / 1e6 AS smooth20, y[3] AS smooth3 FROM p""",
)
def q114(v: Views):
    signal = F.transform("embedding", lambda x, i: F.struct(i.cast("double").alias("time"), F.abs(x.cast("double")).alias("intensity")))
    p = v.table("embeddings").select("vec_id", signal.alias("p")).withColumn("s", peaks.smoothed(F.col("p")))
    return p.select("vec_id", rounded(peaks.mean_around_apex(F.col("p")), 6).alias("top3"), rounded(F.col("s")[19]["intensity"], 6).alias("smooth20"), F.col("s")[2]["intensity"].alias("smooth3"))

"""Catalogue: validators, optimised rules, propagation, merged summaries and the remaining filters (q83 to q99)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import alignment, fdr, filters, merge, rangejoin, ranking, validators
from .pipelines import summarised, validated, _VALIDATE
from .registry import query
from .sets import _SETS
from .views import Views

_SET = "SELECT query_id, is_decoy, count(DISTINCT peptide_id) AS n_items, max(score) AS score FROM psm GROUP BY 1, 2"


#: The thresholds of each result set, under names that leave those of the inference free.
_THRESHOLDS = _VALIDATE.replace(", g AS", ", vg AS").replace("FROM g ", "FROM vg ").replace(" c AS", " vc AS").replace("FROM c)", "FROM vc)") + """, b AS (SELECT rs_id, threshold FROM roc QUALIFY row_number() OVER (PARTITION BY rs_id ORDER BY
    CASE WHEN fdr >= 95e-2 * 66e0 AND fdr < 66e0 THEN 0 WHEN fdr < 66e0 THEN 1 ELSE 2 END, CASE WHEN fdr >= 95e-2 * 66e0 AND fdr < 66e0 THEN -target ELSE abs(fdr - 66e0) END, threshold) = 1)"""


def _sets(v: Views) -> DataFrame:
    return v.psm.groupBy("query_id", "is_decoy").agg(F.count_distinct("peptide_id").alias("n_items"), F.max("score").alias("score"))


_ADJUSTED = """, g AS (SELECT {k} score, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(n) OVER ({p} ORDER BY score DESC) AS k, sum(n) OVER ({p}) AS m FROM g),
    a AS (SELECT {k} score, min(m::DOUBLE / k::DOUBLE * pow(1e1, score / -1e1)) OVER ({p} ORDER BY score) AS adjusted FROM r)"""


@query(
    "q83_bh_sets", "psm",
    f", s AS ({_SET})" + _ADJUSTED.format(k="", p="") + "SELECT query_id, is_decoy, adjusted <= 1e-6 AS is_validated FROM s JOIN a USING (score)",
)
def q83(v: Views):
    return validators.benjamini_hochberg(_sets(v), 1e-6, []).select("query_id", "is_decoy", "is_validated")


@query(
    "q84_bh_instances", "psm",
    """, i AS (SELECT peptide_id, is_decoy, 1e0 - pow(1e0 - pow(1e1, max(score) / 1e1 / -1e1), count(*)) AS p FROM psm GROUP BY 1, 2),
    s AS (SELECT peptide_id, is_decoy, floor(-1e1 * log10(p) * 1e4 + 5e-1) / 1e4 AS score FROM i)"""
    + _ADJUSTED.format(k="is_decoy,", p="PARTITION BY is_decoy") + "SELECT peptide_id, is_decoy, adjusted <= 18e-2 AS is_validated FROM s JOIN a USING (is_decoy, score)",
)
def q84(v: Views):
    psms = v.psm.select("peptide_id", "is_decoy", (F.col("score") / 1e1).alias("score"))
    p = F.pow(F.lit(1e1), F.max("score") / -1e1)
    instances = psms.groupBy("peptide_id", "is_decoy").agg((-1e1 * F.log10(1 - F.pow(1 - p, F.count("*")))).alias("score")).withColumn("score", C.rounded(F.col("score")))
    return validators.benjamini_hochberg(instances, 0.18, ["is_decoy"]).select("peptide_id", "is_decoy", "is_validated")


def _rule_sql(name: str, source: str, start: str) -> str:
    return f""", {name}g AS (SELECT score, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM {source} GROUP BY 1),
    {name}c AS (SELECT score, t, d, b.t0 + sum(t) OVER w AS target, b.d0 + sum(d) OVER w AS decoy FROM {name}g, ({start}) b WINDOW w AS (ORDER BY score DESC)),
    {name}p AS (SELECT score AS threshold, false AS strict, target, decoy FROM {name}c WHERE t > 0 UNION ALL SELECT score, true, target - t, decoy - d FROM {name}c WHERE d > 0),
    {name}f AS (SELECT *, 1e2 * decoy / target AS fdr FROM {name}p WHERE target > 0),
    {name}k AS (SELECT * FROM (SELECT *, max(fdr) OVER (ORDER BY threshold DESC, strict DESC ROWS UNBOUNDED PRECEDING) AS worst FROM {name}f) WHERE worst <= 9e1),
    {name}n AS (SELECT arg_min(fdr, (abs(fdr - 33e0), fdr)) AS nearest FROM {name}k),
    {name} AS (SELECT threshold, strict, CAST(target AS BIGINT) AS target, CAST(decoy AS BIGINT) AS decoy, fdr FROM {name}k, {name}n WHERE abs(fdr - nearest) <= nearest * 5e-2
      ORDER BY target DESC, decoy, threshold DESC, strict DESC LIMIT 1)"""


@query(
    "q85_sequential_set_rules", "psm",
    f", s AS ({_SET})" + _rule_sql("m", "(SELECT * FROM s WHERE n_items > 1)", "SELECT 0 AS t0, 0 AS d0")
    + """, j AS (SELECT s.*, n_items > 1 AND coalesce(score > threshold OR (score = threshold AND NOT strict), false) AS ok FROM s LEFT JOIN m ON true)"""
    + _rule_sql("r", "(SELECT * FROM j WHERE NOT ok)", "SELECT count(*) FILTER (NOT is_decoy) AS t0, count(*) FILTER (is_decoy) AS d0 FROM j WHERE ok")
    + "SELECT 'several' AS rule, * FROM m UNION ALL SELECT 'remaining', * FROM r",
)
def q85(v: Views):
    return validators.sequential_set_rules(_sets(v), 33.0, "plain", 90.0)


@query(
    "q86_set_validators", "psm",
    f", s AS ({_SET})" + _ADJUSTED.format(k="", p="") + """, b AS (SELECT 'basic' AS validator, is_decoy, score >= 5e1 AND n_items >= 2 AS ok FROM s
    UNION ALL SELECT 'bh', is_decoy, adjusted <= 1e-6 FROM s JOIN a USING (score) UNION ALL SELECT 'two_rules', is_decoy, score >= CASE WHEN n_items = 1 THEN 9e1 ELSE 4e1 END FROM s),
    n AS (SELECT validator, count(*) FILTER (ok AND NOT is_decoy) AS target, count(*) FILTER (ok AND is_decoy) AS decoy FROM b GROUP BY 1)
    SELECT *, 2e2 * decoy / (target + decoy) AS fdr FROM n""",
)
def q86(v: Views):
    how = {"basic": [F.col("score") >= 50, F.col("n_items") >= 2], "bh": 1e-6, "two_rules": (90.0, 40.0)}
    done = [validators.outcome(validators.SET_VALIDATORS[k](_sets(v), x)).select(F.lit(k).alias("validator"), "*") for k, x in how.items()]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query(
    "q87_propagated_validation", "edge psm",
    """, leaf AS (SELECT o_orderkey AS query_id, concat('C', CAST(o_custkey AS STRING)) AS leaf FROM orders), p AS (SELECT psm.*, leaf FROM psm JOIN leaf USING (query_id)),
    t AS (SELECT n.parent_id AS node, c.child_id AS leaf FROM edge n JOIN edge c ON c.parent_id = n.child_id),
    g AS (SELECT node, score AS threshold, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM p JOIN t USING (leaf) GROUP BY 1, 2),
    c AS (SELECT node, threshold, CAST(sum(t) OVER w AS BIGINT) AS target, CAST(sum(d) OVER w AS BIGINT) AS decoy FROM g WINDOW w AS (PARTITION BY node ORDER BY threshold DESC)),
    roc AS (SELECT *, 2e2 * decoy / (target + decoy) AS fdr FROM c),
    b AS (SELECT node, threshold FROM roc QUALIFY row_number() OVER (PARTITION BY node ORDER BY CASE WHEN fdr >= 95e-2 * 4e1 AND fdr < 4e1 THEN 0 WHEN fdr < 4e1 THEN 1 ELSE 2 END,
      CASE WHEN fdr >= 95e-2 * 4e1 AND fdr < 4e1 THEN -target ELSE abs(fdr - 4e1) END, threshold) = 1)
    SELECT leaf, count(*) AS n, count(*) FILTER (score >= threshold) AS n_valid FROM p LEFT JOIN t USING (leaf) LEFT JOIN b USING (node) GROUP BY 1""",
)
def q87(v: Views):
    from ..operators import hierarchy
    from .pipelines import validate

    leaf = v.table("orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("leaf"))
    psms = v.psm.select("query_id", "score", "is_decoy").join(leaf, "query_id")
    regions = hierarchy.closure(v.edge).filter(F.col("ancestor").startswith("R")).select(F.col("ancestor").alias("node"), F.col("descendant").alias("leaf"))
    found = validate(psms.join(regions, "leaf"), 40.0, "node").select("node", "threshold")
    out = validators.propagated(psms, found, v.edge)
    return out.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("is_validated").alias("n_valid"))


_STEPS = [10.0 * i for i in range(1, 11)]


@query(
    "q88_match_rules_at_fdr", "psm",
    f""", s AS (SELECT query_id, is_decoy, list_reverse_sort(list(score)) AS l FROM psm GROUP BY 1, 2), st AS (SELECT unnest({_STEPS}) AS x),
    n AS (SELECT a.x AS one_at, b.x AS many_at, count(*) FILTER (NOT is_decoy) AS target, count(*) FILTER (is_decoy) AS decoy
      FROM st a JOIN st b ON b.x <= a.x JOIN s ON l[1] >= a.x OR l[2] >= b.x GROUP BY 1, 2)
    SELECT CAST(one_at AS DOUBLE) AS one_at, CAST(many_at AS DOUBLE) AS many_at, target, decoy, 2e2 * decoy / (target + decoy) AS fdr FROM n WHERE 2e2 * decoy / (target + decoy) <= 655e-1 ORDER BY target DESC, fdr, one_at, many_at LIMIT 1""",
)
def q88(v: Views):
    return validators.match_rules(v.psm, "query_id", 65.5, _STEPS)


_MASCOT = """SELECT psm_id, score, 2e1 + rank AS lowest_threshold, rank * 1e2 AS candidates, CASE WHEN rank = 3 THEN 0 ELSE 15e0 + rank END AS homology, CASE WHEN rank = 1 THEN NULL ELSE rank - 3 END AS isotope_offset,
    concat('{"evalue":', CAST(rank AS STRING), '}') AS properties FROM psm"""


@query(
    "q89_mascot_filters", "psm",
    f""", m AS ({_MASCOT})
    SELECT psm_id, CAST(json_extract(properties, '$.evalue') AS DOUBLE) <= 4 AS f4, 5e-2 * pow(1e1, (lowest_threshold - score) / 1e1) <= 1e-2 AS f5,
      score >= 1e1 * log10(candidates * (5e-2 / 1e-2)) AS f6, score >= coalesce(nullif(homology, 0) - 1e1 * log10(1e-2 / 5e-2), 1e1 * log10(candidates * (5e-2 / 1e-2))) AS f7,
      score >= lowest_threshold - 1e1 * log10(1e-2 / 5e-2) AS f8, coalesce(isotope_offset, 0) <= 1 AS f12, score > 5e1 AS f31 FROM m""",
)
def q89(v: Views):
    r = F.col("rank")
    m = v.psm.select(
        "psm_id", "score", (2e1 + r).alias("lowest_threshold"), (r * 1e2).alias("candidates"), F.when(r == 3, 0.0).otherwise(15e0 + r).alias("homology"),
        F.when(r != 1, r - 3).alias("isotope_offset"), F.concat(F.lit('{"evalue":'), r.cast("string"), F.lit("}")).alias("properties"),
    )
    steps = {
        "f4": lambda d, **k: filters.evalue_from_properties(d, 4.0, **k),
        "f5": lambda d, **k: filters.adjusted_evalue_filter(d, 0.01, **k),
        "f6": lambda d, **k: filters.identity_p_value(d, 0.01, **k),
        "f7": lambda d, **k: filters.homology_p_value(d, 0.01, **k),
        "f8": lambda d, **k: filters.flag(d, F.col("score") >= C.moved_threshold(F.col("lowest_threshold"), 0.05, 0.01), **k),
        "f12": lambda d, **k: filters.isotope_offset(d, 1, **k),
        "f31": lambda d, **k: filters.precursor_fraction(d, 50.0, column="score", **k),
    }
    for name, step in steps.items():
        m = step(m, status=name)
    return m.select("psm_id", *steps)


_PEPTIDES = "SELECT p_partkey AS peptide_id, upper(replace(p_name, ' ', '')) AS sequence, p_retailprice AS abundance, p_brand AS ptm_string FROM part"


def _peptides(v: Views) -> DataFrame:
    return v.table("part").select(
        F.col("p_partkey").alias("peptide_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"), F.col("p_retailprice").alias("abundance"), F.col("p_brand").alias("ptm_string")
    )


@query(
    "q90_missed_cleavage_modes", "",
    f"""WITH p AS ({_PEPTIDES}), c AS (SELECT *, regexp_extract_all(sequence, '(.*?[RK]|.+$)', 1) AS pieces FROM p),
    f AS (SELECT DISTINCT unnest(pieces) AS sequence, sequence AS parent FROM c WHERE len(pieces) > 1),
    mem AS (SELECT f.parent, p.sequence, p.abundance FROM f JOIN p USING (sequence) UNION ALL SELECT sequence, sequence, abundance FROM c WHERE len(pieces) > 1),
    best AS (SELECT parent, arg_max(sequence, (abundance, sequence)) AS best FROM mem GROUP BY 1),
    lose AS (SELECT DISTINCT sequence FROM mem JOIN best USING (parent) WHERE sequence <> best)
    SELECT peptide_id, len(pieces) <= 1 AS forms, len(pieces) <= 1 AND sequence NOT IN (SELECT sequence FROM f) AS all_forms, sequence NOT IN (SELECT sequence FROM lose) AS keep_best FROM c""",
)
def q90(v: Views):
    p = _peptides(v)
    by = {m: filters.discard_missed_cleavage(p, m).select("peptide_id", F.col("is_validated").alias(n)) for m, n in (("forms", "forms"), ("all", "all_forms"), ("keep", "keep_best"))}
    return by["forms"].join(by["all"], "peptide_id").join(by["keep"], "peptide_id")


@query(
    "q91_modified_modes", "",
    f"""WITH p AS (SELECT *, substr(sequence, 1, 3) AS s3 FROM ({_PEPTIDES})), h AS (SELECT DISTINCT s3 FROM p WHERE regexp_matches(ptm_string, '[13]$')),
    mem AS (SELECT s3, arg_max(peptide_id, (abundance, -peptide_id)) AS best FROM p WHERE s3 IN (SELECT s3 FROM h) GROUP BY 1)
    SELECT peptide_id, NOT regexp_matches(ptm_string, '[13]$') AS forms, s3 NOT IN (SELECT s3 FROM h) AS all_forms, coalesce(peptide_id = best, true) AS keep_best FROM p LEFT JOIN mem USING (s3)""",
)
def q91(v: Views):
    p = _peptides(v).withColumn("sequence", F.substring("sequence", 1, 3))
    by = {m: filters.discard_modified(p, "[13]$", m).select("peptide_id", F.col("is_validated").alias(n)) for m, n in (("forms", "forms"), ("all", "all_forms"), ("keep", "keep_best"))}
    return by["forms"].join(by["all"], "peptide_id").join(by["keep"], "peptide_id")


@query(
    "q92_shared_ions", "psm",
    """, n AS (SELECT peptide_id, charge, count(DISTINCT protein_id) AS n FROM psm GROUP BY 1, 2)
    SELECT psm_id, n = 1 AS is_validated FROM psm JOIN n USING (peptide_id, charge)""",
)
def q92(v: Views):
    keyed = v.psm.select("psm_id", F.concat_ws(":", "peptide_id", "charge").alias("ion"), "protein_id")
    return filters.shared(keyed, "ion", "protein_id").select("psm_id", "is_validated")


@query(
    "q93_validated_only", "psm",
    """, v AS (SELECT * FROM psm WHERE score >= 8e1), l AS (SELECT DISTINCT protein_id, peptide_id FROM psm WHERE peptide_id IN (SELECT peptide_id FROM v))
    SELECT (SELECT count(*) FROM v) AS psms, (SELECT count(*) FROM supplier WHERE s_suppkey IN (SELECT protein_id FROM l)) AS proteins, (SELECT count(*) FROM l) AS links""",
)
def q93(v: Views):
    proteins = v.table("supplier").select(F.col("s_suppkey").alias("protein_id"))
    links = v.psm.select("protein_id", "peptide_id").distinct()
    parts = merge.validated_only(filters.score(v.psm, 80.0), proteins, links)
    counted = [p.agg(F.count("*").alias(n)) for p, n in zip(parts, ("psms", "proteins", "links"), strict=True)]
    return counted[0].crossJoin(counted[1]).crossJoin(counted[2])  # one row each


@query("q94_intensity_level", "feature", "SELECT feature_id, CASE WHEN intensity > 6e1 THEN 2 ELSE 1 END AS above, CASE WHEN intensity < 2e1 THEN 2 ELSE 1 END AS below FROM feature")
def q94(v: Views):
    out = filters.intensity_level(v.feature, F.lit(60.0)).withColumnRenamed("selection_level", "above")
    return filters.intensity_level(out, F.lit(20.0), above=False).select("feature_id", "above", F.col("selection_level").alias("below"))


@query(
    "q95_interval_join", "feature",
    """, i AS (SELECT feature_id AS peakel_id, map_id, t AS first_t, t + 18e2 AS last_t FROM feature WHERE feature_id % 5 = 0)
    SELECT feature_id, peakel_id FROM feature JOIN i ON i.map_id = feature.map_id AND t BETWEEN first_t AND last_t""",
)
def q95(v: Views):
    peakels = v.feature.filter("feature_id % 5 = 0").select(F.col("feature_id").alias("peakel_id"), "map_id", F.col("t").alias("first_t"), (F.col("t") + 18e2).alias("last_t"))
    return rangejoin.inside_intervals(v.feature.select("feature_id", "map_id", "t"), peakels, ["map_id"], "t", "first_t", "last_t", 3600.0).select("feature_id", "peakel_id")


@query(
    "q96_set_rules", "psm",
    f", s AS ({_SET}) SELECT query_id, is_decoy, score >= 6e1 AS over, score >= CASE WHEN n_items = 1 THEN 9e1 ELSE 4e1 END AS is_validated FROM s",
)
def q96(v: Views):
    return fdr.set_rules(filters.score(_sets(v), 60.0, status="over"), 90.0, 40.0).select("query_id", "is_decoy", "over", "is_validated")


_OUTLIERS = """, z{n} AS (SELECT *, dt - lag(dt) OVER (PARTITION BY k ORDER BY t, dt) AS step FROM z{p}), y{n} AS (SELECT k, quantile_cont(step, 0.25) AS q1, quantile_cont(step, 0.75) AS q3 FROM z{n} GROUP BY 1)
    , x{n} AS (SELECT k, t, dt FROM z{n} JOIN y{n} USING (k) WHERE step IS NULL OR step BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1))"""


@query(
    "q97_landmark_outliers", "feature",
    """, z0 AS (SELECT map_id AS k, t, CASE WHEN feature_id % 97 = 0 THEN intensity * 50 ELSE intensity END AS dt FROM feature)"""
    + "".join(_OUTLIERS.format(n=i, p="0").replace("FROM z0", f"FROM {'z0' if i == 1 else f'x{i - 1}'}") for i in (1, 2, 3))
    + "SELECT k, count(*) AS n, max(dt) AS largest FROM x3 GROUP BY 1",
)
def q97(v: Views):
    marks = v.feature.select(F.col("map_id").alias("k"), "t", F.when(F.col("feature_id") % 97 == 0, F.col("intensity") * 50).otherwise(F.col("intensity")).alias("dt"))
    return alignment.without_outliers(marks, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.max("dt").alias("largest"))


@query(
    "q98_best_valid_psm_per_set", "psm",
    _THRESHOLDS + """SELECT protein_id, query_id, psm_id, score FROM psm JOIN b USING (rs_id) WHERE score >= threshold QUALIFY row_number() OVER (PARTITION BY protein_id, query_id ORDER BY score DESC, psm_id) = 1""",
)
def q98(v: Views):
    valid = validated(v.psm.select("protein_id", "query_id", "psm_id", "score", "is_decoy", "rs_id"), 66.0).filter("is_validated")
    return ranking.best_per(valid.select("protein_id", "query_id", "psm_id", "score"), ["protein_id", "query_id"], ["score"]).select("protein_id", "query_id", "psm_id", "score")


_INFER = """, ok AS (SELECT psm.* FROM psm JOIN b USING (rs_id) WHERE score >= threshold AND NOT is_decoy),
    best AS (SELECT {h} AS protein_id, peptide_id, max(score) AS score, count(*) AS n FROM ok GROUP BY 1, 2), occurrence AS (SELECT protein_id, peptide_id FROM best)"""
_INFERRED = """SELECT g.set_id, CAST(len(items) AS BIGINT) AS n_items, CAST(len(members) AS BIGINT) AS n_members, (SELECT count(*) FROM k WHERE k.set_id = g.set_id AND k.n = 1) AS n_specific,
    CASE WHEN g.set_id IN (SELECT subset_id FROM sub) THEN 'subset' WHEN g.set_id IN (SELECT set_id FROM sm) THEN 'subsumable' ELSE 'main' END AS status, set_score {more} FROM g
    JOIN (SELECT protein_id AS set_id, CAST(sum(CAST(score AS DECIMAL(18,5))) AS DOUBLE) AS set_score, CAST(sum(n) AS BIGINT) AS spectral_count FROM best GROUP BY 1) USING (set_id)"""


@query("p04_validated_sets", "psm", _THRESHOLDS + _INFER.format(h="query_id") + _SETS + _INFERRED.format(more=""))
def p04(v: Views):
    return summarised(validated(v.psm, 66.0))


def merged_summary(psms: DataFrame, expected_fdr: float, holder: str) -> DataFrame:
    """One summary of many validated ones: their valid matches are merged by peptide, then sets are inferred and scored anew.

    set_id, n_items, n_members, n_specific, status, set_score and the spectral count of each set's items.
    """
    merged = merge.aggregate(validated(psms, expected_fdr).filter("is_validated AND NOT is_decoy"), [holder, "peptide_id"]).drop("children")
    best = merged.select(holder, "peptide_id", "score", "spectral_count", F.lit(True).alias("is_validated"), F.lit(False).alias("is_decoy"))
    counts = best.groupBy(F.col(holder).alias("set_id")).agg(F.sum("spectral_count").alias("spectral_count"))
    return summarised(best, holder).join(counts, "set_id")


@query("p05_merged_summaries", "psm", _THRESHOLDS + _INFER.format(h="protein_id") + _SETS + _INFERRED.format(more=", spectral_count"))
def p05(v: Views):
    return merged_summary(v.psm, 66.0, "protein_id")

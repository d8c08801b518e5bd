"""Catalogue: the abundance matrix, group statistics, assignments (q46 to q54, q60 to q71)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import normal_two_sided, rounded
from ..operators import fdr, hierarchy, inference, quant
from .registry import query
from .views import Views

_YEARS = list(range(1995, 2002))


@query(
    "q46_abundance_normalize", "quant",
    """, f AS (SELECT q.qc_id, median(r.raw_abundance / q.raw_abundance) AS factor FROM quant q JOIN quant r ON r.entity_id = q.entity_id AND r.row_id = q.row_id AND r.qc_id = 1995 GROUP BY 1)
    SELECT entity_id, row_id, q.qc_id, floor(raw_abundance * coalesce(factor, 1e0) * 1e3 + 5e-1) / 1e3 AS abundance FROM quant q LEFT JOIN f ON f.qc_id = q.qc_id""",
)
def q46(v: Views):
    out = quant.normalise(v.quant, ["entity_id", "row_id"], "qc_id", "raw_abundance", 1995)
    return out.select("entity_id", "row_id", "qc_id", rounded(F.col("abundance"), 3).alias("abundance"))


@query(
    "q47_impute_percentile", "quant",
    """, n AS (SELECT qc_id, quantile_cont(raw_abundance, 0.01) AS noise FROM quant GROUP BY 1),
    g AS (SELECT entity_id, row_id, CAST(unnest(range(1995, 2002)) AS INT) AS qc_id FROM (SELECT DISTINCT entity_id, row_id FROM quant))
    SELECT g.entity_id, g.row_id, g.qc_id, floor(coalesce(raw_abundance, noise) * 1e3 + 5e-1) / 1e3 AS raw_abundance, raw_abundance IS NULL AS imputed
    FROM g LEFT JOIN quant q ON q.entity_id = g.entity_id AND q.row_id = g.row_id AND q.qc_id = g.qc_id LEFT JOIN n ON n.qc_id = g.qc_id""",
)
def q47(v: Views):
    out = quant.impute_percentile(v.quant, ["entity_id", "row_id"], "qc_id", "raw_abundance", _YEARS)
    return out.withColumn("raw_abundance", rounded(F.col("raw_abundance"), 3))


def _summary(method: str):
    def build(v: Views):
        out = quant.summarise(v.quant, "entity_id", "row_id", "qc_id", "raw_abundance", method)
        return out.withColumn("raw_abundance", rounded(F.col("raw_abundance"), 3))

    return build


_X = "CAST(sum(CAST(raw_abundance AS DECIMAL(28,6))) AS DOUBLE)"
_BY = "SELECT entity_id, qc_id, floor({} * 1e3 + 5e-1) / 1e3 AS raw_abundance FROM {} GROUP BY 1, 2"
_RANKED = """, w AS (SELECT entity_id, row_id FROM (SELECT entity_id, row_id, {} AS w FROM quant GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY w DESC, row_id) <= {}) """
query("q48_summarize_sum", "quant", _BY.format(_X, "quant"))(_summary("sum"))
query("q48_summarize_mean", "quant", _BY.format(_X + " / count(raw_abundance)", "quant"))(_summary("mean"))
query("q48_summarize_median", "quant", _BY.format("median(raw_abundance)", "quant"))(_summary("median"))
query("q48_summarize_top3", "quant", _RANKED.format("median(raw_abundance)", 3) + _BY.format(_X + " / count(raw_abundance)", "quant JOIN w USING (entity_id, row_id)"))(_summary("mean_top3"))
query("q48_summarize_maxsum", "quant", _RANKED.format(_X, 1) + _BY.format(_X + " / count(raw_abundance)", "quant JOIN w USING (entity_id, row_id)"))(_summary("max_sum"))


_PROFILE = (
    _RANKED.format("median(raw_abundance)", 3)
    + f""", s AS (SELECT entity_id, qc_id, dense_rank() OVER (PARTITION BY entity_id ORDER BY qc_id) AS i FROM (SELECT DISTINCT entity_id, qc_id FROM quant)),
    p AS (SELECT q.entity_id, q.row_id, s.i, q.raw_abundance AS x FROM quant q JOIN s USING (entity_id, qc_id)),
    r AS (SELECT a.entity_id, a.i, median(nullif(CASE WHEN a.x / b.x >= 1 THEN a.x / b.x - 1 ELSE 1 - 1 / (a.x / b.x) END, 0e0)) AS m FROM p a
      JOIN p b ON a.entity_id = b.entity_id AND a.row_id = b.row_id AND a.i = b.i + 1 GROUP BY 1, 2),
    l AS (SELECT s.entity_id, s.qc_id, exp(sum(ln(coalesce(CASE WHEN m >= 0 THEN m + 1 ELSE 1 / (1 - m) END, 1e0))) OVER (PARTITION BY s.entity_id ORDER BY s.i)) AS pr
      FROM s LEFT JOIN r ON r.entity_id = s.entity_id AND r.i = s.i),
    t AS (SELECT entity_id, qc_id, {_X} / count(raw_abundance) AS top FROM quant JOIN w USING (entity_id, row_id) GROUP BY 1, 2),
    k AS (SELECT l.entity_id, arg_max(top / pr, (top, -l.qc_id)) AS scale FROM l JOIN t ON t.entity_id = l.entity_id AND t.qc_id = l.qc_id GROUP BY 1)
    SELECT l.entity_id, l.qc_id, floor(pr * scale * 1e2 + 5e-1) / 1e2 AS raw_abundance FROM l JOIN k ON k.entity_id = l.entity_id"""
)


@query("q49_median_profile", "quant", _PROFILE)
def q49(v: Views):
    out = quant.median_profile(v.quant, "entity_id", "row_id", "qc_id", "raw_abundance")
    return out.withColumn("raw_abundance", rounded(F.col("raw_abundance"), 2))


_LEGACY = "CASE WHEN {p} * (n + 1) < 1 THEN a[1] WHEN {p} * (n + 1) >= n THEN a[n] ELSE a[CAST(floor({p} * (n + 1)) AS BIGINT)] + ({p} * (n + 1) - floor({p} * (n + 1))) * (a[CAST(floor({p} * (n + 1)) AS BIGINT) + 1] - a[CAST(floor({p} * (n + 1)) AS BIGINT)]) END"


@query(
    "q50_ext_stats_fences", "quant",
    f""", s AS (SELECT entity_id, list_sort(list(raw_abundance)) AS a, count(*) AS n, {_X} / count(*) AS mean, median(raw_abundance) AS median FROM quant GROUP BY 1),
    q AS (SELECT *, {_LEGACY.format(p="25e-2")} AS q1, {_LEGACY.format(p="75e-2")} AS q3 FROM s)
    SELECT entity_id, n, floor(mean * 1e2 + 5e-1) / 1e2 AS mean, floor(median * 1e3 + 5e-1) / 1e3 AS median, floor(q1 * 1e3 + 5e-1) / 1e3 AS q1, floor(q3 * 1e3 + 5e-1) / 1e3 AS q3,
      floor((q1 - 15e-1 * (q3 - q1)) * 1e3 + 5e-1) / 1e3 AS inner_low, floor((q3 + 3e0 * (q3 - q1)) * 1e3 + 5e-1) / 1e3 AS outer_high FROM q""",
)
def q50(v: Views):
    s = quant.extended_stats(v.quant, ["entity_id"], "raw_abundance")
    return s.select("entity_id", "n", rounded(F.col("mean"), 2).alias("mean"), *(rounded(F.col(c), 3).alias(c) for c in ("median", "q1", "q3", "inner_low", "outer_high")))


@query(
    "q51_error_bins", "quant",
    """, e AS (SELECT entity_id, median(raw_abundance) AS m, max(raw_abundance) - min(raw_abundance) AS s FROM quant GROUP BY 1 HAVING count(*) > 1),
    l AS (SELECT log10(m) AS x, s FROM e), b AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
    SELECT CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS n, floor(avg(x) * 1e6 + 5e-1) / 1e6 AS log_abundance, floor(median(s) * 1e3 + 5e-1) / 1e3 AS spread
    FROM l, b GROUP BY 1""",
)
def q51(v: Views):
    each = v.quant.groupBy("entity_id").agg(F.median("raw_abundance").alias("m"), (F.max("raw_abundance") - F.min("raw_abundance")).alias("s"), F.count("*").alias("n")).filter("n > 1")
    return quant.error_bins(each, "m", "s", 10).select("bin", "n", rounded(F.col("log_abundance"), 6).alias("log_abundance"), rounded(F.col("spread"), 3).alias("spread"))


_GROUPED = """, r AS (SELECT entity_id, median(CASE WHEN group_number = 2 THEN raw_abundance END) / median(CASE WHEN group_number = 1 THEN raw_abundance END) AS ratio
      FROM quant JOIN channel USING (qc_id) GROUP BY 1)
    """


def _grouped(v: Views):
    return v.quant.join(v.channel, "qc_id")


@query(
    "q52_group_ratio_state", "quant channel",
    _GROUPED + "SELECT entity_id, floor(ratio * 1e9 + 5e-1) / 1e9 AS ratio, CASE WHEN ratio >= 12e-1 THEN 1 WHEN ratio <= 1 / 12e-1 THEN -1 WHEN ratio IS NOT NULL THEN 0 END AS state FROM r",
)
def q52(v: Views):
    return quant.group_ratio(_grouped(v), ["entity_id"], "group_number", "raw_abundance", 2, 1, over=1.2).withColumn("ratio", rounded(F.col("ratio"), 9))


@query(
    "q53_razor_assignment", "psm",
    """, i AS (SELECT DISTINCT query_id AS set_id, peptide_id AS item FROM psm), c AS (SELECT item, count(*) AS n FROM i GROUP BY 1),
    s AS (SELECT set_id, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS k FROM i JOIN c USING (item) GROUP BY 1), b AS (SELECT query_id AS set_id, max(score) AS score FROM psm GROUP BY 1)
    SELECT item, set_id FROM i JOIN s USING (set_id) JOIN b USING (set_id) QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC, score DESC, set_id) = 1""",
)
def q53(v: Views):
    scores = v.psm.groupBy(F.col("query_id").alias("set_id")).agg(F.max("score").alias("score"))
    return inference.razor(v.psm.select(F.col("query_id").alias("set_id"), F.col("peptide_id").alias("item")), scores)


@query(
    "q54_best_ion", "quant",
    """, r AS (SELECT entity_id, row_id, count(*) AS a, sum(psm_count) AS b, sum(CAST(raw_abundance AS DECIMAL(28,6))) AS c FROM quant GROUP BY 1, 2)
    SELECT entity_id, row_id FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY a DESC, b DESC, c DESC, row_id) = 1""",
)
def q54(v: Views):
    return quant.best_row(v.quant, "entity_id", "row_id", "raw_abundance", "psm_count")


@query("q60_z_test")
def q60(v: Views):
    z = quant.ratio_z(quant.group_ratio(_grouped(v), ["entity_id"], "group_number", "raw_abundance", 2, 1))
    return z.select("entity_id", "ratio", "z", normal_two_sided(F.col("z")).alias("p_value"), quant.cauchy_p(F.col("z")).alias("cauchy_p"))


@query("q61_t_test")
def q61(v: Views):
    each = v.quant.groupBy("entity_id").agg(F.median("raw_abundance").alias("m"), F.stddev_samp("raw_abundance").alias("s"))
    return quant.group_t_test(_grouped(v), ["entity_id"], "group_number", "raw_abundance", 2, 1, quant.error_bins(each, "m", "s", 10))


@query("q64_gaussian_impute")
def q64(v: Views):
    return quant.impute_gaussian(v.quant, ["entity_id", "row_id"], "qc_id", "raw_abundance", _YEARS)


@query("q65_median_ratio_fit")
def q65(v: Views):
    return quant.fitted_ratios(v.quant, "entity_id", "row_id", "qc_id", "raw_abundance")


@query(
    "q67_fraction_sum", "quant",
    f"SELECT entity_id, qc_id, {_X} AS raw_abundance FROM quant GROUP BY 1, 2",
)
def q67(v: Views):
    return quant.merged_fractions(v.quant, ["entity_id", "qc_id"], "raw_abundance", "sum")


_IMPURITY = np.array([[0.95, 0.05, 0.0], [0.03, 0.94, 0.03], [0.0, 0.04, 0.96]])
#: The system solved by Cramer's rule, for the SQL: cofactors of the transposed matrix over its determinant.
_SOLVED = [[float(np.linalg.det(np.delete(np.delete(_IMPURITY.T, j, 0), i, 1))) * (-1) ** (i + j) / float(np.linalg.det(_IMPURITY.T)) for j in range(3)] for i in range(3)]
_CORRECTED = " ".join(f"WHEN {i + 1} THEN " + " + ".join(f"({k!r}) * coalesce(x{j + 1}, 0)" for j, k in enumerate(row)) for i, row in enumerate(_SOLVED))


@query(
    "q68_purity_correction", "psm",
    f""", r AS (SELECT query_id, charge, CAST(sum(CAST(score AS DECIMAL(18,5))) AS DOUBLE) AS value FROM psm GROUP BY 1, 2),
    w AS (SELECT query_id, max(value) FILTER (charge = 1) AS x1, max(value) FILTER (charge = 2) AS x2, max(value) FILTER (charge = 3) AS x3 FROM r GROUP BY 1),
    g AS (SELECT *, CAST(unnest([1, 2, 3]) AS INT) AS charge FROM w), o AS (SELECT *, CASE charge WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS own, CASE charge {_CORRECTED} END AS y FROM g)
    SELECT query_id, charge, CASE WHEN own IS NOT NULL THEN floor(greatest(y, 0) * 1e6 + 4321e-4) / 1e6 END AS value FROM o""",
)
def q68(v: Views):
    reporter = v.psm.groupBy("query_id", "charge").agg(F.sum(F.col("score").cast("decimal(18,5)")).cast("double").alias("value"))
    out = quant.corrected_purity(reporter, ["query_id"], "charge", "value", _IMPURITY)
    return out.withColumn("value", F.floor(F.col("value") * 1e6 + 4321e-4) / 1e6)


@query(
    "q69_reporter_share", "quant",
    """, t AS (SELECT entity_id, qc_id, CAST(sum(CAST(raw_abundance AS DECIMAL(28,6))) AS DOUBLE) AS a FROM quant GROUP BY 1, 2)
    SELECT q.entity_id, q.row_id, q.qc_id, floor(raw_abundance / a * psm_count * 1e9 + 5e-1) / 1e9 AS scaled FROM quant q JOIN t ON t.entity_id = q.entity_id AND t.qc_id = q.qc_id""",
)
def q69(v: Views):
    out = quant.reporter_share(v.quant, ["entity_id", "qc_id"], "raw_abundance", "psm_count")
    return out.select("entity_id", "row_id", "qc_id", rounded(F.col("scaled"), 9).alias("scaled"))


@query(
    "q70_two_rule_validation", "psm",
    """SELECT query_id, count(*) FILTER (score >= 9e1) AS n_one, count(*) FILTER (score >= 5e1) AS n_many,
      count(*) FILTER (score >= 9e1) >= 1 OR count(*) FILTER (score >= 5e1) >= 2 AS is_validated FROM psm GROUP BY 1""",
)
def q70(v: Views):
    return fdr.two_rules(v.psm, "query_id", 90.0, 50.0)


@query(
    "q71_nearest_marked_ancestor", "edge",
    """, m AS (SELECT DISTINCT parent_id AS node, length(parent_id) AS mark FROM edge WHERE substr(parent_id, 1, 1) = 'R' OR parent_id IN ('N3', 'N7')),
    t(ancestor, descendant, depth) AS (SELECT parent_id, child_id, 1 FROM edge UNION ALL SELECT t.ancestor, e.child_id, t.depth + 1 FROM t JOIN edge e ON e.parent_id = t.descendant),
    a AS (SELECT node AS descendant, node AS holder, mark, 0 AS depth FROM m UNION ALL SELECT descendant, node, mark, depth FROM t JOIN m ON m.node = t.ancestor)
    SELECT descendant AS node, holder, mark FROM a QUALIFY row_number() OVER (PARTITION BY descendant ORDER BY depth, holder) = 1""",
    recursive=True,
)
def q71(v: Views):
    parents = v.edge.select(F.col("parent_id").alias("node")).distinct()
    marks = parents.filter(F.col("node").startswith("R") | F.col("node").isin("N3", "N7")).withColumn("mark", F.length("node"))
    return hierarchy.nearest_marked(hierarchy.closure(v.edge), marks)

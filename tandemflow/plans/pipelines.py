"""Whole analyses as one plan each: validate, merge a tree, quantify; and their catalogue entries (p01 to p03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import fdr, hierarchy, inference, merge, quant, scoring
from ..operators.storage import materialised
from .registry import query
from .views import Views


def validate(psms: DataFrame, expected_fdr: float, key: str = "rs_id") -> DataFrame:
    """Validates every result set at its own threshold: (key, threshold, target, decoy, fdr).

    All result sets run in one plan, partitioned by their key.
    """
    curve = fdr.roc(psms.select(key, F.col("score").alias("threshold"), "is_decoy"), [key])
    return fdr.at_expected(curve.select(key, "threshold", "target", "decoy", "fdr"), [key], expected_fdr)


def validated(psms: DataFrame, expected_fdr: float, key: str = "rs_id") -> DataFrame:
    """``psms`` with is_validated by its result set's threshold."""
    thresholds = validate(psms, expected_fdr, key).select(key, "threshold")
    return psms.join(thresholds, key).withColumn("is_validated", F.col("score") >= F.col("threshold")).drop("threshold")


def summarised(psms: DataFrame, holder: str = "query_id") -> DataFrame:
    """Sets of valid target matches with their score, inferred parsimoniously."""
    valid = psms.filter(F.col("is_validated") & ~F.col("is_decoy"))
    best = valid.groupBy(F.col(holder).alias("set_id"), "peptide_id").agg(F.max("score").alias("score"))
    sets = inference.infer(best.select("set_id", "peptide_id"), "set_id", "peptide_id")
    return sets.join(scoring.standard(best, "set_id").select("set_id", "set_score"), "set_id")


def merged_tree(psms: DataFrame, edges: DataFrame, leaf: str) -> DataFrame:
    """For every node of a tree, one match per peptide over all result sets below it.

    Leaves below the same nodes are one class: matches are merged by class and peptide first, so what is joined to the nodes is
    one row for each.
    """
    above = hierarchy.closure(edges).groupBy(F.col("descendant").alias(leaf)).agg(F.sort_array(F.collect_list("ancestor")).alias("_nodes"))
    above = materialised(above, "above")
    classes = materialised(above.groupBy("_nodes").agg(F.min(leaf).alias("_class")), "classes")
    placed = psms.join(above.join(classes, "_nodes").select(leaf, "_class"), leaf)
    of_class = merge.aggregate(placed, ["_class", "peptide_id"], child="_class").drop("children")
    below = of_class.join(classes.select("_class", F.explode("_nodes").alias("node")), "_class")
    return merge.aggregated_again(below, ["node", "peptide_id"])


def profiles(df: DataFrame, groups: DataFrame, first: int, over: float = 1.5) -> DataFrame:
    """Quantification post-processing: normalise channels, summarise entities, compare groups."""
    level = quant.normalise(df, ["entity_id", "row_id"], "qc_id", "raw_abundance", first)
    summed = quant.summarise(level, "entity_id", "row_id", "qc_id", "abundance", "median")
    return quant.group_ratio(summed.join(groups, "qc_id"), ["entity_id"], "group_number", "abundance", 2, 1, over)


def stepped_thresholds(psms: DataFrame, steps: int, key: str = "rs_id") -> DataFrame:
    """(key, step, threshold, target, decoy, fdr): the ROC curve read at equal steps of each key's score range."""
    ends = psms.groupBy(key).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    at = F.least(F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * steps), F.lit(steps - 1)).cast("int")
    counted = psms.join(ends, key).withColumn("step", at).groupBy(key, "step").agg(
        F.min("score").alias("threshold"), F.count_if(~F.col("is_decoy")).alias("t"), F.count_if("is_decoy").alias("d")
    )
    w = Window.partitionBy(key).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    curve = counted.select(key, "step", "threshold", F.sum("t").over(w).alias("target"), F.sum("d").over(w).alias("decoy"))
    return curve.withColumn("fdr", fdr.estimate(F.col("target"), F.col("decoy")))


_VALIDATE = """, g AS (SELECT rs_id, score AS threshold, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM psm GROUP BY 1, 2),
    c AS (SELECT rs_id, threshold, CAST(sum(t) OVER w AS BIGINT) AS target, CAST(sum(d) OVER w AS BIGINT) AS decoy FROM g WINDOW w AS (PARTITION BY rs_id ORDER BY threshold DESC)),
    roc AS (SELECT *, 2e2 * decoy / (target + decoy) AS fdr FROM c)
    """


@query(
    "p01_validate", "psm",
    _VALIDATE + """SELECT rs_id, threshold, target, decoy, fdr FROM roc QUALIFY row_number() OVER (PARTITION BY rs_id ORDER BY
    CASE WHEN fdr >= 95e-2 * 66e0 AND fdr < 66e0 THEN 0 WHEN fdr < 66e0 THEN 1 ELSE 2 END, CASE WHEN fdr >= 95e-2 * 66e0 AND fdr < 66e0 THEN -target ELSE abs(fdr - 66e0) END, threshold) = 1""",
)
def p01(v: Views):
    return validate(v.psm, 66.0)


@query(
    "p02_merge_tree", "edge psm",
    """, t(ancestor, descendant) AS (SELECT parent_id, child_id FROM edge UNION ALL SELECT t.ancestor, e.child_id FROM t JOIN edge e ON e.parent_id = t.descendant)
    SELECT ancestor AS node, peptide_id, arg_max(psm_id, (score, -psm_id)) AS best_psm_id, max(score) AS score, count(*) AS spectral_count
    FROM t JOIN orders ON descendant = concat('C', CAST(o_custkey AS STRING)) JOIN psm ON query_id = o_orderkey GROUP BY 1, 2""",
    recursive=True,
)
def p02(v: Views):
    leaf = v.table("orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("leaf"))
    return merged_tree(v.psm.select("psm_id", "query_id", "peptide_id", "score").join(leaf, "query_id"), v.edge, "leaf")


@query(
    "p03_profiles", "quant channel",
    """, f AS (SELECT q.qc_id, median(r.raw_abundance / q.raw_abundance) AS factor FROM quant q JOIN quant r ON r.entity_id = q.entity_id AND r.row_id = q.row_id AND r.qc_id = 1995 GROUP BY 1),
    s AS (SELECT entity_id, q.qc_id, median(raw_abundance * coalesce(factor, 1e0)) AS a FROM quant q LEFT JOIN f ON f.qc_id = q.qc_id GROUP BY 1, 2),
    r AS (SELECT entity_id, median(CASE WHEN group_number = 2 THEN a END) / median(CASE WHEN group_number = 1 THEN a END) AS ratio FROM s JOIN channel USING (qc_id) GROUP BY 1)
    SELECT entity_id, floor(ratio * 1e9 + 5e-1) / 1e9 AS ratio, CASE WHEN ratio >= 15e-1 THEN 1 WHEN ratio <= 1 / 15e-1 THEN -1 WHEN ratio IS NOT NULL THEN 0 END AS state FROM r""",
)
def p03(v: Views):
    return profiles(v.quant, v.channel, 1995).withColumn("ratio", rounded(F.col("ratio"), 9))


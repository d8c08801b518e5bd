"""Catalogue: filters, ranks, false-discovery rates of matches (q01 to q15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import fdr, filters, ranking
from .registry import query
from .views import Views

_R4 = "floor({} * 1e4 + 5e-1) / 1e4"


@query("q01_score_filter", "psm", "SELECT psm_id, score, score >= 5e1 AS is_validated FROM psm")
def q01(v: Views):
    return filters.score(v.psm, 50.0).select("psm_id", "score", "is_validated")


@query("q02_seq_length_filter", "", "SELECT p_partkey, p_name AS sequence, length(p_name) >= 10 AND p_size >= 2e1 AS is_validated FROM part")
def q02(v: Views):
    parts = v.table("part").withColumnRenamed("p_name", "sequence")
    return filters.score(filters.sequence_length(parts, 10), 20.0, column="p_size").select("p_partkey", "sequence", "is_validated")


@query(
    "q03_decoy_regex_split", "psm",
    """, marked AS (SELECT p.*, regexp_matches(s.s_name, '[13579]$') AS dec FROM psm p JOIN supplier s ON s.s_suppkey = p.protein_id)
    SELECT peptide_id, bool_or(dec) AS in_decoy, bool_or(NOT dec) AS in_target FROM marked GROUP BY 1""",
)
def q03(v: Views):
    proteins = filters.decoy_split(v.table("supplier"), "s_name", "[13579]$").select(F.col("s_suppkey").alias("protein_id"), "is_decoy")
    return filters.without_both(v.psm.select("protein_id", "peptide_id").join(proteins, "protein_id"), "peptide_id", "is_decoy")


@query(
    "q04_best_psm_per_peptide", "psm",
    """SELECT peptide_id, psm_id, score, delta_moz FROM psm
    QUALIFY row_number() OVER (PARTITION BY peptide_id ORDER BY score DESC, delta_moz DESC, psm_id) = 1""",
)
def q04(v: Views):
    return ranking.best_per(v.psm.select("peptide_id", "psm_id", "score", "delta_moz"), ["peptide_id"], ["score", "delta_moz"])


@query(
    "q05_single_psm_per_query", "psm",
    """, n AS (SELECT protein_id, count(*) AS c FROM psm GROUP BY 1)
    SELECT query_id, psm_id, score, peptide_id FROM psm JOIN n USING (protein_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c DESC, delta_moz, peptide_id, psm_id) = 1""",
)
def q05(v: Views):
    return ranking.single_per_query(v.psm.select("query_id", "psm_id", "score", "peptide_id", "protein_id", "delta_moz")).select("query_id", "psm_id", "score", "peptide_id")


@query(
    "q06_rank_after_split", "psm",
    """SELECT psm_id, query_id, is_decoy, CAST(row_number() OVER (PARTITION BY query_id, is_decoy ORDER BY rank, psm_id) AS INT) AS new_rank FROM psm""",
)
def q06(v: Views):
    return ranking.renumber(v.psm.select("psm_id", "query_id", "is_decoy", "rank"), ["query_id", "is_decoy"], [F.col("rank"), F.col("psm_id")]).drop("rank")


_PRETTY = """, o AS (SELECT query_id, psm_id, score, peptide_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, psm_id) AS k FROM psm),
    f(query_id, psm_id, score, peptide_id, k, pretty_rank, lead_score) AS (
      SELECT query_id, psm_id, score, peptide_id, k, 1, score FROM o WHERE k = 1
      UNION ALL SELECT o.query_id, o.psm_id, o.score, o.peptide_id, o.k, CASE WHEN f.lead_score - o.score > 1e0 THEN f.pretty_rank + 1 ELSE f.pretty_rank END,
        CASE WHEN f.lead_score - o.score > 1e0 THEN o.score ELSE f.lead_score END FROM f JOIN o ON o.query_id = f.query_id AND o.k = f.k + 1)
    """


@query("q07_pretty_rank", "psm", _PRETTY + "SELECT query_id, psm_id, CAST(pretty_rank AS INT) AS pretty_rank FROM f", recursive=True)
def q07(v: Views):
    return ranking.pretty_rank(v.psm, ["query_id"], tolerance=1.0)


@query(
    "q08_single_seq_per_rank", "psm",
    _PRETTY + """SELECT query_id, psm_id, peptide_id, CAST(pretty_rank AS INT) AS pretty_rank FROM
    (SELECT *, first_value(peptide_id) OVER (PARTITION BY query_id, pretty_rank ORDER BY score DESC, peptide_id, psm_id) AS b FROM f) WHERE b = peptide_id""",
    recursive=True,
)
def q08(v: Views):
    ranked = ranking.pretty_rank(v.psm.select("query_id", "psm_id", "score", "peptide_id"), ["query_id"], tolerance=1.0, carry=["score", "peptide_id"])
    return ranking.same_sequence_as_best(ranked, ["query_id", "pretty_rank"]).select("query_id", "psm_id", "peptide_id", "pretty_rank")


@query(
    "q09_bh_adjust", "psm",
    f""", g AS (SELECT is_decoy, score, count(*) AS n FROM psm GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY is_decoy ORDER BY score DESC) AS k, sum(n) OVER (PARTITION BY is_decoy) AS m FROM g)
    SELECT is_decoy, score, CAST(n AS BIGINT) AS n, {_R4.format("(1e6 * min(m::DOUBLE / k::DOUBLE * pow(1e1, score / -1e1)) OVER (PARTITION BY is_decoy ORDER BY score))")} AS adjusted_e6 FROM r""",
)
def q09(v: Views):
    out = fdr.bh_adjust(v.psm.select("is_decoy", "score"), ["is_decoy"])
    return out.select("is_decoy", "score", "n", rounded(F.col("adjusted") * 1e6).alias("adjusted_e6"))


_TD = "SELECT rs_id, count(*) FILTER (NOT is_decoy AND score >= 5e1) AS target, count(*) FILTER (is_decoy AND score >= 5e1) AS decoy FROM psm GROUP BY 1"


@query("q10_td_fdr_counts", "psm", f"SELECT *, 2e2 * decoy / (target + decoy) AS fdr FROM ({_TD})")
def q10(v: Views):
    n = fdr.counts(v.psm, ["rs_id"], F.col("score") >= 50)
    return n.withColumn("fdr", fdr.estimate(F.col("target"), F.col("decoy")))


_ROC = """, g AS (SELECT score AS threshold, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM psm GROUP BY 1),
    c AS (SELECT threshold, CAST(sum(t) OVER (ORDER BY threshold DESC) AS BIGINT) AS target, CAST(sum(d) OVER (ORDER BY threshold DESC) AS BIGINT) AS decoy FROM g),
    roc AS (SELECT *, 2e2 * decoy / (target + decoy) AS fdr FROM c)
    """


def _curve(v: Views):
    return fdr.roc(v.psm.select(F.col("score").alias("threshold"), "is_decoy"), []).select("threshold", "target", "decoy", "fdr")


@query("q11_roc_curve", "psm", _ROC + "SELECT threshold, target, decoy, fdr FROM roc")
def q11(v: Views):
    return _curve(v)


_ROC_RS = """, g AS (SELECT rs_id, score AS threshold, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM psm GROUP BY 1, 2),
    roc AS (SELECT rs_id, threshold, CAST(sum(t) OVER (PARTITION BY rs_id ORDER BY threshold DESC) AS BIGINT) AS target,
      CAST(sum(d) OVER (PARTITION BY rs_id ORDER BY threshold DESC) AS BIGINT) AS decoy FROM g)
    """


@query(
    "q12_roc_edges", "psm",
    _ROC_RS + """SELECT rs_id, threshold, target, decoy FROM roc
    QUALIFY decoy <> lag(decoy) OVER (PARTITION BY rs_id ORDER BY threshold DESC) OR decoy <> lead(decoy) OVER (PARTITION BY rs_id ORDER BY threshold DESC)""",
)
def q12(v: Views):
    curve = fdr.roc(v.psm.select("rs_id", F.col("score").alias("threshold"), "is_decoy"), ["rs_id"])
    return fdr.roc_edges(curve, ["rs_id"]).select("rs_id", "threshold", "target", "decoy")


@query(
    "q13_roc_min_fdr", "psm",
    _ROC + """SELECT threshold, target, decoy, fdr FROM (SELECT *, min(fdr) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM roc)
    WHERE w IS NULL OR fdr < w""",
)
def q13(v: Views):
    from ..operators.running import binned

    return fdr.roc_min(binned(_curve(v), "threshold", []), []).select("threshold", "target", "decoy", "fdr")


@query(
    "q14_threshold_at_fdr", "psm",
    _ROC + """SELECT threshold, target, decoy, fdr FROM roc ORDER BY CASE WHEN fdr >= 95e-2 * 66e0 AND fdr < 66e0 THEN 0 WHEN fdr < 66e0 THEN 1 ELSE 2 END,
    CASE WHEN fdr >= 95e-2 * 66e0 AND fdr < 66e0 THEN -target ELSE abs(fdr - 66e0) END, threshold LIMIT 1""",
)
def q14(v: Views):
    return fdr.at_expected(_curve(v), [], 66.0).select("threshold", "target", "decoy", "fdr")


@query(
    "q15_td_competition", "psm",
    """, s AS (SELECT query_id, max(score) FILTER (NOT is_decoy) AS t, max(score) FILTER (is_decoy) AS d FROM psm GROUP BY 1)
    SELECT count(*) FILTER (t >= 5e1 AND d >= 5e1 AND t >= d) AS target_better, count(*) FILTER (t >= 5e1 AND d >= 5e1 AND t < d) AS decoy_better,
      count(*) FILTER (t >= 5e1 AND d < 5e1) AS target_over, count(*) FILTER (d >= 5e1 AND t < 5e1) AS decoy_over,
      count(*) FILTER (t >= 5e1 AND d IS NULL) AS target_only, count(*) FILTER (d >= 5e1 AND t IS NULL) AS decoy_only FROM s""",
)
def q15(v: Views):
    return fdr.competition(v.psm, 50.0)

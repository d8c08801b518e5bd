"""Adapter views: the driver's star schema read as scored matches, sets, abundances and features.

Each view exists twice: as a DataFrame and as DuckDB SQL, so a query and its oracle start alike.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy views over one data folder; only the columns of a view reach the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def psm(self) -> DataFrame:
        """Scored matches. The id is built from the key columns, so no global numbering is needed."""
        return self.table("lineitem").select(
            (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")) * 10007 + F.col("l_suppkey")).alias("psm_id"),
            F.col("l_orderkey").alias("query_id"),
            F.col("l_partkey").alias("peptide_id"),
            F.col("l_suppkey").alias("protein_id"),
            F.col("l_linenumber").alias("rank"),
            (F.col("l_linenumber") % 3 + 1).cast("int").alias("charge"),
            (F.col("l_extendedprice") / 1e3).alias("score"),
            (F.col("l_discount") - 5e-2).alias("delta_moz"),
            (F.col("l_returnflag") == "R").alias("is_decoy"),
            F.year("l_shipdate").cast("int").alias("rs_id"),
        )

    @cached_property
    def occurrence(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("protein_id"), F.col("l_partkey").alias("peptide_id")).distinct()

    @cached_property
    def quant(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("row_id"), F.year("l_shipdate").cast("int").alias("qc_id"))
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("raw_abundance"), F.count("*").alias("psm_count"))
        )

    @cached_property
    def channel(self) -> DataFrame:
        year = F.year("l_shipdate").cast("int")
        return self.table("lineitem").select(year.alias("qc_id"), (year - 1994).alias("qc_idx"), F.when(year <= 1997, 1).otherwise(2).alias("group_number")).distinct()

    @cached_property
    def feature(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("feature_id"),
            (F.col("user_id") % 3).cast("int").alias("map_id"),
            F.col("event_type").alias("charge"),
            F.col("value").alias("mz"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
            F.col("value").alias("intensity"),
            F.lit(3.6e3).alias("duration"),
        )

    @cached_property
    def edge(self) -> DataFrame:
        nation, customer = self.table("nation"), self.table("customer")
        name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
        return nation.select(name("R", "n_regionkey").alias("parent_id"), name("N", "n_nationkey").alias("child_id")).unionAll(
            customer.select(name("N", "c_nationkey"), name("C", "c_custkey"))
        )


SQL = {
    "psm": """SELECT ((l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey AS psm_id, l_orderkey AS query_id,
        l_partkey AS peptide_id, l_suppkey AS protein_id, l_linenumber AS rank, CAST(l_linenumber % 3 + 1 AS INT) AS charge,
        l_extendedprice / 1e3 AS score, l_discount - 5e-2 AS delta_moz, l_returnflag = 'R' AS is_decoy, CAST(year(l_shipdate) AS INT) AS rs_id
        FROM lineitem""",
    "occurrence": "SELECT DISTINCT l_orderkey AS protein_id, l_partkey AS peptide_id FROM lineitem",
    "quant": """SELECT l_partkey AS entity_id, l_suppkey AS row_id, CAST(year(l_shipdate) AS INT) AS qc_id,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS raw_abundance, count(*) AS psm_count FROM lineitem GROUP BY 1, 2, 3""",
    "channel": """SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS qc_id, CAST(year(l_shipdate) AS INT) - 1994 AS qc_idx,
        CASE WHEN year(l_shipdate) <= 1997 THEN 1 ELSE 2 END AS group_number FROM lineitem""",
    "feature": """SELECT event_id AS feature_id, CAST(user_id % 3 AS INT) AS map_id, event_type AS charge, value AS mz, epoch_us(ts) / 1e6 AS t,
        value AS intensity, 3.6e3 AS duration FROM events""",
    "edge": """SELECT concat('R', CAST(n_regionkey AS STRING)) AS parent_id, concat('N', CAST(n_nationkey AS STRING)) AS child_id FROM nation
        UNION ALL SELECT concat('N', CAST(c_nationkey AS STRING)), concat('C', CAST(c_custkey AS STRING)) FROM customer""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """The SQL ``body`` behind the named views; it may begin with further CTEs after a comma."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if head else body

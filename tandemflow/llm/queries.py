"""The registered query of each operator: it reads its whole table and keeps the operator's defaults."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, covertree, langid, licenses, mixing, neardup, quality, secrets, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), size=4)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.link(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_license_scan": op3_license_scan,
        "op4_mix_sources": op4_mix_sources,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_url_filters": op6_url_filters,
        "op7_secret_scan": op7_secret_scan,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_quality_cotraining": op9_quality_cotraining,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.ORACLE_SQL, "op5_minhash_near_dedup": neardup.ORACLE_SQL, "op10_embedding_near_dedup": covertree.ORACLE_SQL}

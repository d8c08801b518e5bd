"""Intermediate tables in the shared folder, and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = f"file://{_own[0]}"
    return named.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: the plan ends here, and no executor's loss undoes it."""
    path = f"{shared_folder(df.sparkSession)}/tandemflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_or_create(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """What of ``new`` isn't stored yet, once for each key."""
    return new.join(stored.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def remapped(df: DataFrame, mapping: DataFrame, column: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """A copy's rows with their ids replaced by a mapping table; ids without an entry stay."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    joined = df.join(m, F.col(column) == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def without_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is still there."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def purged(dropped: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What stays of each table when ``dropped`` (id) goes, and with it all that hangs on it, level by level.

    chain: (table, its key, the column that names its parent), from the top down; the first hangs on ``dropped``.
    """
    out, gone = [], dropped.select(F.col("id").alias("_gone")).distinct()
    for df, key, parent in chain:
        out.append(df.join(gone, df[parent] == gone["_gone"], "left_anti"))
        gone = df.join(gone, df[parent] == gone["_gone"], "left_semi").select(F.col(key).alias("_gone")).distinct()
    return out


def cloned(tables: dict[str, DataFrame], mapping: DataFrame, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A copy of whole tables with all the named id columns replaced. mapping: (old_id, new_id)."""
    out = {}
    for name, df in tables.items():
        for c in columns.get(name, []):
            df = remapped(df, mapping, c)
        out[name] = df
    return out


def object_tree(df: DataFrame, key: str, schema_name: str) -> DataFrame:
    """(key, schema_name, clob_data): every other column as one JSON document."""
    return df.select(key, F.lit(schema_name).alias("schema_name"), F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("clob_data"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)

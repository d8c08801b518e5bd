"""Materialised intermediates in the folder that all executors share.

``cut`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back: the
lineage ends there and a lost executor never loses the data.  Only where the session names no
such folder (tests, a laptop) is a folder of our own taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = f"file://{_own[0]}"
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, under a name used once."""
    path = f"{folder(df.sparkSession)}/tandemflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Typed tables: scans by name, selections over several tables, loads by a set of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder of Parquet files, or of a catalog database."""

    def __init__(self, spark: SparkSession, folder: str | None = None, database: str | None = None) -> None:
        self.spark, self.folder, self.database = spark, folder, database

    def table(self, name: str) -> DataFrame:
        if self.folder is None:
            return self.spark.table(f"{self.database}.{name}" if self.database else name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def select(self, columns: dict[str, list[str]], on: list[tuple[str, str]], where: Column | None = None) -> DataFrame:
        """Columns of several tables, joined by equal columns ('table.column' pairs).

        A column name that several tables have is prefixed with its table.
        """
        frames = {t: self.table(t).alias(t) for t in columns}
        tables = list(columns)
        out = frames[tables[0]]
        for i, t in enumerate(tables[1:], 1):
            before = set(tables[:i])
            keys = [F.col(a) == F.col(b) for a, b in on if {a.split(".")[0], b.split(".")[0]} <= before | {t} and t in (a.split(".")[0], b.split(".")[0])]
            if not keys:
                raise ValueError(f"nothing joins {t} to {', '.join(tables[:i])}")
            condition = keys[0]
            for k in keys[1:]:
                condition &= k
            out = out.join(frames[t], condition)
        if where is not None:
            out = out.filter(where)
        names = [c for cs in columns.values() for c in cs]
        return out.select(*(F.col(f"{t}.{c}").alias(f"{t}_{c}" if names.count(c) > 1 else c) for t, cs in columns.items() for c in cs))

    def by_ids(self, name: str, ids: DataFrame, key: str = "id") -> DataFrame:
        """Rows whose key is among ``ids`` (a one-column DataFrame of any size)."""
        return self.table(name).join(ids.toDF(key), key, "left_semi")


def optional(c: str, default) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def in_order(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """``df`` sorted by the position of its key. order: (key, position)."""
    return df.join(order, key).orderBy("position").drop("position")

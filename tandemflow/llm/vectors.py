"""Shared reading of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and of finite components with one that isn't 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector as array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    return table.filter(usable(v)).select(F.col(vec_id).alias("id"), v.alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def matrix_column(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

"""Arriving result sets as a stream: counts in event time, and validation of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fdr


def windowed_counts(stream: DataFrame, at: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Targets, decoys and FDR by event-time window; rows later than ``late`` are out."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), *keys).agg(F.count_if(~F.col("is_decoy")).alias("target"), F.count_if("is_decoy").alias("decoy"))
    return counted.select(F.col("w.start").alias("start"), *keys, "target", "decoy", fdr.estimate(F.col("target"), F.col("decoy")).alias("fdr"))


def validating(expected_fdr: float, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds is_validated by each result set's threshold in the batch and passes it on."""
    from ..plans.pipelines import validated

    def batch(df: DataFrame, number: int) -> None:
        sink(validated(df, expected_fdr), number)

    return batch

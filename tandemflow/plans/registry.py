"""Registry of the catalogue's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Registers a function of Views as the query ``name``, with SQL over the named views."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(views, sql, recursive)
        return build

    return register

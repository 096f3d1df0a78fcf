"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from legwise.catalog.frames import Tables
from legwise.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_KEPT: dict[tuple, DataFrame] = {}


def fitted_once(build: Callable[[Tables], DataFrame]):
    """The result of a fit, written once per session and folder, for the queries that look at it from several sides."""
    def run(t: Tables) -> DataFrame:
        key = (t.spark.sparkContext.applicationId, t.folder, build.__name__)
        if key not in _KEPT:
            _KEPT[key] = settle(build(t))
        return _KEPT[key]

    return run


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under an operator name."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return build
    return register

"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(tables)``; ``sql`` is its oracle."""

    def deco(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(name)
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return f

    return deco


def _load() -> None:
    from terrace.plans import queries_engine, queries_more, queries_tables  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

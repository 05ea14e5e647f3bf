"""All registered queries and their SQL. A query takes (spark, sf_dir); its SQL runs on the same tables by their names."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name."""

    def add(f):
        _QUERIES[name] = lambda spark, base: f(Tables(spark, base))
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in ("filters", "joining", "counting", "ranked", "hierarchy", "texts", "classes", "maps", "loads", "composites", "searches"):
        import_module(f"dijkstone.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return queries()["top02_order_page"](spark, base)

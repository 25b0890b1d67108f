"""Queries by name: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load, with_views

Views = Callable[[str], DataFrame]
_queries: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of views under its name, with its SQL over the views named."""

    def add(f: Callable[[Views], DataFrame]):
        _queries[f.__name__] = f, with_views(sql, *views) if sql and views else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(lambda view: load(spark, sf_dir, view)) for name, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _queries.items() if sql}

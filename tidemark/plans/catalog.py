"""Registry of named queries: a DataFrame builder and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.tables import Tables, with_projections

Builder = Callable[[Tables], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; ``sql`` is the equivalent text for a SQL engine."""

    def register(build: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def _runner(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Tables(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, build in _BUILDERS.items()}


def all_sql() -> dict[str, str]:
    return {name: with_projections(sql) for name, sql in _SQL.items()}

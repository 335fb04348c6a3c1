"""Every registered query over the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None, build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    """A query that builds its plan from stand-in tables, and the SQL that gives the same rows."""
    from ..sources.standin import frame, oracle

    _QUERIES[name] = lambda spark, sf_dir: build(lambda table: frame(spark, sf_dir, table))
    if sql is not None:
        _SQL[name] = oracle(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _load() -> None:
    from . import content_queries, report_queries, search_queries  # noqa: F401  they register themselves


_load()

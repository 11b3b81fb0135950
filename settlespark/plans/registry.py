"""Key → (Spark query, SQL text).  Section modules register themselves on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from settlespark.plans.derive_sql import sql as with_prefix
from settlespark.sources.scenario import Scenario

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(scenario) -> DataFrame`` under ``key`` with the SQL stating the same result."""

    def wrap(fn: Callable[[Scenario], DataFrame]):
        assert key not in _QUERIES, key
        _QUERIES[key] = lambda spark, sf_dir: fn(Scenario(spark, sf_dir))
        if sql:
            _SQL[key] = sql
        return fn

    return wrap


def _load() -> None:
    from settlespark.plans import (  # noqa: F401
        audit_ops, cases, checks, events, ledger, matching, money, payments, settlements, stored, streams,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return {key: with_prefix(body) for key, body in _SQL.items()}

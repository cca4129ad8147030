"""Names of all queries with their Spark functions and, where SQL expresses them, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their true range average and swing marks."""
    from tidewright.operators.folds import wilder_atr
    from tidewright.operators.windows import swings
    from tidewright.sources.tables import hourly

    return wilder_atr(swings(hourly(spark, sf_dir)))


def load() -> None:
    """Imports the modules that register queries."""
    from . import q_agents, q_bars, q_battery, q_capture, q_context, q_decisions, q_desk, q_eval, q_execution, q_folds, q_journal, q_learning, q_ledger, q_levels, q_live, q_money, q_more, q_policies, q_reviews, q_sources, q_streams, q_structure  # noqa: F401

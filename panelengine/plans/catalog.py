"""Registry of named queries (the ``queries()`` / ``oracle_sql()`` contract)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all():
    # import for side effects: each module registers its queries
    from . import (  # noqa: F401
        q_features,
        q_quality,
        q_metrics,
        q_linear,
        q_whatif,
        q_forecast,
        q_trees,
        q_augment,
        q_sinks,
        q_more,
    )

    return QUERIES, ORACLE

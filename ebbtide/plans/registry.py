"""Query registry: every query is a Spark callable ``(spark, sf_dir) -> DataFrame``,
optionally paired with an independent SQL text (DuckDB dialect) that computes
the same rows from the raw driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from ebbtide.plans import (  # noqa: F401
        q_eval,
        q_features,
        q_models,
        q_profile,
        q_relational,
        q_reports,
    )

"""Registered queries over the given tables, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = (
    "cohort_queries", "threshold_queries", "learner_queries", "tree_queries", "dynamics_queries", "fusion_queries", "trial_queries",
)


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name; ``sql`` gives the same result on the same tables."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return register


def load() -> None:
    for module in MODULES:
        import_module(f"cohortlens.catalog.{module}")

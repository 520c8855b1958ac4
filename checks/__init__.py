"""Queries over the given tables, one per operator, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_MODULES = [
    "sources",
    "tensors",
    "reductions",
    "quantiles",
    "concepts",
    "tallies",
    "reports",
    "rates",
    "graphs",
    "images",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in _MODULES:
        import_module(f"checks.{module}")

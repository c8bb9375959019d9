"""Collects the registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Views, with_views

MODULES = ("corpus", "relational", "analytics", "safety", "retrieval", "dialogue", "trees", "streams")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Views as a query, with its SQL oracle over tables and stand-in views."""
    def wrap(fn: Callable[[Views], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            _ORACLES[name] = with_views(sql)
        return fn

    return wrap


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lectern.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES

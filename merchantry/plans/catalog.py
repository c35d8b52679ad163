"""Registry of named queries (Spark callables) and their DuckDB twins.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, sql or None)``. A query
reads the supplied tables (through the feed/gold mapping) so its work grows with them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from merchantry.plans import queries  # noqa: F401

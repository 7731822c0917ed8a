"""All queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("lines", "neighbours", "similar", "truncation", "quality", "splitting", "encoding", "packing", "repetition")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries of all problems."""
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").SQL.items()}

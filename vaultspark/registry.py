"""All queries of the library over the shared tables, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES: tuple[str, ...] = ("structured", "analytics", "retrieval", "custom", "tables")


def _all():
    for name in _MODULES:
        yield importlib.import_module(f"vaultspark.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _all():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _all():
        out |= m.ORACLE
    return out

"""The registry of queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("catalogue", "policy", "tables", "report", "batch", "decision", "identity", "verify", "payloads", "totals", "reconcile", "checks", "certificates")


def load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"certlake.plans.{name}")


def query(oracle: str | None = None):
    """Registers a function as a query, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))

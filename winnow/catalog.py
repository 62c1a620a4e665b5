"""All queries of the package outside the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of winnow.plans, each with queries() and oracle_sql().
MODULES = ["vectors", "manifest", "clustering", "sampling", "statistics", "retrieval", "registry", "sets", "files"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in import_module(f"winnow.plans.{m}").queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"winnow.plans.{m}").oracle_sql().items()}

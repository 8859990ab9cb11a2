"""All queries of the library proper (the llm subpackage is added elsewhere)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of plumbline.plans; each has QUERIES (name: function) and ORACLE (name: SQL).
PLANS = ["ledgers", "comparisons", "usage", "gating", "scoring", "receipts", "records", "sessions", "distilling", "access", "growth", "packs", "trail", "documents", "snapshots"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in PLANS:
        found |= importlib.import_module(f"plumbline.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in PLANS:
        found |= importlib.import_module(f"plumbline.plans.{name}").ORACLE
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["led_verify"](spark, sf_dir)

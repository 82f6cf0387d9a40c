"""Registered queries: each workload module holds ``QUERIES`` and the matching DuckDB ``SQL``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["names", "miner", "passages", "voice", "alignment", "stores", "serials"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        for name, value in getattr(import_module(f"{__name__}.{module}"), attribute).items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = value
    return merged


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")

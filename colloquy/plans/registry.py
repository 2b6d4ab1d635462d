"""All queries of the conversation operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_analytics", "q_text", "q_ops", "q_words", "q_io")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f".{m}", __package__).SQL.items()}

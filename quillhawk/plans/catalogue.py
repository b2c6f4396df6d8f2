"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillhawk.plans import table_queries, text_queries, vector_queries

_PARTS = (text_queries, vector_queries, table_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, (f, _) in part.REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.REGISTERED.items() if sql}

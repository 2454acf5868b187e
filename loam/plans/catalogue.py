"""Every query of the library's own operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that each hold QUERIES: name -> (function of session and folder, SQL or None).
MODULES: tuple[str, ...] = ("text_queries", "record_queries", "graph_queries", "entity_queries", "flow_queries", "pick_queries", "stream_queries", "bundle_queries", "technique_queries", "source_queries", "feedback_queries", "review_queries", "sql_queries")
FLAGSHIP = "text_profile"


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
    for name in MODULES:
        found |= import_module(f"loam.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}

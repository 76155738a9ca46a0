"""Named queries: a DataFrame builder plus, where SQL can say it, a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables.  The oracle is an independent SQL statement over the same
tables (pre-registered as views); the two must agree on column names and
values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    rows: str  # SURVEY row ids this query covers


_REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle (or None)."""
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, rows)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # import for side effects: each module registers its queries
    from stackyard.plans import (  # noqa: F401
        activity, text_ops, functions_q, ordered, joins_q, updates_q,
        io_q, streams_q, versions_q, sql_surface)
    return dict(_REGISTRY)

"""Registry of named queries: a Spark builder and, where SQL can express it,
the equivalent DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_contamination, q_conversations, q_evaluation, q_fanout, q_inference, q_rewrite,  # noqa: F401
                   q_sources, q_streaming, q_text, q_tokens)

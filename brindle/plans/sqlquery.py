"""Queries that are one SQL text: Spark plans it, and the same meaning is checked with other engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.session import register

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "ontime", "ontime_loads", "ontime_raw", "airports", "carriers", "lineitem_rowstore", "lineitem_colstore", "review_items",
)
_NAME = re.compile(r"\b(" + "|".join(sorted(TABLES, key=len, reverse=True)) + r")\b")


def tables_of(text: str) -> list[str]:
    """The tables that a query's text names."""
    return sorted(set(_NAME.findall(re.sub(r"'[^']*'", "", text))))


def run_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables that the text names; each is read whole, columns and rows pruned by Catalyst only."""
    names = tables_of(text)

    def query(spark: SparkSession, sf: str) -> DataFrame:
        register(spark, sf, *names)
        return spark.sql(text)

    return query


class Catalogue:
    """Queries of one module with their SQL for comparison."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def both(self, name: str, text: str, other: str | None = None) -> None:
        """A SQL query; ``other`` where another engine spells it differently."""
        self.queries[name] = run_sql(text)
        self.sql[name] = other or text

    def frame(self, name: str, sql: str | None = None) -> Callable:
        """Registers a DataFrame query, with the SQL that gives the same result."""

        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep

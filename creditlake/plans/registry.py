"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers the decorated function of (spark, sf_dir) under a name."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = Query(run, sql)
        return run

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen with grades up to A-."""
    from creditlake.operators.screen import Filters, screen
    from creditlake.plans import adapters as A

    return screen(A.companies(spark, sf_dir), A.ratings(spark, sf_dir), A.financials(spark, sf_dir), Filters(max_grade=7))


from creditlake.plans import match_queries, merge_queries, screen_queries, source_queries, stored_queries, text_queries  # noqa: E402, F401  they register themselves

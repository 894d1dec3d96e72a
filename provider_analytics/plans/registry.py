"""Named queries: a DataFrame builder over the domain and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain, oracle


@dataclass(frozen=True)
class Query:
    build: Callable[[Domain], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under a name."""

    def add(build: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, oracle(sql) if sql else None)
        return build

    return add


def runner(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: entry.build(Domain(spark, folder))

"""Registered queries: name, covered operators, DataFrame builder, comparable SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans.views import Views, sql


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, body: str | None = None):
    """Register a builder; ``body`` is SQL over the shared views, or None when SQL is no match."""

    def register(build: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, covers, build, sql(body) if body else None)
        return build

    return register


def load() -> dict[str, Query]:
    from evidentia.plans import (  # noqa: F401
        collector_queries,
        content_queries,
        function_queries,
        merge_queries,
        read_queries,
        resolve_queries,
        rule_queries,
        source_queries,
    )

    return REGISTRY


def runner(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: entry.build(Views(spark, root))

"""Registered queries and the ANSI SQL each one is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources.fixtures import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``fixtures`` names the derived views its oracle reads."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_fixtures(oracle, *fixtures)
        return fn

    return register

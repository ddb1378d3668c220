"""Registered queries: one per operator, with the equivalent SQL text where SQL can say it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL_TEXT: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator id; ``sql`` is omitted for procedural operators."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL_TEXT[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every catalog. Python functions of the package are pickled by value, so tasks need
    no installed copy and the driver may start in any folder."""
    cloudpickle.register_pickle_by_value(sys.modules["spanweave"])
    from . import (  # noqa: F401
        catalog_aggregates,
        catalog_editing,
        catalog_functions,
        catalog_generation,
        catalog_intervals,
        catalog_joins,
        catalog_matching,
        catalog_search,
        catalog_sources,
        catalog_streaming,
        catalog_windows,
    )

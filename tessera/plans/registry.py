"""Registration of catalog queries with the SQL each one is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Modules whose import registers queries.
CATALOG = ("core", "joins", "aggregates", "windows", "projection", "expressions", "scalars", "collections", "session")


@dataclass(frozen=True)
class Query:
    """A query, the rows of the operator inventory it covers, and its DuckDB SQL if there is one."""

    run: Callable[[SparkSession, str], DataFrame]
    ops: tuple[str, ...]
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def query(*ops: str, oracle: str | None = None) -> Callable:
    """Register the decorated (spark, sf_dir) function under its own name."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if run.__name__ in _QUERIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        _QUERIES[run.__name__] = Query(run, ops, oracle)
        return run

    return add


def registry() -> dict[str, Query]:
    """All catalog queries, in the order of registration."""
    for module in CATALOG:
        importlib.import_module(f"tessera.plans.{module}")
    return dict(_QUERIES)

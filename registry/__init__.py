"""Queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def register(make: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is there already")
        QUERIES[name] = make
        if oracle is not None:
            ORACLES[name] = oracle
        return make

    return register


def load_all() -> None:
    from registry import (  # noqa: F401
        compare_queries,
        document_queries,
        enrich_queries,
        file_queries,
        reverse_queries,
        template_queries,
        text_queries,
        update_queries,
    )

"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.catalog.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["analytics", "texts", "retrieval", "extraction", "evaluation", "ingest"]


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the corpus views it names, dependencies first.

    ``sql`` may itself start with WITH.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in SQL_VIEWS[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name][1]})" for name in ordered)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE") :] if recursive else body[len("WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin over the tables and ``views``."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"quire.catalog.{module}")

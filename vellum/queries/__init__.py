"""Registered queries: each runs one operator over the driver's tables, next to the same thing in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its statement if SQL can state it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


from . import identity, listing, retrieval, scoring, streams, texts, upkeep  # noqa: E402, F401

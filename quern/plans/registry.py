"""Registered queries: each a callable (spark, sf_dir) -> DataFrame and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep

"""A registry of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator): ``@query(name, sql)`` registers a function of (spark, sf_dir)."""
    queries: dict = {}
    sql: dict = {}

    def query(name: str, twin: str | None = None):
        def add(f):
            queries[name] = f
            if twin:
                sql[name] = twin
            return f

        return add

    return queries, sql, query

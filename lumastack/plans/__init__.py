"""Registered queries: operators on captures derived from the tables, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ["core", "models", "surfaces"]


def registered() -> tuple[dict, dict[str, str]]:
    """(queries, SQL) of all modules."""
    queries: dict = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql

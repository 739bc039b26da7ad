"""Registered queries: a DataFrame and, where it can be said in SQL, its check."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("rows", "curves", "paired", "features", "similarity", "keyed", "readouts", "ingest", "readers")


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in _MODULES:
        module = import_module(f"foldwise.plans.catalog.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql

"""The queries of this folder and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("queries", "vector_queries")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load():
    for name in MODULES:
        import_module(f"tidemark.llm.{name}")
    return QUERIES, ORACLES

"""Queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from .common import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register

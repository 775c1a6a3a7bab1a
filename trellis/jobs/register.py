"""Queries and their SQL, by name."""

from __future__ import annotations

_queries: dict = {}
_oracle: dict = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_queries)


def oracle_sql():
    return dict(_oracle)

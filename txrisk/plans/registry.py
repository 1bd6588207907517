"""Registry of named queries: a Spark builder plus (optionally) its SQL oracle.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the test
tables; each oracle is DuckDB SQL over the same tables.  Column names and
types are aligned on both sides (every computed column is aliased).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco

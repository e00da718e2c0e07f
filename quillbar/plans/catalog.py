"""Register of queries and of the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def alias(name: str, of: str) -> None:
    """A further name of a query, with its SQL."""
    QUERIES[name] = QUERIES[of]
    if of in ORACLES:
        ORACLES[name] = ORACLES[of]

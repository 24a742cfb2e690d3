"""Registered queries and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that DuckDB runs."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def chosen(name: str):
    """The query of a name, as a user may add one; an unknown name is an error."""
    if name not in QUERIES:
        raise ValueError(f"no query is called {name!r}")
    return QUERIES[name]


def load() -> None:
    """Import the modules that register queries."""
    from tessera.plans import learning, linking, relational, storage, textual  # noqa: F401

"""The registry of queries outside the pipeline subpackage: name -> builder, and name -> SQL for the oracle.

A query's name begins with the ids of the operators that it applies.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows if there is one."""

    def add(build: Callable) -> Callable:
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return add

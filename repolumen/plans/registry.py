"""Registry of runnable queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_PARTS: dict[str, tuple[list[str], str]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def part(name: str, needs: str, sql: str) -> None:
    """A named subquery of the checking SQL and the subqueries it reads."""
    _PARTS[name] = (needs.split(), sql)


def oracle(name: str, needs: str, sql: str) -> None:
    ordered: list[str] = []

    def visit(item):
        for need in _PARTS[item][0]:
            visit(need)
        if item not in ordered:
            ordered.append(item)

    for item in needs.split():
        visit(item)
    ctes = ",\n".join(f"{item} AS ({_PARTS[item][1]})" for item in ordered)
    ORACLE[name] = f"WITH {ctes}\n{sql}" if ctes else sql

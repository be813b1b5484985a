"""Collects queries and their SQL; SQL parts are shared as named WITH clauses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    """A named WITH clause; `name` may carry a column list."""
    _PARTS[name.split("(")[0].strip()] = (list(needs), f"{name} AS MATERIALIZED ({body})" if "RECURSIVE" not in body
                                          else f"{name} AS ({body.replace('RECURSIVE', '')})")


def sql(*needs: str, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _PARTS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    clauses = ",\n".join(_PARTS[n][1] for n in order)
    return f"WITH RECURSIVE {clauses}\n{body}" if clauses else body


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn
    return register

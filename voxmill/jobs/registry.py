"""Where queries are registered next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its oracle."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zeros."""
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def r(*exprs: str, digits: int = 6) -> str:
    """The same in SQL: ``expr AS name`` items rounded."""
    out = []
    for e in exprs:
        body, _, name = e.rpartition(" AS ")
        out.append(f"round(({body or name})::DOUBLE, {digits}) + 0.0 AS {name}")
    return ", ".join(out)

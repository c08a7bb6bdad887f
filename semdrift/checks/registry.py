"""Registered queries, the SQL that must give the same rows, and the inventory ids they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Doubles are compared at six decimals."""
    return F.round(col, 6)


def wall(col: Column | str) -> Column:
    """Timestamps are compared without a zone."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")

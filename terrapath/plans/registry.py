"""Query registry: name -> (Spark query, optional SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded half away from zero as the twins do it: the scaled double decides, not its decimal text."""
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale, 0) / scale


def r4(c: Column | str) -> Column:
    """Metres and percent, compared to 0.1 mm."""
    return rounded(c, 4)


def r7(c: Column | str) -> Column:
    """Degrees, compared to about 1 cm."""
    return rounded(c, 7)

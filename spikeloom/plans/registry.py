"""Name -> (Spark builder, equivalent SQL) registry behind the driver entry points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(c: str | Column, digits: int) -> Column:
    """A double rounded as the equivalent SQL rounds it: scaled, halves away from zero."""
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale, 0) / scale

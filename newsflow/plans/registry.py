"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def stamp(at: Column | str) -> Column:
    """Timestamps leave as text, so both engines compare on the same form."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def exact(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(value: Column | str) -> Column:
    """Six places; nudged, so that an exact half rounds alike in both engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(1e-9), 6)

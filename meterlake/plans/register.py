"""Where queries and the SQL of their rows are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def text(at: Column | str) -> Column:
    """A time as text, to the second."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def text_sql(at: str) -> str:
    return f"strftime({at}, '%Y-%m-%d %H:%M:%S')"


def rounded(value: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)

"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with the SQL that gives the same rows, kept side by side."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            f.sql = sql
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def r6(c: Column | str) -> Column:
    """Rounded where it is returned, never before."""
    return F.round(c, 6)

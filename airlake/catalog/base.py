"""Registered queries: a Spark plan over the benchmark tables and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round results of float sums, whose last bits depend on the order of rows."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def shown_sql(x: str, digits: int = 2) -> str:
    """SQL of ``round_half_up``: decimal rounding of a value without its last bits."""
    return f"cast(round(cast({x} as decimal(28, 9)), {digits}) as double)"

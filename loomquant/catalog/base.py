"""Shared pieces of the catalog: registration, rounding, and the domain views as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a query, with the SQL for the same rows if there is one."""

        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return register


def rounded(df: DataFrame, *values: str, digits: int = 6, keep_nan: bool = False) -> DataFrame:
    """`values` rounded, with no negative zero and, unless it is kept as the SQL has it, no NaN."""

    def one(c: str) -> Column:
        v = F.round(F.col(c).cast("double"), digits) + F.lit(0.0)
        return (v if keep_nan else F.when(~F.isnan(v), v)).alias(c)

    return df.select(*[one(c) if c in values else F.col(c) for c in df.columns])


def r(expression: str, digits: int = 6) -> str:
    """SQL of the same rounding."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS ord, value AS price,
  CAST(user_id % 10 + 1 AS DOUBLE) AS volume, user_id FROM events)"""
OHLCV = """ohlcv AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
PRICES = """prices AS (SELECT o_orderdate AS ts, o_orderpriority AS asset, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2)"""
SPANS = """spans AS (SELECT event_type AS symbol, event_id AS id, ts AS start, ts + to_hours(CAST(1 + event_id % 5 AS BIGINT)) AS "end",
  CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS side, 0.5e0 + (user_id % 50) / 101.0e0 AS prob FROM events)"""

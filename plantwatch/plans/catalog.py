"""Registered queries, each beside the SQL it is held against.

A query's doubles are rounded to six places on both sides, as sums run in
different orders; ``d`` names the double columns of the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.plans.frames import SQL
from plantwatch.session import ship

PLACES = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places as DuckDB's round() does it: the product with 10**6 to a whole number, halves away from zero.

    Spark's round() takes the shortest decimal instead, and then 0.0654095 goes up, whose product lies below the half.
    """

    def one(name: str):
        x = F.col(name).cast("double")
        y = F.round(x * 10.0**PLACES) / 10.0**PLACES
        return F.when(F.abs(y) < float("inf"), y).otherwise(x)

    return df.withColumns({f.name: one(f.name) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def query(name: str, sql: str | None = None, d: str = "", base: bool = True):
    """Register a query under a name; ``sql`` may use the frames of ``plans.frames``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return rounded(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            body = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {PLACES}) + 0.0 AS {c}' for c in d.split())}) FROM ({sql})" if d else sql
            ORACLES[name] = (SQL if base else "") + body
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from plantwatch.plans import queries_core, queries_models, queries_more, queries_runs, queries_tables  # noqa: F401

"""Query catalog over the driver tables: every operator family as a named query
plus, where SQL can express it, the DuckDB oracle that must give the same rows.

Doubles are rounded to 6 places on both sides (summation order differs between
engines); every computed column carries the same alias in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (oracle parity)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def R(expr: str, places: int = 6) -> str:
    """SQL rounding; ``+ 0.0`` folds negative zero into zero."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)


# Importing the query modules fills the registries.
from sensor_yield.plans import (queries_charts, queries_eval, queries_load, queries_marts, queries_ml,  # noqa: E402,F401
                                queries_profile, queries_trees)

"""Registry of named queries over the driver tables, each with its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle, when the operator is
expressible in SQL, is DuckDB text over the base tables (views inlined as
CTEs). Results are normalised the same way on both sides: integers as BIGINT,
doubles rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROUND_DIGITS = 6


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), ROUND_DIGITS)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), ROUND_DIGITS)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional SQL oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def dbl(x: float) -> str:
    """A double literal that parses bit-exactly in both engines."""
    return f"cast('{float(x)!r}' as double)"


def r6(expr: str) -> str:
    """Round like the Spark side; ``+ 0.0`` turns DuckDB's -0.0 into 0.0 (Spark never yields -0.0 here)."""
    return f"(round({expr}, {ROUND_DIGITS}) + 0.0)"

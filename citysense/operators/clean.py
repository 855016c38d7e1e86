"""Projections, cleaning and filters (B1-B16). All ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import IDENTIFIER_COLUMNS, require_columns

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def parse_timestamp(df: DataFrame, col: str = "date", fmt: str | None = None, strict: bool = True) -> DataFrame:
    """B1: string -> TIMESTAMP_NTZ. ``strict`` raises on bad input (ANSI), else NULL."""
    require_columns(df, [col], "timestamp parsing")
    if dict(df.dtypes)[col] in ("timestamp_ntz", "timestamp"):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    c = F.col(col)
    if strict:
        parsed = F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)
    else:
        parsed = F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") if fmt else \
            F.try_to_timestamp(c).cast("timestamp_ntz")
    return df.withColumn(col, parsed)


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B2: cast to double, bad values and NaN -> NULL (``try_cast``; plain cast raises under ANSI)."""
    present = [c for c in cols if c in df.columns]
    number = {c: F.col(c).try_cast("double") for c in present}
    return df.withColumns({c: F.when(~F.isnan(x), x) for c, x in number.items()}) if present else df


def drop_missing_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Keep rows where both coordinates are present (neither NULL nor NaN)."""
    kinds = dict(df.dtypes)
    present = F.lit(True)
    for c in (lat, lon):
        present = present & F.col(c).isNotNull()
        if kinds.get(c) in ("double", "float"):
            present = present & ~F.isnan(c)
    return df.where(present)


def binary_target(c: Column, dtype: str) -> Column:
    """B4 expression: 'true'/'false' (exact) or booleans -> 1/0; anything else NULL."""
    if dtype == "boolean":
        return c.cast("int")
    return F.when(c == "true", 1).when(c == "false", 0)


def arrest_to_int(df: DataFrame, col: str = "arrest") -> DataFrame:
    """Map the target column to 1/0."""
    require_columns(df, [col], "target mapping")
    return df.withColumn(col, binary_target(F.col(col), dict(df.dtypes)[col]))


def drop_identifiers(df: DataFrame, cols: Sequence[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    """Drop identifier columns; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def columns_of_type(df: DataFrame, numeric: bool = True) -> list[str]:
    """Names of numeric (or non-numeric) columns. Booleans are *not* numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) == numeric]


def select_by_type(df: DataFrame, numeric: bool = True) -> DataFrame:
    return df.select(*columns_of_type(df, numeric))


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL -> 0 in numeric columns (all numeric ones by default)."""
    cols = list(cols) if cols is not None else columns_of_type(df, True)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in cols})


def align_to(df: DataFrame, train_cols: Sequence[str]) -> DataFrame:
    """Training column order; missing columns -> 0, extra columns dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in train_cols])


def common_columns(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep only the columns both frames have, in the left frame's order."""
    keep = [c for c in left.columns if c in set(right.columns)]
    return left.select(*keep), right.select(*keep)


def hour_in_period(hour: Column, start: int, end: int) -> Column:
    """B11 predicate: inclusive hour range; wraps past midnight when start > end."""
    return hour.between(start, end) if start < end else ((hour >= start) | (hour <= end))


def period_shares(df: DataFrame, periods, date_col: str = "date") -> DataFrame:
    """Rows and share of total per named hour period, in one aggregate pass."""
    h = F.hour(date_col)
    aggs = [F.count(F.lit(1)).alias("_total")]
    for name, start, end in periods:
        aggs.append(F.sum(F.when(hour_in_period(h, start, end), 1).otherwise(0)).alias(name))
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("period"), F.col(f"`{name}`").cast("long").alias("n"))
                                for name, _, _ in periods]))
    return (wide.select(stack.alias("s"), "_total")
                .select("s.period", "s.n", (F.col("s.n") * 100.0 / F.col("_total")).alias("pct_of_total")))


def safety_label_name(c: str | Column = "safety_label") -> Column:
    """0/1 -> Safe/Unsafe."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == 1, "Unsafe").when(c == 0, "Safe")


def arrest_label_name(c: str | Column = "arrest") -> Column:
    """1/0 -> Arrested/Not Arrested."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == 1, "Arrested").when(c == 0, "Not Arrested")


def month_abbrev(c: str | Column = "date") -> Column:
    """B12: 'Jan', 'Feb', ..."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "MMM")


def bools_to_int(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Boolean columns -> 0/1 integers."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("int") for c in cols}) if cols else df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B14."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Same-row horizontal concatenation of numeric blocks into a vector column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def preview(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows under an explicit, unique order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)

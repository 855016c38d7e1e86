"""Aggregations and profiling.

Every operator is one aggregate pass with map-side partial aggregation, so a
key that holds a third of all rows costs one hash-table entry per task, not a
hot reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import WEEKDAY_NAMES
from ..session import materialize


def _n():
    return F.count(F.lit(1))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, count)`` with NULL keys dropped (pandas ``value_counts``)."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(col)).agg(_n().alias("count"))


def value_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F1 for several columns in one pass: ``(column, value, count)``, values as strings."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("s"))
    return (stacked.where(F.col("s.value").isNotNull())
                   .groupBy(F.col("s.column").alias("column"), F.col("s.value").alias("value"))
                   .agg(_n().alias("count")))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """the k most frequent values, ties broken by value (TakeOrderedAndProject)."""
    return value_counts(df, col).orderBy(F.desc("count"), F.asc(col)).limit(k)


def counts_by(df: DataFrame, key: Column | str, name: str | None = None) -> DataFrame:
    """row count per key value (e.g. ``hour(date)``, ``month(date)``)."""
    k = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    return df.groupBy(k.alias(name)).agg(_n().alias("count"))


def counts_by_weekday(df: DataFrame, date_col: str = "date") -> DataFrame:
    """counts in fixed Monday..Sunday order; absent days present with a NULL count."""
    counts = df.groupBy(F.weekday(date_col).alias("day_num")).agg(_n().alias("count"))
    days = df.sparkSession.range(7).select(
        F.col("id").cast("int").alias("day_num"),
        F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.col("id").cast("int") + 1).alias("day_of_week"))
    # both sides have at most 7 rows
    return days.join(F.broadcast(counts), "day_num", "left").select("day_num", "day_of_week", "count")


def rate_by(df: DataFrame, key: Column | str, target: Column | str, name: str | None = None,
            rate_name: str = "rate") -> DataFrame:
    """mean of a 0/1 target per key (arrest rate by hour, weekday, type)."""
    k = F.col(key) if isinstance(key, str) else key
    t = F.col(target) if isinstance(target, str) else target
    name = name or (key if isinstance(key, str) else "key")
    return df.groupBy(k.alias(name)).agg(F.avg(t).alias(rate_name), _n().alias("count"))


def distribution(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """count and share (percent, rounded) per value.

    The counts are written once and their sum is read back as a scalar, so the
    input is scanned once and the column may have any number of values.
    """
    counts = materialize(value_counts(df, col))
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumns({"share": F.col("count") / total,
                               "percent": F.round(F.col("count") * 100.0 / total, digits)})


def describe(df: DataFrame) -> DataFrame:
    """F8: ``describe(include='all')`` in long form: rows ``(column, stat, value)``, values as text.

    Strings and other types: count, unique, top (the smallest on ties), freq. Numbers: count, mean,
    std, min, exact 25%, 50%, 75%, max. Timestamps and dates: count, mean, min, quartiles, max.
    One pass for the plain aggregates, one for all quartiles, and one for all columns of a type
    for the value counts.
    """
    from .prepare import _stacked, fit_modes
    from .stats import exact_quantiles

    fields = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c, t in fields.items() if isinstance(t, T.NumericType)]
    times = [c for c, t in fields.items() if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    others = [c for c in fields if c not in numbers and c not in times]

    def micros(c: str) -> Column:  # wall-clock microseconds since 1970, whatever the zone
        return F.unix_micros(F.to_timestamp_ltz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")))

    def as_time(value: Column) -> Column:
        return F.date_format(F.timestamp_micros(value.cast("long")), "yyyy-MM-dd HH:mm:ss.SSSSSS")

    measured = df.select(*[F.col(f"`{c}`") for c in numbers + others], *[micros(c).alias(c) for c in times])
    aggs, keys = [], []
    for c in fields:
        x = F.col(f"`{c}`")
        stats = {"count": F.count(x).cast("string")}
        if c in numbers:
            stats |= {"mean": F.avg(x).cast("string"), "std": F.stddev_samp(x).cast("string"),
                      "min": F.min(x).cast("double").cast("string"), "max": F.max(x).cast("double").cast("string")}
        elif c in times:
            stats |= {"mean": as_time(F.floor(F.sum(x.cast("decimal(38,0)")) / F.count(x))), "min": as_time(F.min(x)), "max": as_time(F.max(x))}
        for s, e in stats.items():
            keys.append((c, s, f"a{len(keys)}"))
            aggs.append(e.alias(keys[-1][2]))
    wide = measured.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(a).alias("value")) for c, s, a in keys]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    if numbers or times:
        q = exact_quantiles(_stacked(measured, numbers + times, "double"), "value", [0.25, 0.5, 0.75], ["name"])
        is_time = F.col("name").isin(times) if times else F.lit(False)
        value = F.when(is_time, as_time(F.floor("r.value"))).otherwise(F.col("r.value").cast("string"))
        marks = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"q_{i}").alias("value")) for i, s in enumerate(("25%", "50%", "75%"))])
        out = out.unionByName(q.select("name", F.explode(marks).alias("r")).select(
            F.col("name").alias("column"), "r.stat", value.alias("value")))
    if others:
        uniques = _stacked(df, others, "string").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(uniques.select(F.col("name").alias("column"), F.lit("unique").alias("stat"), F.col("n").cast("string").alias("value")))
        tops = [(c, s, v) for c, (top, n) in fit_modes(df, others).items() for s, v in (("top", top.cast("string")), ("freq", F.lit(str(n))))]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), v.alias("value")) for c, s, v in tops])
        out = out.unionByName(df.sparkSession.range(1).select(F.explode(cells).alias("r")).select("r.*"))
    return out


def null_profile(df: DataFrame, top: int | None = 10) -> DataFrame:
    """NULL count and percent per column, largest first (ties by name)."""
    cols = df.columns
    # one aggregate row, then one `stack` expression (built as SQL text: one JVM call)
    aggs = [f"sum(cast(`{c}` is null as bigint)) as m{i}" for i, c in enumerate(cols)] + ["count(1) as n"]
    wide = df.selectExpr(*aggs)
    pairs = ", ".join(f"{_sql_str(c)}, m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr(f"stack({len(cols)}, {pairs}) as (`column`, missing)", "n")
    out = long.select("column", "missing", (F.col("missing") * 100.0 / F.col("n")).alias("percent"))
    out = out.orderBy(F.desc("missing"), F.asc("column"))
    return out.limit(top) if top else out


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every ordered pair, NULL pairs skipped; long form.

    One aggregate computes the k(k+1)/2 distinct pairs, with one input row for
    each row; the matrix is mirrored in the projection of its single result row.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.selectExpr(*[f"corr(cast(`{cols[i]}` as double), cast(`{cols[j]}` as double)) as c{i}_{j}" for i, j in pairs])
    cells = [f"{_sql_str(cols[a])}, {_sql_str(cols[b])}, c{i}_{j}" for i, j in pairs for a, b in dict.fromkeys([(i, j), (j, i)])]
    return wide.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (column_a, column_b, corr)")


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def row_count_and_types(df: DataFrame) -> DataFrame:
    """``(column, type, rows)``: the schema as a DataFrame with the row count."""
    n = df.agg(_n().alias("rows"))
    schema_rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
                            for f in df.schema.fields])
    return n.select(F.explode(schema_rows).alias("s"), "rows").select("s.column", "s.type", "rows")

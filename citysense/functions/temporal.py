"""Calendar columns (C1-C11) as built-in expressions.

Everything here is a ``Column`` expression or a ``DataFrame -> DataFrame``
transform made of them, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns

# Fixed values that must equal the reference's.
HOLIDAYS_MMDD = ["01-01", "07-04", "12-25", "12-31"]
SEASON_MONTHS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11]}
# Time of day: [5,12) Morning, [12,17) Afternoon, [17,22) Evening, else Night.
TIME_OF_DAY_BOUNDS = [(5, 12, "Morning"), (12, 17, "Afternoon"), (17, 22, "Evening")]
# Weekday names in Monday = 0 order.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour(c="date") -> Column:
    return F.hour(_c(c))


def day_name(c="date") -> Column:
    """Full English day name ('Sunday')."""
    return F.date_format(_c(c), "EEEE")


def weekday_num(c="date") -> Column:
    """Day of week with Monday = 0 (``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(c))


def quarter(c="date") -> Column:
    return F.quarter(_c(c))


def is_weekend(c="date") -> Column:
    """Saturday or Sunday."""
    return F.weekday(_c(c)) >= 5


def time_of_day(hour_col: str | Column = "hour") -> Column:
    """Morning/Afternoon/Evening/Night buckets of an hour column. NULL hour -> NULL."""
    h = _c(hour_col)
    expr = None
    for lo, hi, name in TIME_OF_DAY_BOUNDS:
        cond = (h >= lo) & (h < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.when(h.isNotNull(), F.lit("Night"))


def date_mmdd(c="date") -> Column:
    return F.date_format(_c(c), "MM-dd")


def is_holiday(c="date") -> Column:
    """Fixed-date holidays."""
    return date_mmdd(c).isin(HOLIDAYS_MMDD)


def season(month_col: str | Column = "month") -> Column:
    """Meteorological season of a month number."""
    m = _c(month_col)
    expr = None
    for name, months in SEASON_MONTHS.items():
        cond = m.isin(months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def is_night(hour_col: str | Column = "hour") -> Column:
    """Hour >= 20 or hour < 6."""
    h = _c(hour_col)
    return (h >= 20) | (h < 6)


def month_key(c="date") -> Column:
    """C10: 'yyyy-MM' period key."""
    return F.date_format(_c(c), "yyyy-MM")


def add_calendar_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Hour, month, year, day."""
    require_columns(df, [date_col], "calendar parts")
    d = F.col(date_col)
    return df.withColumns({"hour": F.hour(d), "month": F.month(d), "year": F.year(d), "day": F.dayofmonth(d)})


def add_temporal_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """C11: the temporal feature bundle, in one projection."""
    require_columns(df, [date_col], "temporal features")
    d = F.col(date_col)
    df = df.withColumns({
        "hour": F.hour(d),
        "day_of_week": day_name(d),
        "day_of_week_num": weekday_num(d),
        "month": F.month(d),
        "year": F.year(d),
        "day": F.dayofmonth(d),
        "quarter": F.quarter(d),
    })
    return df.withColumns({
        "time_of_day": time_of_day("hour"),
        "is_weekend": F.col("day_of_week_num") >= 5,
        "date_mmdd": date_mmdd(d),
        "is_holiday": date_mmdd(d).isin(HOLIDAYS_MMDD),
        "season": season("month"),
    })

"""Registered queries: aggregations and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import profile as P
from . import fixtures as fx
from .registry import r6, register
from .sqlviews import with_views

INC = with_views("incidents")
LOG = with_views("incident_log")
ARREST_I = "case arrest when 'true' then 1 when 'false' then 0 end"


def _arrest_int(spark, sf):
    return CL.arrest_to_int(fx.incidents(spark, sf))


@register("f1_value_counts", INC + "select c as \"column\", v as value, count(*) as count from ("
          "select 'description' as c, description as v from incidents union all "
          "select 'location_description', location_description from incidents union all "
          "select 'arrest', arrest from incidents) t where v is not null group by c, v")
def f1_value_counts(spark, sf):
    return P.value_counts_long(fx.incidents(spark, sf), ["description", "location_description", "arrest"])


@register("f2_top_locations", INC + "select location_description, count(*) as count from incidents "
          "where location_description is not null group by 1 order by count desc, location_description limit 10")
def f2_top_locations(spark, sf):
    return P.top_k(fx.incidents(spark, sf), "location_description", 10)


@register("f2_top_areas", INC + "select cast(community_area as bigint) as community_area, count(*) as count "
          "from incidents where community_area is not null group by 1 order by count desc, community_area limit 15")
def f2_top_areas(spark, sf):
    return P.top_k(fx.incidents(spark, sf), "community_area", 15)


@register("f3_count_by_hour", INC + "select hour(date) as hour, count(*) as count from incidents group by 1")
def f3_count_by_hour(spark, sf):
    return P.counts_by(fx.incidents(spark, sf), F.hour("date"), "hour")


@register("f4_count_by_weekday", INC + "select cast(d.day_num as bigint) as day_num, d.day_of_week, c.count from (values "
          "(0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), "
          "(6, 'Sunday')) d(day_num, day_of_week) left join (select isodow(date) - 1 as day_num, count(*) as count "
          "from incidents group by 1) c on c.day_num = d.day_num")
def f4_count_by_weekday(spark, sf):
    return P.counts_by_weekday(fx.incidents(spark, sf))


@register("f4_count_by_weekday_log", LOG + "select cast(d.day_num as bigint) as day_num, d.day_of_week, c.count from (values "
          "(0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), "
          "(6, 'Sunday')) d(day_num, day_of_week) left join (select isodow(date) - 1 as day_num, count(*) as count "
          "from incident_log group by 1) c on c.day_num = d.day_num")
def f4_count_by_weekday_log(spark, sf):
    return P.counts_by_weekday(fx.incident_log(spark, sf))


@register("f5_count_by_month", LOG + "select month(date) as month, count(*) as count from incident_log group by 1")
def f5_count_by_month(spark, sf):
    return P.counts_by(fx.incident_log(spark, sf), F.month("date"), "month")


@register("f6_arrest_rate_hour", INC + f"select hour(date) as hour, {r6(f'avg({ARREST_I})')} as rate, "
          "count(*) as count from incidents group by 1")
def f6_arrest_rate_hour(spark, sf):
    return P.rate_by(_arrest_int(spark, sf), F.hour("date"), "arrest", "hour")


@register("f6_arrest_rate_weekday", INC + f"select dayname(date) as day_of_week, {r6(f'avg({ARREST_I})')} as rate, "
          "count(*) as count from incidents group by 1")
def f6_arrest_rate_weekday(spark, sf):
    return P.rate_by(_arrest_int(spark, sf), F.date_format("date", "EEEE"), "arrest", "day_of_week")


@register("f6_arrest_rate_type", INC + f"select description, {r6(f'avg({ARREST_I})')} as rate, "
          "count(*) as count from incidents group by 1")
def f6_arrest_rate_type(spark, sf):
    return P.rate_by(_arrest_int(spark, sf), "description", "arrest", "description")


@register("f7_arrest_distribution", INC + "select case a when 1 then 'Arrested' else 'Not Arrested' end as arrest_label, "
          f"count(*) as count, {r6('count(*) * 1.0 / sum(count(*)) over ()')} as share, "
          f"{r6('round(count(*) * 100.0 / sum(count(*)) over (), 1)')} as percent "
          f"from (select {ARREST_I} as a from incidents) t where a is not null group by a")
def f7_arrest_distribution(spark, sf):
    df = _arrest_int(spark, sf).select(CL.arrest_label_name("arrest").alias("arrest_label"))
    return P.distribution(df, "arrest_label")


def _describe_sql() -> str:
    """Text statistics as text, all numbers as doubles; times as text to the microsecond."""
    numbers, times = ["id", "latitude", "longitude", "district", "community_area"], ["date"]
    texts = ["case_number", "primary_type", "description", "arrest", "location_description"]
    row = lambda c, stat, number="null", text="null": (
        f"select '{c}' as column, '{stat}' as stat, round(cast({number} as double), 6) as number, cast({text} as varchar) as text from incidents")
    parts, stamp = [], lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"
    quarters = (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))
    for c in numbers:
        parts += [row(c, "count", f"count({c})"), row(c, "mean", f"avg({c})"), row(c, "std", f"stddev_samp({c})"),
                  row(c, "min", f"min({c})"), row(c, "max", f"max({c})")]
        parts += [row(c, s, f"quantile_cont(cast({c} as double), {q})") for s, q in quarters]
    for c in times:
        us = f"cast(epoch_us({c}) as double)"
        parts += [row(c, "count", f"count({c})"), row(c, "min", text=stamp(f"min({c})")), row(c, "max", text=stamp(f"max({c})")),
                  row(c, "mean", text=stamp(f"make_timestamp(cast(sum(epoch_us({c})) // count({c}) as bigint))"))]
        parts += [row(c, s, text=stamp(f"make_timestamp(cast(floor(quantile_cont({us}, {q})) as bigint))")) for s, q in quarters]
    for c in texts:
        parts += [row(c, "count", f"count({c})"), row(c, "unique", f"count(distinct {c})")]
        top = f"(select {c} from incidents where {c} is not null group by 1 order by count(*) desc, 1 limit 1)"
        parts += [f"select '{c}', 'top', cast(null as double), {top}",
                  f"select '{c}', 'freq', (select cast(max(n) as double) from (select count(*) as n from incidents where {c} is not null group by {c})), null"]
    return with_views("incidents") + " " + " union all ".join(parts)


@register("f8_describe", _describe_sql())
def f8_describe(spark, sf):
    out = P.describe(fx.incidents(spark, sf))
    return out.select("column", "stat", F.when(F.col("stat") != "top", F.expr("try_cast(value as double)")).alias("number"),
                      F.when((F.col("stat") == "top") | (F.expr("try_cast(value as double)").isNull()), F.col("value")).alias("text"))


_F9_COLS = ["id", "case_number", "date", "primary_type", "description", "arrest", "latitude", "longitude",
            "location_description", "district", "community_area"]


@register("f9_null_profile", INC + "select \"column\", missing, percent from (" + " union all ".join(
    f"select '{c}' as \"column\", cast(count(*) - count({c}) as bigint) as missing, "
    f"{r6(f'(count(*) - count({c})) * 100.0 / count(*)')} as percent from incidents" for c in _F9_COLS)
    + ") t order by missing desc, \"column\" limit 10")
def f9_null_profile(spark, sf):
    return P.null_profile(fx.incidents(spark, sf), top=10)


_F10_COLS = ["hour", "day", "is_weekend", "arrest", "latitude", "longitude", "district"]
_F10_SRC = (f"f10 as (select cast(hour(date) as double) as hour, cast(day(date) as double) as day, "
            f"cast(isodow(date) >= 6 as double) as is_weekend, cast({ARREST_I} as double) as arrest, "
            "latitude, longitude, cast(district as double) as district from incidents)")


@register("f10_correlation", INC + f", {_F10_SRC} " + " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, {r6(f'corr({a}, {b})')} as corr from f10"
    for a in _F10_COLS for b in _F10_COLS))
def f10_correlation(spark, sf):
    df = CL.arrest_to_int(fx.incidents(spark, sf)).select(
        F.hour("date").alias("hour"), F.dayofmonth("date").alias("day"),
        (F.weekday("date") >= 5).cast("int").alias("is_weekend"), "arrest", "latitude", "longitude", "district")
    return P.correlation_matrix(df, _F10_COLS)


@register("f13_class_distribution", with_views("scored") + "select cast(label as bigint) as label, count(*) as count, "
          f"{r6('count(*) * 1.0 / sum(count(*)) over ()')} as share, "
          f"{r6('round(count(*) * 100.0 / sum(count(*)) over (), 1)')} as percent from scored group by label")
def f13_class_distribution(spark, sf):
    return P.distribution(fx.scored(spark, sf), "label")


_F14_TYPES = [("id", "bigint"), ("case_number", "string"), ("date", "timestamp_ntz"), ("primary_type", "string"),
              ("description", "string"), ("arrest", "string"), ("latitude", "double"), ("longitude", "double"),
              ("location_description", "string"), ("district", "int"), ("community_area", "int")]


@register("f14_row_count_types", INC + "select t.\"column\", t.type, (select count(*) from incidents) as rows from (values "
          + ", ".join(f"('{c}', '{t}')" for c, t in _F14_TYPES) + ") t(\"column\", type)")
def f14_row_count_types(spark, sf):
    return P.row_count_and_types(fx.incidents(spark, sf))

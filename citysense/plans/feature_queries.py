"""Registered queries: cleaning (B), calendar (C) and keyword (E) operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import temporal as TM
from ..functions import text as TX
from ..functions.spatial import HOTSPOTS
from ..operators import clean as CL
from ..operators.spatial import TIME_PERIODS
from ..schema import MissingColumnsError, require_columns
from . import fixtures as fx
from .registry import dbl, r6, register
from .sqlviews import with_views

INC = with_views("incidents")
LOG = with_views("incident_log")


# ---- B: cleaning -----------------------------------------------------------

@register("b1_parse_timestamp", INC + "select id, cast(strftime(date, '%Y-%m-%d %H:%M:%S') as timestamp) as date "
          "from incidents")
def b1_parse_timestamp(spark, sf):
    raw = fx.incidents(spark, sf).select("id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))
    return CL.parse_timestamp(raw, "date")


_B2_SQL = "try_cast(coalesce(cast(latitude as varchar), 'n/a') as double)"


@register("b2_numeric_coercion", INC + f"select id, {r6(_B2_SQL)} as latitude from incidents")
def b2_numeric_coercion(spark, sf):
    raw = fx.incidents(spark, sf).select(
        "id", F.coalesce(F.col("latitude").cast("string"), F.lit("n/a")).alias("latitude"))
    return CL.coerce_numeric(raw, ["latitude"])


@register("b3_drop_missing_coords", INC + f"select id, {r6('latitude')} as latitude, {r6('longitude')} as longitude "
          "from incidents where latitude is not null and longitude is not null")
def b3_drop_missing_coords(spark, sf):
    return CL.drop_missing_coordinates(fx.incidents(spark, sf)).select("id", "latitude", "longitude")


@register("b4_arrest_binary", INC + "select id, cast(case arrest when 'true' then 1 when 'false' then 0 end as bigint) "
          "as arrest from incidents")
def b4_arrest_binary(spark, sf):
    return CL.arrest_to_int(fx.incidents(spark, sf)).select("id", "arrest")


@register("b5_drop_identifiers", INC + f"select arrest, {r6('latitude')} as latitude, {r6('longitude')} as longitude, "
          "location_description, cast(district as bigint) as district, cast(community_area as bigint) as community_area "
          "from incidents")
def b5_drop_identifiers(spark, sf):
    return CL.drop_identifiers(fx.incidents(spark, sf))


@register("b6_select_numeric", INC + f"select id, {r6('latitude')} as latitude, {r6('longitude')} as longitude, "
          "cast(district as bigint) as district, cast(community_area as bigint) as community_area from incidents")
def b6_select_numeric(spark, sf):
    return CL.select_by_type(fx.incidents(spark, sf), numeric=True)


@register("b7_fill_zero", INC + f"select id, {r6('coalesce(latitude, 0)')} as latitude, "
          f"{r6('coalesce(longitude, 0)')} as longitude from incidents")
def b7_fill_zero(spark, sf):
    return CL.fill_zero(fx.incidents(spark, sf).select("id", "latitude", "longitude"))


TRAIN_COLUMNS = ["district", "beat", "latitude", "hour"]


#: Transforms and the columns they require.
_REQUIRED = {"temporal features": ["date"], "spatial features": ["latitude", "longitude"], "keyword features": ["description", "location_description"],
             "area safety": ["date", "latitude", "longitude", "arrest"], "projected coordinates": ["x_coordinate", "y_coordinate"]}
_HELD = ["id", "case_number", "date", "primary_type", "description", "arrest", "latitude", "longitude", "location_description", "district", "community_area"]


def _b8_sql() -> str:
    rows = []
    for where, needed in _REQUIRED.items():
        missing = [c for c in needed if c not in _HELD]
        ready = "null" if missing else f"(select count(*) from incidents where {' and '.join(f'{c} is not null' for c in needed)})"
        rows.append(f"select '{where}' as transform, '{', '.join(missing)}' as missing, cast({ready} as bigint) as ready_rows")
    return INC + " union all ".join(rows)


@register("b8_required_columns", _b8_sql())
def b8_required_columns(spark, sf):
    """Which transforms the records allow, what the refused ones lack, and how many rows have all that the others need."""
    inc, missing = fx.incidents(spark, sf), {}
    for where, needed in _REQUIRED.items():
        try:
            require_columns(inc, needed, where)
        except MissingColumnsError as refused:
            missing[where] = refused.columns
    allowed = {w: needed for w, needed in _REQUIRED.items() if w not in missing}
    ready = inc.agg(*[F.count(F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]), 1)).alias(w) for w, needed in allowed.items()])
    rows = [F.struct(F.lit(w).alias("transform"), F.lit(", ".join(missing.get(w, []))).alias("missing"),
                     (F.col(f"`{w}`") if w in allowed else F.lit(None).cast("long")).alias("ready_rows")) for w in _REQUIRED]
    return ready.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@register("b9_align_columns", INC + f"select cast(district as bigint) as district, cast(0 as bigint) as beat, "
          f"{r6('latitude')} as latitude, cast(0 as bigint) as hour from incidents")
def b9_align_columns(spark, sf):
    return CL.align_to(fx.incidents(spark, sf), TRAIN_COLUMNS)


@register("b10_common_columns", with_views("scored") + "select id, cast(district as bigint) as district from incidents")
def b10_common_columns(spark, sf):
    inc = fx.incidents(spark, sf)
    left, _ = CL.common_columns(inc, fx.scored_from_incidents(inc))
    return left


@register("b11_period_share", INC + "select p.period, cast(count(i.id) as bigint) as n, "
          f"{r6('count(i.id) * 100.0 / (select count(*) from incidents)')} as pct_of_total "
          "from (values ('Morning (5-11)', 5, 11), ('Afternoon (12-16)', 12, 16), ('Evening (17-21)', 17, 21), "
          "('Night (22-4)', 22, 4)) p(period, s, e) left join incidents i on "
          "(case when p.s < p.e then hour(i.date) between p.s and p.e else hour(i.date) >= p.s or hour(i.date) <= p.e end) "
          "group by p.period")
def b11_period_share(spark, sf):
    return CL.period_shares(fx.incidents(spark, sf), TIME_PERIODS)


@register("b12_display_labels", INC + "select id, case arrest when 'true' then 'Arrested' when 'false' then 'Not Arrested' "
          "end as arrest_label, strftime(date, '%b') as month_name from incidents")
def b12_display_labels(spark, sf):
    df = CL.arrest_to_int(fx.incidents(spark, sf))
    return df.select("id", CL.arrest_label_name("arrest").alias("arrest_label"), CL.month_abbrev("date").alias("month_name"))


@register("b13_bool_to_int", INC + "select id, cast(isodow(date) >= 6 as bigint) as is_weekend, "
          "cast(strftime(date, '%m-%d') in ('01-01', '07-04', '12-25', '12-31') as bigint) as is_holiday from incidents")
def b13_bool_to_int(spark, sf):
    df = fx.incidents(spark, sf).select("id", TM.is_weekend().alias("is_weekend"), TM.is_holiday().alias("is_holiday"))
    return CL.bools_to_int(df)


@register("b14_rename", INC + "select id, primary_type as crime_type, description as crime_description from incidents")
def b14_rename(spark, sf):
    df = fx.incidents(spark, sf).select("id", "primary_type", "description")
    return CL.rename(df, {"primary_type": "crime_type", "description": "crime_description"})


@register("b16_preview", INC + "select id, case_number, date from incidents order by date desc, id limit 10")
def b16_preview(spark, sf):
    df = fx.incidents(spark, sf).select("id", "case_number", "date")
    return CL.preview(df, 10, [F.desc("date"), F.asc("id")])


# ---- C: calendar -----------------------------------------------------------

@register("c1_calendar_parts", INC + "select id, hour(date) as hour, month(date) as month, year(date) as year, "
          "day(date) as day from incidents")
def c1_calendar_parts(spark, sf):
    return TM.add_calendar_parts(fx.incidents(spark, sf)).select("id", "hour", "month", "year", "day")


@register("c2_day_name", INC + "select id, dayname(date) as day_of_week from incidents")
def c2_day_name(spark, sf):
    return fx.incidents(spark, sf).select("id", TM.day_name().alias("day_of_week"))


@register("c3_weekday_num", INC + "select id, isodow(date) - 1 as day_of_week_num from incidents")
def c3_weekday_num(spark, sf):
    return fx.incidents(spark, sf).select("id", TM.weekday_num().alias("day_of_week_num"))


@register("c4_quarter", LOG + "select id, quarter(date) as quarter from incident_log")
def c4_quarter(spark, sf):
    return fx.incident_log(spark, sf).select("id", TM.quarter().alias("quarter"))


@register("c5_is_weekend", INC + "select id, isodow(date) >= 6 as is_weekend from incidents")
def c5_is_weekend(spark, sf):
    return fx.incidents(spark, sf).select("id", TM.is_weekend().alias("is_weekend"))


_TOD = ("case when hour(date) >= 5 and hour(date) < 12 then 'Morning' when hour(date) >= 12 and hour(date) < 17 "
        "then 'Afternoon' when hour(date) >= 17 and hour(date) < 22 then 'Evening' else 'Night' end")


@register("c6_time_of_day", INC + f"select id, {_TOD} as time_of_day from incidents")
def c6_time_of_day(spark, sf):
    return fx.incidents(spark, sf).select("id", TM.time_of_day(F.hour("date")).alias("time_of_day"))


@register("c7_is_holiday", LOG + "select id, strftime(date, '%m-%d') as date_mmdd, "
          "strftime(date, '%m-%d') in ('01-01', '07-04', '12-25', '12-31') as is_holiday from incident_log")
def c7_is_holiday(spark, sf):
    return fx.incident_log(spark, sf).select("id", TM.date_mmdd().alias("date_mmdd"), TM.is_holiday().alias("is_holiday"))


_SEASON = ("case when month(date) in (12, 1, 2) then 'Winter' when month(date) in (3, 4, 5) then 'Spring' "
           "when month(date) in (6, 7, 8) then 'Summer' when month(date) in (9, 10, 11) then 'Fall' end")


@register("c8_season", LOG + f"select id, month(date) as month, {_SEASON} as season from incident_log")
def c8_season(spark, sf):
    return fx.incident_log(spark, sf).select("id", F.month("date").alias("month"), TM.season(F.month("date")).alias("season"))


@register("c9_is_night", INC + "select id, hour(date) >= 20 or hour(date) < 6 as is_night from incidents")
def c9_is_night(spark, sf):
    return fx.incidents(spark, sf).select("id", TM.is_night(F.hour("date")).alias("is_night"))


@register("c10_month_key", LOG + "select id, strftime(date, '%Y-%m') as month_key from incident_log")
def c10_month_key(spark, sf):
    return fx.incident_log(spark, sf).select("id", TM.month_key().alias("month_key"))


_C11_SQL = ("hour(date) as hour, dayname(date) as day_of_week, isodow(date) - 1 as day_of_week_num, "
            "month(date) as month, year(date) as year, day(date) as day, quarter(date) as quarter, "
            f"{_TOD} as time_of_day, isodow(date) >= 6 as is_weekend, strftime(date, '%m-%d') as date_mmdd, "
            f"strftime(date, '%m-%d') in ('01-01', '07-04', '12-25', '12-31') as is_holiday, {_SEASON} as season")
_C11_COLS = ["hour", "day_of_week", "day_of_week_num", "month", "year", "day", "quarter", "time_of_day",
             "is_weekend", "date_mmdd", "is_holiday", "season"]


@register("c11_temporal_bundle", INC + f"select id, {_C11_SQL} from incidents")
def c11_temporal_bundle(spark, sf):
    return TM.add_temporal_features(fx.incidents(spark, sf)).select("id", *_C11_COLS)


# ---- E: keyword features ---------------------------------------------------

def _any_sql(col: str, words) -> str:
    return "coalesce(" + " or ".join(f"contains(upper({col}), '{w}')" for w in words) + ", false)"


_E1_SQL = ("contains(upper(description), 'POCKET-PICKING') as is_pocket_picking, "
           "contains(upper(description), 'PURSE-SNATCHING') as is_purse_snatching")
_E2_SQL = (f"{_any_sql('location_description', TX.TRANSIT_KEYWORDS)} as is_transit_related, "
           f"{_any_sql('location_description', TX.COMMERCIAL_KEYWORDS)} as is_commercial, "
           f"{_any_sql('location_description', TX.RESIDENTIAL_KEYWORDS)} as is_residential")
_E_COLS = ["is_pocket_picking", "is_purse_snatching", "is_transit_related", "is_commercial", "is_residential"]


@register("e1_theft_flags", INC + f"select id, {_E1_SQL} from incidents")
def e1_theft_flags(spark, sf):
    return TX.add_crime_specific_features(fx.incidents(spark, sf)).select("id", "is_pocket_picking", "is_purse_snatching")


@register("e2_location_keywords", INC + f"select id, {_E2_SQL} from incidents")
def e2_location_keywords(spark, sf):
    return TX.add_crime_specific_features(fx.incidents(spark, sf)).select(
        "id", "is_transit_related", "is_commercial", "is_residential")


def _dist(a, b):
    return f"sqrt((latitude - {dbl(a)}) * (latitude - {dbl(a)}) + (longitude - {dbl(b)}) * (longitude - {dbl(b)}))"


_E3_SPATIAL = (", ".join(f"{r6(_dist(a, b))} as dist_to_hotspot_{i + 1}" for i, (a, b) in enumerate(HOTSPOTS))
               + ", " + r6("least(" + ", ".join(_dist(a, b) for a, b in HOTSPOTS) + ")") + " as min_dist_to_hotspot, "
               "count(*) over (partition by district) as district_crime_density")


@register("e3_all_features", INC + f"select id, {_C11_SQL}, {_E3_SPATIAL}, {_E1_SQL}, {_E2_SQL} from incidents "
          "where latitude is not null and longitude is not null")
def e3_all_features(spark, sf):
    from ..operators.features import create_all_features
    df = create_all_features(fx.incidents(spark, sf))
    hs = [f"dist_to_hotspot_{i + 1}" for i in range(len(HOTSPOTS))]
    return df.select("id", *_C11_COLS, *hs, "min_dist_to_hotspot", "district_crime_density", *_E_COLS)

"""Registered queries: spatial operators (D1-D15, F11, F12, G1, G2) on ``incidents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import DEFAULT_GRID
from ..functions.spatial import HOTSPOTS, add_hotspot_distances
from ..operators import spatial as S
from . import fixtures as fx
from .gridsql import cell_sql, centres_cte
from .registry import dbl, r6, register
from .sqlviews import with_views

G = DEFAULT_GRID
K = G.cells_per_axis
INC = with_views("incidents")
CELLS = f"cells as (select *, {cell_sql()} as cell from incidents where latitude is not null and longitude is not null)"
COUNTS = "counts as (select cell, count(*) as n from cells group by cell)"
DENSE = (f"dense as (select cast(g.i as bigint) as cell, coalesce(c.n, 0) as n "
         f"from range({G.n_cells}) g(i) left join counts c on c.cell = g.i)")
LABELS = ("labels as (select d.cell, d.n, t.threshold, cast(d.n >= t.threshold as bigint) as safety_label "
          "from dense d, (select quantile_cont(n, 0.75) as threshold from counts) t)")


def _dist_sql(a: str, b: str, lat: str = "latitude", lon: str = "longitude") -> str:
    return f"sqrt(({lat} - {a}) * ({lat} - {a}) + ({lon} - {b}) * ({lon} - {b}))"


@register("d4_grid_cell", INC + f", {CELLS} select id, cast(cell as bigint) as cell from cells")
def d4_grid_cell(spark, sf):
    return S.assign_cells(fx.incidents(spark, sf)).select("id", "cell")


@register("d5_cell_centres", INC + f", {CELLS}, {COUNTS}, {centres_cte()} "
          f"select z.cell, {r6('z.lat_c')} as lat_c, {r6('z.lon_c')} as lon_c, coalesce(c.n, 0) as n "
          f"from centres z left join counts c on z.cell = c.cell")
def d5_cell_centres(spark, sf):
    return S.with_centres(S.dense_cell_counts(S.assign_cells(fx.incidents(spark, sf))))


@register("d6_dense_counts", INC + f", {CELLS}, {COUNTS}, {DENSE} select cell, n from dense")
def d6_dense_counts(spark, sf):
    return S.dense_cell_counts(S.assign_cells(fx.incidents(spark, sf)))


ORACLES_D7 = (INC + f", {CELLS}, {COUNTS}, {DENSE}, {LABELS} "
              f"select cell, n, {r6('threshold')} as threshold, safety_label from labels")


@register("d7_area_safety_label", ORACLES_D7)
def d7_area_safety_label(spark, sf):
    return S.area_safety(fx.incidents(spark, sf))


@register("d8_map_layers", INC + f", {CELLS}, {COUNTS}, {DENSE}, {LABELS}, {centres_cte()} "
          f"select l.cell, {r6('z.lat_c')} as lat_c, {r6('z.lon_c')} as lon_c, l.n, l.safety_label, "
          f"{r6('least(1.0, l.n / (select max(n) from labels))')} as heat "
          f"from labels l join centres z on z.cell = l.cell where l.n > 0")
def d8_map_layers(spark, sf):
    return S.map_layers(S.area_safety(fx.incidents(spark, sf)))


@register("d9_heat_points", INC + f"select {r6('latitude')} as latitude, {r6('longitude')} as longitude "
          f"from incidents where latitude is not null and longitude is not null")
def d9_heat_points(spark, sf):
    return S.heat_points(fx.incidents(spark, sf))


@register("d10_grid_stats", INC + f", {CELLS}, {COUNTS}, {DENSE}, {LABELS} "
          "select count(*) as total_cells, cast(sum(case when safety_label = 0 then 1 else 0 end) as bigint) as safe_cells, "
          "cast(sum(case when safety_label = 1 then 1 else 0 end) as bigint) as unsafe_cells, "
          f"{r6('sum(case when safety_label = 0 then 1 else 0 end) * 100.0 / count(*)')} as safe_pct, "
          f"{r6('sum(case when safety_label = 1 then 1 else 0 end) * 100.0 / count(*)')} as unsafe_pct from labels")
def d10_grid_stats(spark, sf):
    return S.grid_stats(S.area_safety(fx.incidents(spark, sf)))


_PERIOD_CASE = ("case when hour(date) between 5 and 11 then 'Morning (5-11)' "
                "when hour(date) between 12 and 16 then 'Afternoon (12-16)' "
                "when hour(date) between 17 and 21 then 'Evening (17-21)' "
                "when hour(date) >= 22 or hour(date) <= 4 then 'Night (22-4)' end")


@register("d11_period_safety", INC + f", {CELLS}, "
          f"pc as (select {_PERIOD_CASE} as period, cell, count(*) as n from cells group by 1, 2), "
          "ps as (select period, sum(n) as rows_, quantile_cont(n, 0.75) as threshold from pc group by period) "
          f"select pc.period, cast(pc.cell as bigint) as cell, pc.n, {r6('ps.threshold')} as threshold, "
          "cast(pc.n >= ps.threshold as bigint) as safety_label "
          "from pc join ps on ps.period = pc.period where ps.rows_ > 100")
def d11_period_safety(spark, sf):
    return S.period_safety(fx.incidents(spark, sf))


@register("d12_nearest_centre", INC + f", {centres_cte()}, "
          "pts as (select id, latitude, longitude from incidents where latitude is not null and longitude is not null) "
          f"select p.id, first(z.cell order by {_dist_sql('z.lat_c', 'z.lon_c', 'p.latitude', 'p.longitude')}, z.cell) "
          "as nearest_cell from pts p, centres z group by p.id")
def d12_nearest_centre(spark, sf):
    inc = fx.incidents(spark, sf)
    return S.drop_missing_coordinates(inc).select("id", G.nearest_centre().alias("nearest_cell"))


# Query points for D13/D14: one named location per community area, at the mean
# position of its incidents (derived from the data, so it grows with it).
def _area_points(inc):
    return (S.drop_missing_coordinates(inc).groupBy("community_area")
              .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
              .select(F.concat(F.lit("area "), F.col("community_area").cast("string")).alias("name"),
                      "latitude", "longitude"))


_POINTS_SQL = ("pts as (select 'area ' || cast(community_area as varchar) as name, avg(latitude) as latitude, "
               "avg(longitude) as longitude from incidents where latitude is not null and longitude is not null "
               "group by community_area)")
_PROFILE_SQL = ("prof as (select cell as grid_cell, avg(latitude) as latitude_mean, avg(longitude) as longitude_mean, "
                "count(*) as n from cells group by cell), "
                "prof_l as (select p.*, cast(p.n >= (select quantile_cont(n, 0.75) from prof) as bigint) "
                "as safety_label from prof p)")
_NEAREST_SQL = (f"nn as (select p.name, first(q.grid_cell order by "
                f"{_dist_sql('q.latitude_mean', 'q.longitude_mean', 'p.latitude', 'p.longitude')}, q.grid_cell) "
                f"as nearest_occupied_cell, first(q.safety_label order by "
                f"{_dist_sql('q.latitude_mean', 'q.longitude_mean', 'p.latitude', 'p.longitude')}, q.grid_cell) "
                "as nearest_safety_label from pts p, prof_l q group by p.name)")


@register("d13_nearest_occupied", INC + f", {CELLS}, {_POINTS_SQL}, {_PROFILE_SQL}, {_NEAREST_SQL} "
          "select name, cast(nearest_occupied_cell as bigint) as nearest_occupied_cell, nearest_safety_label from nn")
def d13_nearest_occupied(spark, sf):
    inc = fx.incidents(spark, sf)
    out = S.nearest_profile_cell(_area_points(inc), S.cell_profile(inc))
    return out.select("name", "nearest_occupied_cell", "nearest_safety_label")


@register("d14_score_locations", INC + f", {CELLS}, {COUNTS}, {DENSE}, {centres_cte()}, {_POINTS_SQL}, "
          f"{_PROFILE_SQL}, {_NEAREST_SQL}, "
          f"nc as (select p.name, first(z.cell order by {_dist_sql('z.lat_c', 'z.lon_c', 'p.latitude', 'p.longitude')}, "
          "z.cell) as nearest_cell from pts p, centres z group by p.name) "
          "select nc.name, nc.nearest_cell, "
          "case when d.n = 0 then 0 else nn.nearest_safety_label end as safety_label, "
          "case when d.n = 0 then cast(1.0 as double) else cast(0.7 as double) end as confidence "
          "from nc join dense d on d.cell = nc.nearest_cell join nn on nn.name = nc.name")
def d14_score_locations(spark, sf):
    inc = fx.incidents(spark, sf)
    return S.score_locations(_area_points(inc), inc).select("name", "nearest_cell", "safety_label", "confidence")


def _hotspot_sql():
    return ", ".join(f"{r6(_dist_sql(dbl(a), dbl(b)))} as dist_to_hotspot_{i + 1}" for i, (a, b) in enumerate(HOTSPOTS))


def _min_hotspot_sql():
    return r6("least(" + ", ".join(_dist_sql(dbl(a), dbl(b)) for a, b in HOTSPOTS) + ")")


@register("d1_hotspot_distances", INC + f"select id, {_hotspot_sql()} from incidents "
          "where latitude is not null and longitude is not null")
def d1_hotspot_distances(spark, sf):
    df = add_hotspot_distances(S.drop_missing_coordinates(fx.incidents(spark, sf)))
    return df.select("id", *[f"dist_to_hotspot_{i + 1}" for i in range(len(HOTSPOTS))])


@register("d2_min_hotspot", INC + f"select id, {_min_hotspot_sql()} as min_dist_to_hotspot from incidents "
          "where latitude is not null and longitude is not null")
def d2_min_hotspot(spark, sf):
    return add_hotspot_distances(S.drop_missing_coordinates(fx.incidents(spark, sf))).select("id", "min_dist_to_hotspot")


@register("d3_district_density", INC + "select id, cast(district as bigint) as district, count(*) over (partition by district) as "
          "district_crime_density from incidents")
def d3_district_density(spark, sf):
    return S.district_density(fx.incidents(spark, sf)).select("id", "district", "district_crime_density")


@register("d15_spatial_bundle", INC + f"select id, {_hotspot_sql()}, {_min_hotspot_sql()} as min_dist_to_hotspot, "
          "count(*) over (partition by district) as district_crime_density from incidents "
          "where latitude is not null and longitude is not null")
def d15_spatial_bundle(spark, sf):
    df = S.add_spatial_features(fx.incidents(spark, sf))
    return df.select("id", *[f"dist_to_hotspot_{i + 1}" for i in range(len(HOTSPOTS))],
                     "min_dist_to_hotspot", "district_crime_density")


_FLAGS = ("flags as (select *, hour(date) as hour, isodow(date) - 1 as day_of_week, "
          "cast(isodow(date) >= 6 as int) as wk, cast(hour(date) >= 20 or hour(date) < 6 as int) as nt, "
          "case arrest when 'true' then 1 when 'false' then 0 end as arrest_i from cells)")


@register("f11_cell_features", INC + f", {CELLS}, {_FLAGS} select id, cast(cell as bigint) as cell, "
          "count(*) over (partition by cell) as cell_crime_count, "
          f"{r6('avg(arrest_i) over (partition by cell)')} as cell_arrest_rate, "
          f"{r6('avg(nt) over (partition by cell)')} as cell_night_crime_rate, "
          f"{r6('avg(wk) over (partition by cell)')} as cell_weekend_crime_rate from flags")
def f11_cell_features(spark, sf):
    return S.cell_features(fx.incidents(spark, sf)).select(
        "id", "cell", "cell_crime_count", "cell_arrest_rate", "cell_night_crime_rate", "cell_weekend_crime_rate")


@register("f12_cell_profile", INC + f", {CELLS}, {_FLAGS}, "
          "p as (select cell as grid_cell, avg(latitude) as latitude_mean, avg(longitude) as longitude_mean, "
          "avg(hour) as hour_mean, coalesce(stddev_samp(hour), 0) as hour_std, avg(day_of_week) as day_of_week_mean, "
          "coalesce(stddev_samp(day_of_week), 0) as day_of_week_std, count(*) as cell_crime_count, "
          "avg(arrest_i) as cell_arrest_rate, avg(nt) as cell_night_crime_rate, avg(wk) as cell_weekend_crime_rate, "
          "avg(nt) as is_night_mean, avg(wk) as is_weekend_mean from flags group by cell) "
          f"select cast(grid_cell as bigint) as grid_cell, {r6('latitude_mean')} as latitude_mean, "
          f"{r6('longitude_mean')} as longitude_mean, {r6('hour_mean')} as hour_mean, {r6('hour_std')} as hour_std, "
          f"{r6('day_of_week_mean')} as day_of_week_mean, {r6('day_of_week_std')} as day_of_week_std, cell_crime_count, "
          f"{r6('cell_arrest_rate')} as cell_arrest_rate, {r6('cell_night_crime_rate')} as cell_night_crime_rate, "
          f"{r6('cell_weekend_crime_rate')} as cell_weekend_crime_rate, {r6('is_night_mean')} as is_night_mean, "
          f"{r6('is_weekend_mean')} as is_weekend_mean, "
          "cast(cell_crime_count >= (select quantile_cont(cell_crime_count, 0.75) from p) as bigint) as safety_label from p")
def f12_cell_profile(spark, sf):
    return S.cell_profile(fx.incidents(spark, sf))


@register("g2_cell_label_lookup", INC + f", {CELLS}, {COUNTS}, {DENSE}, {LABELS} "
          "select c.id, cast(c.cell as bigint) as cell, coalesce(l.safety_label, 0) as safety_label "
          "from cells c left join labels l on l.cell = c.cell")
def g2_cell_label_lookup(spark, sf):
    inc = fx.incidents(spark, sf)
    return S.cell_label_lookup(S.assign_cells(inc), S.area_safety(inc)).select("id", "cell", "safety_label")

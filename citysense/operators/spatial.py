"""Spatial operators: cells, dense counts, safety labels, cell profiles, scoring.

Size bounds used for broadcasting: every table keyed by grid cell has at most
``grid.n_cells`` rows (2401 for the default grid) whatever the input size, so
it is broadcast by construction. Tables keyed by data values (districts) are
joined plainly and left to AQE, which broadcasts them only when their measured
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import DEFAULT_GRID, Grid, euclid
from ..functions.spatial import add_hotspot_distances
from ..schema import require_columns
from ..session import materialize
from .clean import coerce_numeric, drop_missing_coordinates
from .stats import attach

# Fixed values that must equal the reference's (area safety by time of day).
TIME_PERIODS = [("Morning (5-11)", 5, 11), ("Afternoon (12-16)", 12, 16),
                ("Evening (17-21)", 17, 21), ("Night (22-4)", 22, 4)]
DEFAULT_PERCENTILE = 75.0
EMPTY_CELL_CONFIDENCE = 1.0
OCCUPIED_CELL_CONFIDENCE = 0.7


def assign_cells(df: DataFrame, grid: Grid = DEFAULT_GRID, lat: str = "latitude",
                 lon: str = "longitude", out: str = "cell") -> DataFrame:
    """Drop rows without coordinates, add the grid cell id."""
    require_columns(df, [lat, lon], "grid cells")
    return drop_missing_coordinates(df, lat, lon).withColumn(out, grid.cell(lat, lon))


def cell_counts(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Occupied-cell counts ``(cell, n)``; partial aggregation makes hot cells cheap."""
    return cells.groupBy(F.col(cell).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def grid_frame(spark, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """All cells of the grid, ``(cell int)``."""
    return spark.range(grid.n_cells).select(F.col("id").cast("int").alias("cell"))


def with_centres(df: DataFrame, grid: Grid = DEFAULT_GRID, cell: str = "cell") -> DataFrame:
    """Centre latitude/longitude of a cell column."""
    return df.withColumns({"lat_c": grid.centre_lat(cell), "lon_c": grid.centre_lon(cell)})


def dense_cell_counts(cells: DataFrame, grid: Grid = DEFAULT_GRID, cell: str = "cell") -> DataFrame:
    """Counts for every cell of the grid, zeros included: ``(cell, n)``."""
    counts = cell_counts(cells, cell)
    dense = grid_frame(cells.sparkSession, grid)
    # counts has <= grid.n_cells rows: broadcast by construction.
    return (dense.join(F.broadcast(counts), "cell", "left")
                 .select("cell", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def threshold_over_cells(n: Column, percentile: float = DEFAULT_PERCENTILE) -> Column:
    """Linear-interpolated percentile of the non-zero counts of a frame keyed by cell (<= n_cells rows).

    Evaluated in the same pass as the counts instead of as a second job over
    the input; the un-partitioned window holds at most ``n_cells`` rows.
    """
    return F.percentile(F.when(n > 0, n), percentile / 100.0).over(Window.partitionBy()).cast("double")


def area_safety_labels(dense: DataFrame, percentile: float = DEFAULT_PERCENTILE) -> DataFrame:
    """``(cell, n, threshold, safety_label)``; unsafe (1) when n >= threshold."""
    return dense.select("cell", "n", threshold_over_cells(F.col("n"), percentile).alias("threshold")).withColumn(
        "safety_label", (F.col("n") >= F.col("threshold")).cast("int"))


def area_safety(df: DataFrame, grid: Grid = DEFAULT_GRID, percentile: float = DEFAULT_PERCENTILE) -> DataFrame:
    """D4 -> D6 -> D7 in one plan."""
    return area_safety_labels(dense_cell_counts(assign_cells(df, grid), grid), percentile)


def grid_stats(labels: DataFrame) -> DataFrame:
    """Total, safe, unsafe cells and their percentages."""
    total = F.count(F.lit(1))
    safe = F.sum(F.when(F.col("safety_label") == 0, 1).otherwise(0))
    unsafe = F.sum(F.when(F.col("safety_label") == 1, 1).otherwise(0))
    return labels.agg(total.alias("total_cells"), safe.cast("long").alias("safe_cells"),
                      unsafe.cast("long").alias("unsafe_cells"),
                      (safe * 100.0 / total).alias("safe_pct"), (unsafe * 100.0 / total).alias("unsafe_pct"))


def map_layers(labels: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Occupied cells with centre, label and heat intensity ``min(1, n / max n)``."""
    max_n = F.max("n").over(Window.partitionBy())  # labels: <= n_cells rows
    return (with_centres(labels.where(F.col("n") > 0), grid)
            .select("cell", "lat_c", "lon_c", "n", "safety_label",
                    F.least(F.lit(1.0), F.col("n") / max_n).alias("heat")))


def heat_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Point layer ``(latitude, longitude)`` of rows with coordinates."""
    return drop_missing_coordinates(df, lat, lon).select(lat, lon)


def period_column(hour: Column, periods=TIME_PERIODS) -> Column:
    """Array of the period names an hour falls into (wrap-around when start > end)."""
    names = []
    for name, start, end in periods:
        cond = hour.between(start, end) if start < end else ((hour >= start) | (hour <= end))
        names.append(F.when(cond, F.lit(name)))
    return F.array_compact(F.array(*names))


def period_safety(df: DataFrame, grid: Grid = DEFAULT_GRID, periods=TIME_PERIODS, min_rows: int = 100,
                  percentile: float = DEFAULT_PERCENTILE, date_col: str = "date") -> DataFrame:
    """Safety labels per time-of-day period, for periods with more than ``min_rows`` rows.

    One job for all periods: ``(period, cell)`` counts, then a per-period
    percentile over at most ``n_cells`` counts. Returns occupied cells
    ``(period, cell, n, threshold, safety_label)``; empty cells are safe.
    """
    cells = assign_cells(df, grid).withColumn("period", F.explode(period_column(F.hour(date_col), periods)))
    pc = cells.groupBy("period", "cell").agg(F.count(F.lit(1)).alias("n"))
    stats = (pc.groupBy("period")
               .agg(F.sum("n").alias("period_rows"), F.percentile("n", percentile / 100.0).alias("threshold"))
               .where(F.col("period_rows") > min_rows))
    # stats has one row per period (a fixed, small list): broadcast.
    return (pc.join(F.broadcast(stats), "period")
              .select("period", "cell", "n", F.col("threshold").cast("double").alias("threshold"),
                      (F.col("n") >= F.col("threshold")).cast("int").alias("safety_label")))


def add_area_time_flags(df: DataFrame, date_col: str = "date") -> DataFrame:
    """hour, Monday=0 day_of_week, is_weekend, is_night as used by the area features."""
    d = F.col(date_col)
    return df.withColumns({
        "hour": F.hour(d), "day_of_week": F.weekday(d),
        "is_weekend": F.weekday(d).isin(5, 6), "is_night": (F.hour(d) >= 20) | (F.hour(d) < 6),
    })


def _arrest_numeric(df: DataFrame, arrest: str) -> Column:
    if arrest not in df.columns:
        return F.lit(None).cast("double")
    dtype = dict(df.dtypes)[arrest]
    if dtype == "string":
        return F.when(F.col(arrest) == "true", 1).when(F.col(arrest) == "false", 0)
    return F.col(arrest).cast("int")


def cell_aggregates(cells: DataFrame, arrest: str = "arrest", cell: str = "cell") -> DataFrame:
    """Per-cell count and rates (the four reference groupbys as one aggregate)."""
    return cells.groupBy(F.col(cell).alias(cell)).agg(
        F.count(F.lit(1)).alias("cell_crime_count"),
        F.avg(_arrest_numeric(cells, arrest)).alias("cell_arrest_rate"),
        F.avg(F.col("is_night").cast("int")).alias("cell_night_crime_rate"),
        F.avg(F.col("is_weekend").cast("int")).alias("cell_weekend_crime_rate"))


def cell_features(df: DataFrame, grid: Grid = DEFAULT_GRID, arrest: str = "arrest",
                  date_col: str = "date") -> DataFrame:
    """F11 (+G1): per-cell count, arrest rate, night rate, weekend rate onto each row."""
    cells = add_area_time_flags(assign_cells(df, grid), date_col)
    agg = cell_aggregates(cells, arrest)
    # agg is keyed by cell: <= n_cells rows, broadcast.
    return cells.join(F.broadcast(agg), "cell", "left")


def cell_profile(df: DataFrame, grid: Grid = DEFAULT_GRID, percentile: float = DEFAULT_PERCENTILE,
                 arrest: str = "arrest", date_col: str = "date") -> DataFrame:
    """F12 (+G2): one row per occupied cell with means, sample stds, rates and the safety label."""
    cells = add_area_time_flags(assign_cells(df, grid), date_col)
    prof = cells.groupBy(F.col("cell").alias("grid_cell")).agg(
        F.avg("latitude").alias("latitude_mean"),
        F.avg("longitude").alias("longitude_mean"),
        F.avg("hour").alias("hour_mean"),
        F.coalesce(F.stddev_samp("hour"), F.lit(0.0)).alias("hour_std"),
        F.avg("day_of_week").alias("day_of_week_mean"),
        F.coalesce(F.stddev_samp("day_of_week"), F.lit(0.0)).alias("day_of_week_std"),
        F.count(F.lit(1)).alias("cell_crime_count"),
        F.avg(_arrest_numeric(cells, arrest)).alias("cell_arrest_rate"),
        F.avg(F.col("is_night").cast("int")).alias("cell_night_crime_rate"),
        F.avg(F.col("is_weekend").cast("int")).alias("cell_weekend_crime_rate"),
        F.avg(F.col("is_night").cast("int")).alias("is_night_mean"),
        F.avg(F.col("is_weekend").cast("int")).alias("is_weekend_mean"),
    )
    # The label threshold comes from the same cell counts (<= n_cells rows).
    thr = threshold_over_cells(F.col("cell_crime_count"), percentile)
    return prof.withColumn("safety_label", (F.col("cell_crime_count") >= thr).cast("int"))


def cell_label_lookup(df: DataFrame, labels: DataFrame, cell: str = "cell") -> DataFrame:
    """Attach the safety label of each row's cell; cells without a label -> 0."""
    lab = labels.select(F.col("cell").alias(cell), F.col("safety_label"))
    return df.join(F.broadcast(lab), cell, "left").withColumn(
        "safety_label", F.coalesce(F.col("safety_label"), F.lit(0)))


#: Occupied cells up to which a ring index (nine entries a cell) is broadcast.
MOST_RING_CELLS = 100_000
#: Lattice coordinates beyond this are not told apart.
_FAR = 1e15


def _lattice(x: Column, edges: tuple) -> Column:
    """Number of the grid step that holds ``x``, going on beyond the grid on both sides."""
    step = (edges[-1] - edges[0]) / (len(edges) - 1)
    return F.floor(F.least(F.greatest((x - F.lit(edges[0])) / F.lit(step), F.lit(-_FAR)), F.lit(_FAR))).cast("long")


def nearest_profile_cell(points: DataFrame, profile: DataFrame, lat: str = "latitude", lon: str = "longitude",
                         carry: tuple = ("safety_label",), grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Nearest occupied cell by mean incident location; ties -> lowest cell id.

    An iterative ring join. The means lie on the lattice of grid steps, which goes on beyond the grid. In
    round k the lattice is cut into squares of ``4 ** k`` steps; a mean is entered in its own square and the
    eight around it, so one equi-join gives a point all means of the three by three squares around it. What
    is nearest there is the nearest of all if it is no further than one square's side, since everything else
    lies beyond; such points are settled and leave, the others go on to the next round. Points that no ring
    settles (far beyond all means) are compared with every mean. Points are not shuffled while an index has at
    most nine entries for ``MOST_RING_CELLS`` counted cells; points without coordinates have no nearest cell.
    """
    fields = [F.col("latitude_mean").alias("la"), F.col("longitude_mean").alias("lo"), F.col("grid_cell").alias("grid_cell"),
              *[F.col(c).alias(c) for c in carry]]
    means = materialize(profile.select(_lattice(F.col("latitude_mean"), grid.lat_edges).alias("i"), _lattice(F.col("longitude_mean"), grid.lon_edges).alias("j"),
                                       F.struct(*fields).alias("place")))
    cells, height, width = means.agg(F.count(F.lit(1)), F.max("i") - F.min("i"), F.max("j") - F.min("j")).first()
    step = min((e[-1] - e[0]) / (len(e) - 1) for e in (grid.lat_edges, grid.lon_edges)) * (1 - 1e-9)
    plat, plon = F.col(lat), F.col(lon)

    def best(found: Column) -> Column:
        return F.array_min(F.transform(found, lambda p: F.struct(euclid(p["la"], p["lo"], plat, plon).alias("d"), p["grid_cell"].alias("grid_cell"),
                                                                *[p[c].alias(c) for c in carry])))

    placed = plat.isNotNull() & plon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    every = points.withColumns({"_i": F.when(placed, _lattice(plat, grid.lat_edges)), "_j": F.when(placed, _lattice(plon, grid.lon_edges))})
    side, done, left = 1, [], None
    while cells and side <= max(height, width, 1) * 4:
        square = lambda x: F.floor(x / F.lit(side)).cast("long")  # noqa: B023, E731  used within this round
        near = F.explode(F.array(*[F.struct((square(F.col("i")) + a).alias("_si"), (square(F.col("j")) + b).alias("_sj")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        index = means.select(near.alias("s"), "place").groupBy("s._si", "s._sj").agg(F.collect_list("place").alias("_places"))
        at = (every if left is None else left).withColumns({"_pi": square(F.col("_i")), "_pj": square(F.col("_j"))})
        joined = at.join(F.broadcast(index) if cells <= MOST_RING_CELLS else index, (F.col("_pi") == F.col("_si")) & (F.col("_pj") == F.col("_sj")), "left")
        known = (F.abs("_i") < _FAR / 2) & (F.abs("_j") < _FAR / 2)
        scored = materialize(joined.withColumn("_best", best(F.col("_places"))).withColumn(
            "_settled", F.col("_i").isNull() | F.coalesce(known & (F.col("_best.d") <= F.lit(step * side)), F.lit(False)))
            .drop("_places", "_pi", "_pj", "_si", "_sj"))
        done.append(scored.where("_settled").drop("_settled"))
        left = scored.where("NOT _settled").drop("_settled", "_best")
        if left.isEmpty():
            left = None
            break
        side *= 4
    if left is not None or not done:
        whole = means.agg(F.collect_list("place").alias("_places"))  # one row: all means
        done.append((every if left is None else left).join(F.broadcast(whole)).withColumn("_best", best(F.col("_places"))).drop("_places"))
    out = reduce(DataFrame.unionByName, done)
    return out.withColumns({"nearest_occupied_cell": F.col("_best.grid_cell"), **{f"nearest_{c}": F.col(f"_best.{c}") for c in carry}}).drop("_best", "_i", "_j")


def score_locations(points: DataFrame, incidents_df: DataFrame, grid: Grid = DEFAULT_GRID,
                    percentile: float = DEFAULT_PERCENTILE, lat: str = "latitude",
                    lon: str = "longitude") -> DataFrame:
    """Label and confidence for a table of points, as one batch.

    Nearest grid centre empty -> (0, 1.0); otherwise the label of the nearest
    occupied cell by mean location, confidence 0.7.
    """
    # One pass over the incidents: the cell profile (<= n_cells rows, checkpointed)
    # gives both the dense counts for D12's cell and the D13 search table.
    prof = materialize(cell_profile(incidents_df, grid, percentile))
    counts = prof.select(F.col("grid_cell").alias("cell"), F.col("cell_crime_count").alias("n"))
    dense = (grid_frame(incidents_df.sparkSession, grid).join(F.broadcast(counts), "cell", "left")
             .select("cell", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
    labels = dense.select(F.col("cell").alias("nearest_cell"), F.col("n").alias("nearest_cell_count"))
    pts = points.withColumn("nearest_cell", grid.nearest_centre(lat, lon))
    # labels has exactly n_cells rows: broadcast.
    pts = pts.join(F.broadcast(labels), "nearest_cell", "left")
    pts = nearest_profile_cell(pts, prof, lat, lon, grid=grid)
    empty = F.coalesce(F.col("nearest_cell_count"), F.lit(0)) == 0
    return pts.withColumns({
        "safety_label": F.when(empty, F.lit(0)).otherwise(F.col("nearest_safety_label")),
        "confidence": F.when(empty, F.lit(EMPTY_CELL_CONFIDENCE)).otherwise(F.lit(OCCUPIED_CELL_CONFIDENCE)),
    })


def district_density(df: DataFrame, district: str = "district") -> DataFrame:
    """D3: rows per district mapped back to each row; NULL district -> NULL."""
    require_columns(df, [district], "district density")
    counts = (df.where(F.col(district).isNotNull()).groupBy(district)
                .agg(F.count(F.lit(1)).alias("district_crime_density")))
    named = counts.withColumnRenamed(district, "_district")
    return attach(df, named, F.col(district) == F.col("_district"), "left").drop("_district")


def add_spatial_features(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Coerce and drop missing coordinates, hotspot distances, district density."""
    require_columns(df, [lat, lon], "spatial features")
    df = drop_missing_coordinates(coerce_numeric(df, [lat, lon]), lat, lon)
    df = add_hotspot_distances(df, lat, lon)
    if "district" in df.columns:
        df = district_density(df)
    return df

"""Point features: distance to fixed hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import euclid

# Fixed values that must equal the reference's: (latitude, longitude) of the
# four hotspots, in order hotspot_1..hotspot_4.
HOTSPOTS = [
    (41.881832, -87.623177),
    (41.878876, -87.629839),
    (41.867046, -87.606890),
    (41.925130, -87.652130),
]


def hotspot_distance_columns(lat: str = "latitude", lon: str = "longitude",
                             hotspots=HOTSPOTS) -> dict[str, Column]:
    """Euclidean distance in degrees to each hotspot."""
    return {f"dist_to_hotspot_{i + 1}": euclid(F.col(lat), F.col(lon), a, b)
            for i, (a, b) in enumerate(hotspots)}


def add_hotspot_distances(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                          hotspots=HOTSPOTS) -> DataFrame:
    """D1 + D2: per-hotspot distances and their minimum."""
    cols = hotspot_distance_columns(lat, lon, hotspots)
    df = df.withColumns(cols)
    return df.withColumn("min_dist_to_hotspot", F.least(*[F.col(c) for c in cols]))

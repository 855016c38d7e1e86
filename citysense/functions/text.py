"""Keyword features on descriptions (E1-E3) as built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
POCKET_PICKING = "POCKET-PICKING"
PURSE_SNATCHING = "PURSE-SNATCHING"
TRANSIT_KEYWORDS = ["CTA", "PLATFORM", "TRAIN", "BUS", "STATION"]
COMMERCIAL_KEYWORDS = ["STORE", "RESTAURANT", "BAR", "TAVERN", "GROCERY", "RETAIL"]
RESIDENTIAL_KEYWORDS = ["APARTMENT", "RESIDENCE", "HOUSE", "BUILDING", "DWELLING"]


def contains_ci(c: str | Column, needle: str) -> Column:
    """Case-insensitive substring test; NULL input gives NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.upper(col).contains(needle.upper())


def contains_any(c: str | Column, keywords: list[str]) -> Column:
    """Any keyword is a substring of upper(x); NULL input gives False.

    Substring semantics on purpose: 'HOUSE' matches WAREHOUSE, 'BUS' matches BUSINESS.
    """
    col = F.upper(F.col(c) if isinstance(c, str) else c)
    hit = None
    for k in keywords:
        cond = col.contains(k)
        hit = cond if hit is None else (hit | cond)
    return F.coalesce(hit, F.lit(False))


def add_crime_specific_features(df: DataFrame) -> DataFrame:
    """Theft-type flags and location keyword flags, for the columns present."""
    cols = {}
    if "description" in df.columns:
        cols["is_pocket_picking"] = contains_ci("description", POCKET_PICKING)
        cols["is_purse_snatching"] = contains_ci("description", PURSE_SNATCHING)
    if "location_description" in df.columns:
        cols["is_transit_related"] = contains_any("location_description", TRANSIT_KEYWORDS)
        cols["is_commercial"] = contains_any("location_description", COMMERCIAL_KEYWORDS)
        cols["is_residential"] = contains_any("location_description", RESIDENTIAL_KEYWORDS)
    return df.withColumns(cols) if cols else df

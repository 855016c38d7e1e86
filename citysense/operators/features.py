"""The full feature set, temporal -> spatial -> keyword, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.temporal import add_temporal_features
from ..functions.text import add_crime_specific_features
from .spatial import add_spatial_features


def create_all_features(df: DataFrame) -> DataFrame:
    return df.transform(add_temporal_features).transform(add_spatial_features).transform(add_crime_specific_features)

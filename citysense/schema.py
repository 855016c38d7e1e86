"""Incident record schema and plan-build-time column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Raw records as they land from the open-data API or its CSV export: every
# field is text. Coercion happens in explicit steps.
RAW_INCIDENT_FIELDS = [
    "id", "case_number", "date", "block", "iucr", "primary_type", "description",
    "location_description", "arrest", "domestic", "beat", "district", "ward",
    "community_area", "fbi_code", "x_coordinate", "y_coordinate", "year",
    "updated_on", "latitude", "longitude", "location",
]

RAW_INCIDENT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_INCIDENT_FIELDS])

# Identifier-like columns removed before modelling.
IDENTIFIER_COLUMNS = ["id", "case_number", "date", "block", "iucr", "fbi_code",
                      "updated_on", "primary_type", "description", "location"]


class MissingColumnsError(ValueError):
    """Raised when a transform is applied to a frame lacking required columns (``columns``)."""

    def __init__(self, message: str, columns: Iterable[str] = ()):
        super().__init__(message)
        self.columns = list(columns)


def require_columns(df: DataFrame, required: Iterable[str], where: str = "") -> None:
    """Fail at plan-build time if any required column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        suffix = f" for {where}" if where else ""
        raise MissingColumnsError(f"Missing required columns{suffix}: {missing}", missing)

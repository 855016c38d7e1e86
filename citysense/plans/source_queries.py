"""Registered queries: sources and sinks.

The sink queries write under the session's shared checkpoint folder (a fresh
sub-folder per call), read the result back and return it, so the driver's
row check covers the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prepare as PR
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import writers as WR
from . import fixtures as fx
from .evaluate_queries import _report_sql
from .registry import register
from .sqlviews import with_views


def _raw(spark, sf):
    """Incidents as raw text records, as the API/CSV landing delivers them."""
    inc = fx.incidents(spark, sf)
    return inc.select(*[F.col(c).cast("string").alias(c) for c in inc.columns])


def _text_schema(cols):
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


_ROWS_SQL = (with_views("incidents") + "select id, case_number, date, primary_type, description, arrest, "
             "round(latitude, 6) + 0.0 as latitude, round(longitude, 6) + 0.0 as longitude, location_description, "
             "cast(district as bigint) as district, cast(community_area as bigint) as community_area from incidents")


def _typed(spark, sf, text):
    """Text records with the types of the incidents again."""
    types = dict(fx.incidents(spark, sf).dtypes)
    return text.select(*[F.col(c).cast(types[c]).alias(c) for c in text.columns])


@register("a1_read_csv", _ROWS_SQL)
def a1_read_csv(spark, sf):
    raw = _raw(spark, sf)
    path = _scratch(spark, "a1")
    raw.write.mode("overwrite").option("header", True).csv(path)
    return _typed(spark, sf, RD.read_incident_csv(spark, path, _text_schema(raw.columns)))


@register("a2_latest_snapshot", _ROWS_SQL)
def a2_latest_snapshot(spark, sf):
    raw = _raw(spark, sf)
    path = _scratch(spark, "a2")
    # an older snapshot (arrests only), then the newer full one, each in as many parts as it has
    for name, rows in (("incidents-1", raw.where(F.col("arrest") == "true")), ("incidents-2", raw)):
        rows.write.option("header", True).csv(f"{path}/{name}")
    return _typed(spark, sf, RD.read_latest_snapshot(spark, path, "csv", _text_schema(raw.columns)))


@register("a3_read_json", _ROWS_SQL)
def a3_read_json(spark, sf):
    raw = _raw(spark, sf)
    path = _scratch(spark, "a3")
    raw.write.mode("overwrite").json(path)
    return _typed(spark, sf, RD.read_incident_json(spark, path, _text_schema(raw.columns)))


@register("a4_source_query", with_views("incidents") + "select id, case_number, date, description from incidents "
          "where primary_type = 'THEFT' and (contains(description, 'POCKET-PICKING') or "
          "contains(description, 'PURSE-SNATCHING')) order by date desc, id limit 5000")
def a4_source_query(spark, sf):
    return RD.source_query(fx.incidents(spark, sf), 5000).select("id", "case_number", "date", "description")


@register("a5_write_snapshot", with_views("incidents") + "select id, case_number, date, primary_type, description, "
          "arrest, round(latitude, 6) + 0.0 as latitude, round(longitude, 6) + 0.0 as longitude, location_description, "
          "cast(district as bigint) as district, cast(community_area as bigint) as community_area from incidents "
          "where latitude is not null and longitude is not null")
def a5_write_snapshot(spark, sf):
    path = _scratch(spark, "a5")
    WR.write_raw_snapshot(fx.incidents(spark, sf), path, fmt="parquet")
    return spark.read.parquet(path)


def _a6_sql() -> str:
    from .feature_queries import _C11_SQL, _E1_SQL, _E2_SQL, _E3_SPATIAL
    return (with_views("incidents") + "select id, case_number, date, primary_type, description, arrest, "
            "round(latitude, 6) + 0.0 as latitude, round(longitude, 6) + 0.0 as longitude, location_description, "
            "cast(district as bigint) as district, cast(community_area as bigint) as community_area, "
            f"{_C11_SQL}, {_E3_SPATIAL}, {_E1_SQL}, {_E2_SQL} from incidents "
            "where latitude is not null and longitude is not null")


@register("a6_write_features", _a6_sql())
def a6_write_features(spark, sf):
    from ..operators.features import create_all_features
    path = _scratch(spark, "a6")
    WR.write_features(create_all_features(fx.incidents(spark, sf)), path, "year")
    return spark.read.parquet(path)


@register("a7_write_report", _report_sql())
def a7_write_report(spark, sf):
    from ..operators.evaluate import class_report
    path = _scratch(spark, "a7")
    WR.write_report(class_report(fx.scored(spark, sf)), path)
    kinds = "class string, precision double, recall double, f1_score double, support long"
    return spark.read.schema(kinds).option("header", True).csv(path)


@register("a8_persist_splits", with_views("scored") + "select id, cast(label as bigint) as label, round(score, 6) as score, "
          "cast(pred as bigint) as pred, cast(hour as bigint) as hour, cast(district as bigint) as district, "
          "'test' as split from scored where substr(md5('42:' || cast(id as varchar)), 1, 8) < '33333333'")
def a8_persist_splits(spark, sf):
    path = _scratch(spark, "a8")
    WR.write_splits(PR.random_split(fx.scored(spark, sf), "id", 0.2, 42), path)
    return WR.read_splits(spark, path, "test")

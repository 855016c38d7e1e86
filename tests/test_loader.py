"""The reference's loader test: CSV round trip (FIXTURES A1), plus the newest-snapshot reader."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from citysense.sources import readers as RD
from citysense.sources import writers as WR

ROWS = [("1", "HZ123456", "2023-01-01", "THEFT", "POCKET-PICKING", "true"),
        ("2", "HZ123457", "2023-01-02", "THEFT", "PURSE-SNATCHING", "false"),
        ("3", "HZ123458", "2023-01-03", "THEFT", "POCKET-PICKING", "true")]
SCHEMA = "id string, case_number string, date string, primary_type string, description string, arrest string"


def test_csv_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="cs-test-"), "raw")
    WR.write_report(df, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])
    back = RD.read_incident_csv(spark, path, schema).orderBy("id").collect()
    assert len(back) == 3 and back[1].case_number == "HZ123457"


def test_latest_snapshot_is_read_whole(spark):
    """1,000 rows in four part files, written by the snapshot sink after an older snapshot."""
    base = tempfile.mkdtemp(prefix="cs-test-")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "latitude", "longitude")])
    rows = spark.range(1000).selectExpr("cast(id as string) id", "'41.8' latitude", "'-87.7' longitude").repartition(4)
    WR.write_raw_snapshot(rows.limit(10), f"{base}/snapshot-1")
    WR.write_raw_snapshot(rows, f"{base}/snapshot-2")
    assert RD.read_latest_snapshot(spark, base, "csv", schema).count() == 1000
    one = f"{base}/snapshot-3.csv"
    with open(one, "w") as f:
        f.write("id,latitude,longitude\n1,2,3\n")
    assert [tuple(r) for r in RD.read_latest_snapshot(spark, base, "csv", schema).collect()] == [("1", "2", "3")]


def test_latest_snapshot_with_partition_folders(spark):
    base = tempfile.mkdtemp(prefix="cs-test-")
    df = spark.range(100).selectExpr("id", "id % 3 as year", "id % 2 as half")
    df.write.partitionBy("year", "half").parquet(f"{base}/features")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "year", "half")])
    assert RD.read_latest_snapshot(spark, base, "parquet", schema).count() == 100


def test_reports_are_bounded(spark):
    with pytest.raises(ValueError):
        WR.write_report(spark.range(WR.MOST_REPORT_ROWS + 1), os.path.join(tempfile.mkdtemp(prefix="cs-test-"), "report"))


def test_source_query_filters_and_orders(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1 + i), "THEFT" if i % 2 else "BATTERY",
             "POCKET-PICKING" if i % 3 else "SIMPLE") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, date timestamp_ntz, primary_type string, description string")
    out = RD.source_query(df, 3).collect()
    assert [r.id for r in out] == [11, 7, 5]

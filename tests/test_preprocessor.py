"""The reference's preprocessor tests, on the same 5-row frame (FIXTURES A2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citysense.operators import clean as CL
from citysense.operators import prepare as PR
from citysense.operators import timeseries as TS
from citysense.schema import MissingColumnsError, require_columns

ROWS = [
    ("1", "HZ123456", dt.datetime(2023, 1, 1), "THEFT", "POCKET-PICKING", "true", 41.8781, -87.6298, "STREET"),
    ("2", "HZ123457", dt.datetime(2023, 1, 2), "THEFT", "PURSE-SNATCHING", "false", 41.8782, -87.6299, "CTA PLATFORM"),
    ("3", "HZ123458", dt.datetime(2023, 1, 3), "THEFT", "POCKET-PICKING", "true", 41.8783, -87.6300, "RESIDENCE"),
    ("4", "HZ123459", dt.datetime(2023, 1, 4), "THEFT", "PURSE-SNATCHING", "false", 41.8784, -87.6301, "RESTAURANT"),
    ("5", "HZ123460", dt.datetime(2023, 1, 5), "THEFT", "POCKET-PICKING", "true", float("nan"), float("nan"), "GROCERY"),
]
SCHEMA = ("id string, case_number string, date timestamp_ntz, primary_type string, description string, "
          "arrest string, latitude double, longitude double, location_description string")


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_drop_missing_coordinates_keeps_four(frame):
    assert CL.drop_missing_coordinates(frame).count() == 4


def test_classification_preparation(frame):
    out, _ = PR.preprocess_classification(frame, test_frac=0.4)
    rows = out.collect()
    assert len(rows) == 4
    assert {r.label for r in rows} <= {0, 1}
    widths = {len(r.features) for r in rows}
    assert len(widths) == 1 and widths.pop() > 0
    assert {r.split for r in rows} <= {"train", "test"}


def test_daily_series_and_sequences(frame):
    counts = TS.resample_counts(frame, "D")
    assert counts.count() == 5
    seq = TS.sliding_sequences(counts, 2)
    rows = seq.orderBy("period_end").collect()
    assert len(rows) == 3 and all(len(r.x) == 2 for r in rows)
    assert rows[0].x == [1.0, 1.0] and rows[0].y == 1.0


def test_gap_filled_weekly_monthly(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 2),), (dt.date(2023, 1, 3),), (dt.date(2023, 3, 30),)], "date date")
    weekly = TS.resample_counts(df, "W").orderBy("period_end").collect()
    assert weekly[0].period_end == dt.date(2023, 1, 8) and weekly[0].n == 2
    assert weekly[-1].period_end == dt.date(2023, 4, 2)
    assert sum(r.n for r in weekly) == 3 and len(weekly) == 13
    monthly = TS.resample_counts(df, "M").orderBy("period_end").collect()
    assert [(r.period_end, r.n) for r in monthly] == [(dt.date(2023, 1, 31), 2), (dt.date(2023, 2, 28), 0),
                                                       (dt.date(2023, 3, 31), 1)]


def test_required_columns_raise(frame):
    with pytest.raises(MissingColumnsError):
        require_columns(frame, ["latitude", "nope"])


def test_align_and_common_columns(frame):
    a = CL.align_to(frame, ["latitude", "beat"])
    assert a.columns == ["latitude", "beat"] and a.where(F.col("beat") != 0).count() == 0
    l, r = CL.common_columns(frame, frame.select("latitude", "id"))
    assert l.columns == ["id", "latitude"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("nan", 1.0), ("41.8", float("nan")), ("41.8", 1.0), ("x", 1.0), (None, None)], "latitude string, longitude double")
    out = CL.coerce_numeric(df, ["latitude", "longitude"])
    assert [tuple(r) for r in out.collect()] == [(None, 1.0), (41.8, None), (41.8, 1.0), (None, 1.0), (None, None)]
    assert CL.drop_missing_coordinates(out).count() == 1


def test_a_million_levels(spark):
    """Levels are numbered and joined in Spark: sparse vectors of a million slots, no level on the driver."""
    from pyspark.ml.functions import vector_to_array
    n = 1_000_000
    train = spark.range(n).select(F.format_string("level %07d", F.col("id")).alias("c"))
    enc = PR.fit_one_hot_drop_first(train, ["c"])
    assert enc.sizes == {"c": n} and enc.names == {}
    rows = spark.createDataFrame([("level 0000000",), ("level 0000001",), ("level 0999999",), ("unseen",), (None,)], "c string")
    got = {r.c: r.c_ohe for r in enc.transform(rows).collect()}
    assert {k: (v.size, v.indices.tolist(), v.values.tolist()) for k, v in got.items()} == {
        "level 0000000": (n - 1, [], []), "level 0000001": (n - 1, [0], [1.0]), "level 0999999": (n - 1, [n - 2], [1.0]),
        "unseen": (n - 1, [], []), None: (n - 1, [], [])}
    few = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "c string, d string")
    out = PR.fit_one_hot_drop_first(few, ["c", "d"]).transform(few).select("c", vector_to_array("c_ohe").alias("v"), vector_to_array("d_ohe").alias("w"))
    assert {r.c: (r.v, r.w) for r in out.collect()} == {"a": ([0.0], []), "b": ([1.0], []), None: ([0.0], [])}
    kept = PR.fit_one_hot_all_levels(few, ["c"]).transform(few).select("c", vector_to_array("c_ohe").alias("v"))
    assert {r.c: r.v for r in kept.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], None: [0.0, 0.0]}

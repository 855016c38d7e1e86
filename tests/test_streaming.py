"""Streaming cell counts over landed files equal the batch operator."""

import os
import tempfile

from pyspark.sql import functions as F

from citysense.operators import spatial as S
from citysense.plans import fixtures as fx
from citysense.streaming.grid_counts import current_counts, labels_from_counts, start_cell_counts
from conftest import SMOKE_DIR


def test_stream_counts_match_batch(spark):
    inc = fx.incidents(spark, SMOKE_DIR).select("id", "latitude", "longitude")
    land = os.path.join(tempfile.mkdtemp(prefix="cs-land-"), "in")
    # two landings, as snapshot files arriving over time
    inc.where(F.col("id") % 2 == 0).write.parquet(f"{land}/part1")
    inc.where(F.col("id") % 2 == 1).write.parquet(f"{land}/part2")
    ckpt = os.path.join(tempfile.mkdtemp(prefix="cs-ckpt-"), "c")
    q = start_cell_counts(spark, f"{land}/*", inc.schema, "parquet", "cs_counts_test", ckpt)
    try:
        q.processAllAvailable()
        got = {r.cell: r.n for r in spark.table("cs_counts_test").collect()}
    finally:
        q.stop()
    want = {r.cell: r.n for r in S.cell_counts(S.assign_cells(inc)).collect()}
    assert got == want
    labels = labels_from_counts(spark, spark.createDataFrame(list(got.items()), "cell int, n long"))
    batch = S.area_safety(fx.incidents(spark, SMOKE_DIR))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, batch.collect()))


def test_published_counts_switch_whole(spark, tmp_path):
    """Every trigger leaves a version of its own; the newest one named holds the counts of all files so far."""
    inc = fx.incidents(spark, SMOKE_DIR).select("id", "latitude", "longitude")
    inc.where(F.col("id") % 2 == 0).write.parquet(f"{tmp_path}/in/part1")
    q = start_cell_counts(spark, f"{tmp_path}/in/*", inc.schema, "parquet", "cs_counts_published", f"{tmp_path}/ckpt", output=f"{tmp_path}/out")
    try:
        for k, part in enumerate((inc.where(F.col("id") % 2 == 0), inc)):
            q.processAllAvailable()
            want = {r.cell: r.n for r in S.cell_counts(S.assign_cells(part)).collect()}
            assert {r.cell: r.n for r in current_counts(spark, f"{tmp_path}/out").collect()} == want
            if not k:
                inc.where(F.col("id") % 2 == 1).write.parquet(f"{tmp_path}/in/part2")
    finally:
        q.stop()
    assert os.path.isdir(f"{tmp_path}/out/version-0")

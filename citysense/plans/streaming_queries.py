"""Registered query: the grid counts kept by a stream over landed snapshot files.

The incidents are landed as two snapshot files (odd and even ids) under the
shared checkpoint folder, the incremental count query runs until all files
are processed, and the labels (D7) are computed from the streamed counts.
They must equal the batch labels, so the oracle is D7's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..streaming.grid_counts import labels_from_counts, start_cell_counts
from . import fixtures as fx
from .registry import register
from .spatial_queries import ORACLES_D7


@register("d6_stream_labels", ORACLES_D7)
def d6_stream_labels(spark, sf):
    pts = fx.incidents(spark, sf).select("id", "latitude", "longitude")
    run = uuid.uuid4().hex
    land = scratch_path(spark, f"landing-{run}")
    pts.where(F.col("id") % 2 == 0).write.parquet(f"{land}/batch1")
    pts.where(F.col("id") % 2 == 1).write.parquet(f"{land}/batch2")
    name = f"cell_counts_{run}"
    q = start_cell_counts(spark, f"{land}/*", pts.schema, "parquet", name, scratch_path(spark, f"stream-{run}"))
    try:
        q.processAllAvailable()
        counts = materialize(spark.table(name))
    finally:
        q.stop()
    return labels_from_counts(spark, counts)

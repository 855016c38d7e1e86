"""The grid operators on a file stream of landed incident snapshots.

The reference has no streaming; it re-reads the newest snapshot file (A2).
When snapshot files keep landing in a folder, the Spark way is to read that
folder as a stream and keep the per-cell counts (D4 + D6) up to date
incrementally instead of rescanning history. The same column expressions are
used as in the batch operators; labels (D7) are then a batch step over the
<= n_cells-row counts table.

State is one row per occupied cell (bounded by the grid), kept by Structured
Streaming in the checkpoint location, so a restarted query resumes where it
stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import DEFAULT_GRID, Grid
from ..operators.spatial import area_safety_labels
from ..session import scratch_path


def cell_count_stream(stream: DataFrame, grid: Grid = DEFAULT_GRID, lat: str = "latitude",
                      lon: str = "longitude") -> DataFrame:
    """Running ``(cell, n)`` over a streaming DataFrame of incidents (coordinates coerced to double)."""
    la, lo = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    pts = stream.where(la.isNotNull() & lo.isNotNull()).select(grid.cell(la, lo).alias("cell"))
    return pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def start_cell_counts(spark: SparkSession, landing: str, schema: T.StructType, fmt: str = "parquet",
                      query_name: str = "cell_counts", checkpoint: str | None = None,
                      grid: Grid = DEFAULT_GRID, output: str | None = None, options: dict | None = None):
    """Start the incremental count query over files landing in ``landing``.

    Without ``output`` the counts (at most ``n_cells`` rows) are the temp view
    ``query_name`` (tests, notebooks); with it every trigger writes the complete
    counts as a new version below that path, and only then names it as the current
    one (see :func:`current_counts`), so a reader never meets a missing table.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    counts = cell_count_stream(reader.load(landing), grid)
    ckpt = checkpoint or scratch_path(spark, f"stream-{query_name}")
    w = counts.writeStream.outputMode("complete").option("checkpointLocation", ckpt).queryName(query_name)
    if output is None:
        return w.format("memory").start()

    def publish(batch: DataFrame, number: int) -> None:
        # a trigger that is run again writes the same version again
        batch.write.mode("overwrite").parquet(f"{output}/version-{number}")
        batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{output}/current")

    return w.foreachBatch(publish).start()


def current_counts(spark: SparkSession, output: str) -> DataFrame:
    """The counts of the newest finished trigger of a query with ``output``."""
    newest = spark.read.schema("version long").parquet(f"{output}/current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{output}/version-{newest}")


def labels_from_counts(spark: SparkSession, counts: DataFrame, grid: Grid = DEFAULT_GRID,
                       percentile: float = 75.0) -> DataFrame:
    """D6 + D7 over a (static) snapshot of the streaming counts."""
    dense = spark.range(grid.n_cells).select(F.col("id").cast("int").alias("cell"))
    dense = dense.join(F.broadcast(counts), "cell", "left").select(
        "cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return area_safety_labels(dense, percentile)

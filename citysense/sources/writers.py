"""Writers (A5-A8). Model persistence (A9) is in ``operators.models``.

Targets are paths on the shared file system the cluster uses (HDFS, S3, ...);
every write is an overwrite of a whole directory, so a retried job replaces a
half-written one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import drop_missing_coordinates

MOST_REPORT_ROWS = 100_000


def write_raw_snapshot(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """A5: drop rows without coordinates and write the snapshot; returns the filtered frame."""
    kept = drop_missing_coordinates(df)
    w = kept.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return kept


def write_features(df: DataFrame, path: str, partition_by: str | None = "year") -> None:
    """Engineered dataset as Parquet, partitioned (by year by default) for pruning."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header; a frame of more than a report's rows raises."""
    if df.limit(MOST_REPORT_ROWS + 1).count() > MOST_REPORT_ROWS:
        raise ValueError(f"a report has at most {MOST_REPORT_ROWS} rows; write larger frames with write_raw_snapshot")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Prepared train/test rows in one Parquet dataset partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read back all rows or one split (partition-pruned)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df

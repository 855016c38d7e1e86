"""Small helpers on frames and the shared folder, for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, scratch_path

__all__ = ["fresh_name", "materialize", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for files that executors exchange; it is removed when
    the session's JVM ends."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def fresh_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or that with underscores, so that it clashes with no column (in any case)."""
    used = {x.lower() for x in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted

"""Readers (A1-A4): CSV and JSON landings, newest snapshot, the source query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW_INCIDENT_SCHEMA

# Fixed values that must equal the reference's source query.
SOURCE_PRIMARY_TYPE = "THEFT"
SOURCE_DESCRIPTIONS = ["POCKET-PICKING", "PURSE-SNATCHING"]
DEFAULT_SOURCE_LIMIT = 70_000


def read_incident_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A1: CSV with a header under an explicit schema (no inference pass over the data).

    Malformed rows raise (``mode=FAILFAST``) instead of being dropped silently.
    """
    return (spark.read.schema(schema or RAW_INCIDENT_SCHEMA).option("header", True)
                 .option("mode", "FAILFAST").csv(path))


def read_incident_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A3: JSON records as landed from the open-data API (all fields text)."""
    return spark.read.schema(schema or RAW_INCIDENT_SCHEMA).option("mode", "FAILFAST").json(path)


def read_latest_snapshot(spark: SparkSession, path: str, fmt: str = "csv",
                         schema: T.StructType | None = None) -> DataFrame:
    """A2: all rows of the most recently written snapshot under ``path``.

    A snapshot is a file, or a folder of part files (with or without partition
    folders) as a Spark job writes it. The files are listed with the
    ``binaryFile`` source (its ``content`` column is pruned, so only metadata is
    read); the snapshot with the newest file is picked as one scalar (ties
    broken by the larger name, since names carry a timestamp) and read whole.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                    .select("path", "modificationTime"))
    folder = F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "(/[^/=]+=[^/]*)+$", "")
    snapshot = F.when(F.regexp_extract("path", "[^/]*$", 0).startswith("part-"), folder).otherwise(F.col("path"))
    newest = listing.select(F.max(F.struct("modificationTime", snapshot.alias("p"))).alias("n")).first().n
    if newest is None:
        raise FileNotFoundError(f"no snapshot files under {path}")
    reader = spark.read.schema(schema or RAW_INCIDENT_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(newest.p)


def source_query(df: DataFrame, limit: int | None = DEFAULT_SOURCE_LIMIT, date_col: str = "date",
                 id_col: str = "id") -> DataFrame:
    """A4: thefts whose description mentions pocket-picking or purse-snatching, newest first.

    The filter is a plain predicate (pushed to Parquet as far as it can be);
    order + limit plan as TakeOrderedAndProject (top-k per partition, then merge).
    """
    cond = F.lit(False)
    for d in SOURCE_DESCRIPTIONS:
        cond = cond | F.col("description").contains(d)
    out = df.where((F.col("primary_type") == SOURCE_PRIMARY_TYPE) & cond)
    out = out.orderBy(F.desc(date_col), F.asc(id_col))
    return out.limit(limit) if limit else out

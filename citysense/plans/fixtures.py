"""Incident-shaped views over the driver's tables (FIXTURES.md part B).

The driver tables carry no coordinates, arrests or locations, so these views
derive them deterministically from ``events`` and ``orders``. They are plain
lazy DataFrames: every operator downstream reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents_from_events(events: DataFrame) -> DataFrame:
    """B1 ``incidents``: one incident per event.

    Built from the FIXTURES.md select list in one ``selectExpr`` (one JVM call
    instead of hundreds of Column constructions).
    """
    return events.selectExpr(*INCIDENT_EXPRS)


# The select list of FIXTURES.md B1, expression by expression.
INCIDENT_EXPRS = [
    "event_id as id",
    "concat('HZ', lpad(cast(event_id as string), 6, '0')) as case_number",
    "ts as date",
    "case event_type when 'error' then 'BATTERY' else 'THEFT' end as primary_type",
    "case event_type when 'click' then 'POCKET-PICKING' when 'view' then 'ATTEMPT POCKET-PICKING' "
    "when 'purchase' then 'PURSE-SNATCHING' when 'signup' then 'FROM BUILDING' else 'SIMPLE' end as description",
    "case when value >= 150 then 'true' else 'false' end as arrest",
    "case when event_id % 97 = 0 then null else cast(41.6 as double) + cast((user_id * 37) % 400 as double) / 1000 "
    "+ cast(event_id % 10 as double) / 10000 end as latitude",
    "case when event_id % 97 = 0 then null else cast(-87.9 as double) + cast((user_id * 53) % 400 as double) / 1000 "
    "+ cast(event_id % 7 as double) / 10000 end as longitude",
    "case event_id % 11 when 0 then 'STREET' when 1 then 'CTA PLATFORM' when 2 then 'RESIDENCE' when 3 then 'RESTAURANT' "
    "when 4 then 'GROCERY' when 5 then 'CTA BUS' when 6 then 'SIDEWALK' when 7 then 'APARTMENT' "
    "when 8 then 'BAR OR TAVERN' when 9 then 'WAREHOUSE' else null end as location_description",
    "cast(1 + user_id % 25 as int) as district",
    "cast(1 + user_id % 77 as int) as community_area",
]


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_events(read_table(spark, sf_dir, "events"))


def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 ``incident_log``: multi-year dated records in five series, one for each order."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("series"),
                                                      F.col("o_orderdate").cast("date").alias("date"))


def gapped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incident_log`` with empty Julys in one series: the gaps that resampling (H1) must fill."""
    return incident_log(spark, sf_dir).where(~((F.col("series") == "1-URGENT") & (F.month("date") == 7)))


def scored_from_incidents(inc: DataFrame) -> DataFrame:
    """B3 ``scored``: labels and deterministic scores with many ties."""
    label = F.when(F.col("arrest") == "true", 1).otherwise(0)
    score = ((F.col("id") * 7919) % 1000 + F.when(F.col("arrest") == "true", 300).otherwise(0)).cast("double") / 1300
    t = inc.select("id", label.alias("label"), score.alias("score"),
                   F.hour("date").cast("int").alias("hour"), "district")
    return t.select("id", "label", "score", F.when(F.col("score") > 0.2, 1).otherwise(0).alias("pred"),
                    "hour", "district")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from_incidents(incidents(spark, sf_dir))


def forecasts_from_log(log: DataFrame) -> DataFrame:
    """B4 ``forecasts``: two naive models (last week, four weeks back) over weekly counts."""
    w = (log.groupBy("series", F.date_add(F.date_trunc("week", "date").cast("date"), 6).alias("period_end"))
            .agg(F.count(F.lit(1)).alias("n")))
    win = Window.partitionBy("series").orderBy("period_end")
    p = w.select("series", "period_end", F.col("n").cast("double").alias("actual"),
                 F.lag("n", 1).over(win).cast("double").alias("p1"),
                 F.lag("n", 4).over(win).cast("double").alias("p4"))
    a = p.where(F.col("p1").isNotNull()).select(F.lit("lag1").alias("model"), "series", "period_end", "actual",
                                                F.col("p1").alias("predicted"))
    b = p.where(F.col("p4").isNotNull()).select(F.lit("lag4").alias("model"), "series", "period_end", "actual",
                                                F.col("p4").alias("predicted"))
    return a.unionByName(b)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts_from_log(incident_log(spark, sf_dir))

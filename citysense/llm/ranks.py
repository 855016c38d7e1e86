"""Places of rows in the order of their group, for groups of any size.

The rows (without texts) are written, range-partitioned by group, order and a
row number, and written again. Each range partition counts its rows by group;
the counts of the partitions before give a row's offset. A group that holds a
third of all rows so lies in a third of the partitions, and equal rows are split
by their row numbers. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import fresh_name, materialize


def ranked(rows: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], position: str = "position",
           size: str = "size", partitions: int | None = None) -> DataFrame:
    """The rows with their place in their group (from 0) and the group's number of rows. Nulls are values and
    come first; rows that are equal in group and order columns are placed among themselves as it comes."""
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = [*rows.columns, position, size]
    row, part = fresh_name("row", taken), fresh_name("part", [*taken, "row"])
    g, order = list(group_cols), [*order_cols, row]
    numbered = materialize(rows.withColumn(row, F.monotonically_increasing_id()))
    ordered = materialize(numbered.repartitionByRange(partitions, *g, *order).withColumn(part, F.spark_partition_id()))
    counts = ordered.groupBy(part, *g).agg(F.count(F.lit(1)).alias("n"))
    # at most one row for each group and range partition
    before = Window.partitionBy(*g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias("of_part"), *[F.col(c).alias(f"of_{i}") for i, c in enumerate(g)],
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("so_far"), F.sum("n").over(Window.partitionBy(*g)).alias("all"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{i}")) for i, c in enumerate(g)], F.col(part) == F.col("of_part"))
    inside = F.row_number().over(Window.partitionBy(part, *g).orderBy(*order))
    placed = ordered.withColumn(position, inside).join(offsets, same)
    return placed.select(*rows.columns, (F.col("so_far") + F.col(position) - 1).alias(position), F.col("all").alias(size))

"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step joins the edges with one row for each node (its least neighbour), so a
hub that holds a third of the edges is pre-aggregated map-side and its edges are
split by adaptive skew joins. Every round is written to the shared checkpoint
folder; edges never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's least node itself, which is the root.

    Nulls and loops are no edges; repeated edges count once; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    before = None
    while (state := _digest(now)) != before:
        before = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_least(both), F.col("a") == F.col("node")).where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct())
        small = large.join(_least(large), F.col("a") == F.col("node"))
        # a points at the least neighbour, and so do its other smaller neighbours
        moved = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")),
                                               F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        now = materialize(moved.select("e.a", "e.b").where("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

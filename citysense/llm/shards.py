"""Operator 7 [native]: contiguous shards of equal size from global prefix sums.

Documents get one global order. Each range partition of that order sums its
bytes; the sums of the partitions (one row each) are added up in order; a
document's global prefix is its partition's offset plus the running sum inside
its partition. The axis of all bytes is cut at equal targets, so every shard is
a contiguous run of the order and no shard is off its target by more than one
document. Everything is built-in DataFrame functions.

Only (id, size, checksum, order key) rows are shuffled, never texts. The order
is by a hash of the text, then the id, then a row number: copies of one text are
neighbours and so share a shard unless a cut falls among them, and id and row
number split a text, or a row, that makes up a third of the table over many
range partitions. The order is written
to the shared checkpoint folder before it is read twice, so a lost executor
can't change it.

Broadcast are the partition totals (one row for each range partition, a number
the caller sets) and the first position of each shard (``shards`` rows).

Defined results: a null text has size ``overhead`` and the checksum of no
bytes; a null id sorts first; repeated rows are separate documents next to each
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                overhead: int = 8, partitions: int | None = None) -> DataFrame:
    """Columns: the id, ``size``, ``text_crc32``, ``shard`` (0 on), ``slot`` (place in the
    shard, gapless from 0) and ``prefix`` (bytes before the document in the global order).

    ``size`` is the UTF-8 length of the text plus ``overhead``.
    """
    if shards < 1:
        raise ValueError(f"shards must be 1 or more, got {shards}")
    if overhead < 1:
        raise ValueError("overhead must be 1 or more: the cuts need documents of some size")
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # written before the range partitioner samples it, so that the texts are read once
    measured = materialize(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ))
    ordered = materialize(measured.repartitionByRange(partitions, "key", "id", "row")
                          .withColumn("part", F.spark_partition_id()))

    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(so_far), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(so_far), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))

    inside = Window.partitionBy("part").orderBy("key", "id", "row")
    placed = (ordered.join(F.broadcast(offsets), "part")
              .withColumn("prefix", F.col("bytes_before") - F.col("size")
                          + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("position", F.col("rows_before") + F.row_number().over(inside) - 1)
              # a document belongs to the shard in which its middle byte lies; decimals keep the product exact
              .withColumn("shard", F.floor((F.col("prefix") * 2 + F.col("size")).cast("decimal(24,0)") * shards
                                           / (F.col("all_bytes").cast("decimal(24,0)") * 2)).cast("int")))
    placed = materialize(placed.select("id", "size", "crc", "shard", "position", "prefix"))
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), "prefix")

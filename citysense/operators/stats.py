"""Distributed ordered statistics: prefix sums over a sort key and exact quantiles.

A cumulative sum over a global order is, written naively, a window without a
partition key: one task sees every row. Here the order key is cut into
``buckets`` ranges at approximate quantiles, bucket totals are prefix-summed
over at most ``buckets`` rows a partition, and the exact cumulative sum
inside each bucket is a window partitioned by bucket. Every task holds about
``rows / buckets`` rows; results are exact because the bucket function is
monotone in the key (equal keys share a bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def default_buckets(df: DataFrame) -> int:
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001
        n = 200
    return max(16, 4 * n)


def ordered_prefix(df: DataFrame, order_col: str, measures: Sequence[str], partition_cols: Sequence[str] = (),
                   buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``<m>_upto``: sum of ``m`` over rows with key <= this row's key (same partition),
    and ``<m>_total``: the partition's sum.

    Input rows must be unique on ``(partition_cols, order_col)`` (pre-aggregate
    first); then ``<m>_upto - m`` is the strictly-smaller sum. ``bucket`` may
    supply a monotone bucket expression (e.g. for uniform hashes); otherwise it
    comes from approximate quantiles of the key.
    """
    p = list(partition_cols)
    key = F.col(order_col)
    if bucket is None:
        buckets = buckets or default_buckets(df)
        df, bucket = _bucketed(df, order_col, buckets)
    b = df.withColumn("_bucket", F.coalesce(bucket.cast("long"), F.lit(-1)))
    totals = b.groupBy(*p, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    wb = Window.partitionBy(*p).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*p)
    # one row per (partition, bucket); NULL partition values are a partition of their own
    offsets = totals.select(*[F.col(c).alias(f"_p_{c}") for c in p], F.col("_bucket").alias("_p__bucket"),
                            *[F.coalesce(F.sum(f"_t_{m}").over(wb), F.lit(0)).alias(f"_o_{m}") for m in measures],
                            *[F.sum(f"_t_{m}").over(wall).alias(f"{m}_total") for m in measures])
    same = F.lit(True)
    for c in [*p, "_bucket"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    # without partition columns there are at most `buckets` offsets
    joined = attach(b, offsets, same) if p else b.join(F.broadcast(offsets), same)
    w = Window.partitionBy(*p, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({f"{m}_upto": F.col(f"_o_{m}") + F.sum(m).over(w) for m in measures}).drop(
        "_bucket", "_key", *[f"_p_{c}" for c in [*p, "_bucket"]], *[f"_o_{m}" for m in measures])


def _bucketed(df: DataFrame, order_col: str, buckets: int) -> tuple[DataFrame, Column]:
    """Buckets at approximate quantiles, found by binary search in the JVM (``Bucketizer``). The bounds are
    ``buckets`` numbers, whatever the size of the table; as doubles they are monotone in any numeric key."""
    keyed = df.withColumn("_key", F.col(order_col).cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    found = keyed.where(~F.isnan("_key")).select(F.percentile_approx("_key", probs, 10000)).first()[0] or []
    inner = sorted({b for b in found if b not in (float("inf"), float("-inf"))})
    if not inner:
        return keyed, F.lit(0)
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_key", outputCol="_cut", handleInvalid="keep")
    return cut.transform(keyed).withColumn("_key", F.col("_cut")).drop("_cut"), F.col("_key")


#: Hashes of one prefix that are sorted in one task; a longer list is counted by longer prefixes first.
MOST_SORTED = 100_000


def hash_cutoffs(df: DataFrame, hash_: Column, take: Column, group_cols: Sequence[str], digits: int = 4,
                 most: int = MOST_SORTED) -> DataFrame:
    """For each group the least hash text below or at which ``take`` of its rows lie: ``(group, rows, take, cut)``.

    ``take`` may use ``rows``, the group's size; where it is 0 or less, ``cut`` is NULL. Rows with equal
    hashes lie on the same side. Rows are counted by the leading hex digits of their hash, which leaves
    one prefix with the cut; while that of any group holds more than ``most`` rows, they are counted by
    ``digits`` more digits inside it. A count has at most ``16 ** digits`` rows for each group, and no
    row is shuffled. Equal hashes beyond the last digit are one hash.
    """
    g = list(group_cols) or ["_all"]
    keyed = df.withColumn("_all", F.lit(0)).select(*g, hash_.alias("_h"))
    state, groups, length = None, None, 0
    while state is None or (longest > most and length < 32):
        length += digits
        rows = keyed if state is None else _inside(keyed, state, g, groups)
        counts = rows.groupBy(*g, F.substring("_h", 1, length).alias("_prefix")).agg(F.count(F.lit(1)).alias("_c"))
        whole = F.sum("_c").over(Window.partitionBy(*g))
        if state is None:
            sized = counts.withColumn("rows", whole).withColumn("take", take.cast("long")).withColumn("_left", F.col("take"))
        else:
            sized = _joined(counts, state.select(*g, "rows", "take", "_left"), g, groups)
        upto = sized.withColumn("_upto", F.sum("_c").over(
            Window.partitionBy(*g).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        # the prefix with the cut; for a take of 0 the first one, for one beyond the rows the last
        upto = upto.withColumn("_wanted", F.least(F.greatest(F.col("_left"), F.lit(1)), whole))
        at = upto.where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_c") < F.col("_wanted")))
        state = materialize(at.select(*g, "rows", "take", (F.col("_wanted") - (F.col("_upto") - F.col("_c"))).alias("_left"), "_prefix", "_c"))
        groups, longest = state.agg(F.count(F.lit(1)), F.coalesce(F.max("_c"), F.lit(0))).first()
    # where a prefix is a whole hash it is the cut, however many rows share it
    listed = F.collect_set("_h") if length >= 32 else F.collect_list("_h")
    ends = _inside(keyed, state, g, groups).groupBy(*g).agg(F.sort_array(listed).alias("_hs"))
    out = _joined(ends, state, g, groups)
    place = F.least(F.col("_left"), F.size("_hs")).cast("int")
    return materialize(out.select(*g, "rows", "take", F.when(F.col("take") > 0, F.element_at("_hs", place)).alias("cut")))


def _joined(rows: DataFrame, table: DataFrame, g: list[str], groups: int) -> DataFrame:
    """Rows with the columns of a table of one row for each of so many groups; NULL groups match."""
    named = table.select(*[F.col(c).alias(f"_g_{c}") for c in g], *[c for c in table.columns if c not in g])
    same = F.lit(True)
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(F.broadcast(named) if groups <= MOST_BROADCAST_ROWS else named, same).drop(*[f"_g_{c}" for c in g])


def _inside(keyed: DataFrame, state: DataFrame, g: list[str], groups: int) -> DataFrame:
    found = _joined(keyed, state.select(*g, "_prefix"), g, groups)
    return found.where(F.col("_h").startswith(F.col("_prefix"))).drop("_prefix")


#: Rows of a joined table up to which it is broadcast, and the salts used beyond.
MOST_BROADCAST_ROWS = 100_000


def attach(rows: DataFrame, table: DataFrame, same: Column, how: str = "inner", most: int = MOST_BROADCAST_ROWS,
           written: bool = False) -> DataFrame:
    """Join a small table onto all rows without shuffling these: it is broadcast if it is counted to have at
    most ``most`` rows; a larger one is left to a shuffled join with adaptive skew splitting. ``written``:
    the table is a checkpoint already."""
    table = table if written else materialize(table)
    return rows.join(F.broadcast(table) if table.count() <= most else table, same, how)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    buckets: int | None = None, prefix: str = "q") -> DataFrame:
    """Linear-interpolated quantiles (numpy/``quantile_cont`` definition), exact, distributed.

    Values are counted per distinct value (partial aggregation), positions
    found with :func:`ordered_prefix`; no task holds all values of a group.
    Output: ``group_cols + [f"{prefix}_{i}" for each prob]``.
    """
    g = list(group_cols)
    v = F.col(value_col)
    vc = df.where(v.isNotNull()).groupBy(*g, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # read several times below: checkpoint the (much smaller) value-count table once
    pre = ordered_prefix(materialize(vc), "_v", ["_c"], g, buckets)
    pre = pre.withColumnRenamed("_c_total", "_n")
    aggs = []
    for i, q in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_c_upto") > lo, F.col("_v"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_c_upto") > hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.first(pos - lo).alias(f"_fr{i}")]
    agg = pre.groupBy(*g).agg(*aggs)
    outs = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")).cast("double")
            .alias(f"{prefix}_{i}") for i in range(len(probs))]
    return agg.select(*g, *outs)


def dense_ranks(values: DataFrame, group_cols: Sequence[str], value: str, partitions: int | None = None) -> DataFrame:
    """``(group..., value, rank)``: the distinct values of each group numbered from 0 in their order.

    Values are range-partitioned by (group, value); each partition numbers its own, and the counts of the
    partitions before (one row for each group and partition) are added. No list of values is collected."""
    g = list(group_cols)
    distinct = materialize(values.select(*g, value).distinct())
    n = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(distinct.repartitionByRange(n, *g, value).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*g, "_part").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_of_{c}") for c in g], F.col("_part").alias("_of_part"),
                            F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of_part")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    own = F.row_number().over(Window.partitionBy(*g, "_part").orderBy(value))
    return dealt.withColumn("_own", own).join(offsets, same).select(*g, value, (F.col("_before") + F.col("_own") - 1).alias("rank"))

"""Preparation for learning.

Randomness is a hash: ``md5(seed ':' id)``. A row's split or sample
membership depends only on its id, not on partitioning or task order, so
reruns after executor loss give the same rows, and DuckDB computes the same
thing. Fitted statistics (medians, modes, means) come from the train rows only
unless asked otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .stats import MOST_BROADCAST_ROWS, attach, dense_ranks, exact_quantiles, hash_cutoffs, ordered_prefix

#: Rows that one bucket of a hash order should hold, and the most leading hex digits used as a bucket.
BUCKET_ROWS, MOST_DIGITS = 50_000, 4


def row_hash(id_col: str | Column, seed: int = 42) -> Column:
    """md5 of ``seed:id`` as hex text (same text in DuckDB); a NULL id counts as no text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))))


def _hex_cut(frac: float) -> str:
    return format(int(frac * 16 ** 8), "08x")


def random_split(df: DataFrame, id_col: str = "id", test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = 'test' when the first 8 hex digits of the row hash are below ``test_frac``."""
    h8 = F.substring(row_hash(id_col, seed), 1, 8)
    return df.withColumn("split", F.when(h8 < F.lit(_hex_cut(test_frac)), "test").otherwise("train"))


def _ranked_by_hash(df: DataFrame, id_col: str, partition_cols: Sequence[str], seed: int) -> DataFrame:
    """Add ``_rank`` (1-based) of each row within its partition in hash order, without a global sort.

    The hash is uniform, so its leading hex digits are an order-preserving,
    balanced bucket for :func:`ordered_prefix`; how many digits follows from
    the measured number of rows.
    """
    digits, n = 1, df.count()
    while digits < MOST_DIGITS and n > BUCKET_ROWS * 16 ** digits:
        digits += 1
    keyed = df.withColumns({"_h": row_hash(id_col, seed), "_one": F.lit(1)})
    bucket = F.conv(F.substring(F.col("_h"), 1, digits), 16, 10).cast("long")
    out = ordered_prefix(keyed, "_h", ["_one"], partition_cols, bucket=bucket)
    return out.withColumnsRenamed({"_one_upto": "_rank", "_one_total": "_n"}).drop("_one")


def _below_cut(df: DataFrame, cutoffs: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Add ``_below``: whether the row's hash is at or below its class's cut (one row per class, joined by size)."""
    cuts = cutoffs.select(F.col(label).alias("_class"), "cut")
    joined = attach(df, cuts, F.col(label).eqNullSafe(F.col("_class")), "left", written=True).drop("_class")
    return joined.withColumn("_below", F.coalesce(row_hash(id_col, seed) <= F.col("cut"), F.lit(False))).drop("cut")


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id", test_frac: float = 0.3,
                     seed: int = 42) -> DataFrame:
    """I4: per class, the ``ceil(test_frac * n_class)`` rows first in hash order are 'test'.

    The cut of each class is found from counts by hash prefix, so the rows are
    filtered where they are and not shuffled. Rows with a NULL label are a class
    of their own; rows with equal ids lie on the same side.
    """
    cuts = hash_cutoffs(df, row_hash(id_col, seed), F.ceil(F.col("rows") * F.lit(test_frac)), [label])
    return _below_cut(df, cuts, label, id_col, seed).withColumn(
        "split", F.when(F.col("_below"), "test").otherwise("train")).drop("_below")


def _stacked(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """``(name, value)`` for each of the columns of each row, NULLs left out: one scan for all of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast(kind).alias("value")) for c in cols]))
    return df.select(pairs.alias("_p")).select("_p.name", "_p.value").where("value IS NOT NULL")


def fit_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """I5 fit: exact median per column (distributed quantiles), all columns in one scan; one row per
    column is read on the driver. A column without values has the median NULL."""
    found = exact_quantiles(_stacked(train, cols, "double"), "value", [0.5], ["name"]).collect() if cols else []
    medians = {r["name"]: r.q_0 for r in found}
    return {c: F.lit(medians.get(c)).cast("double") for c in cols}


def median_impute(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """NULL -> median of the train rows."""
    med = fit_medians(train if train is not None else df, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), med[c]) for c in cols}) if cols else df


def fit_modes(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[Column, int]]:
    """I6 fit: ``(mode, its count)`` per column; the smallest value on ties.

    Counted per (column, value) first (partial aggregation), then reduced with
    ``min_by``, so no task holds the value-count map of a whole column. Columns
    of one type share a scan; the driver reads one row per column.
    """
    kinds, out = dict(train.dtypes), {}
    for kind in dict.fromkeys(kinds[c] for c in cols):
        own = [c for c in cols if kinds[c] == kind]
        counts = _stacked(train, own, kind).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("b"))
        found = {r["name"]: (r["value"], -r.k) for r in best.select("name", "b.k", "b.value").collect()}
        out |= {c: (F.lit(found.get(c, (None, 0))[0]).cast(kind), found.get(c, (None, 0))[1]) for c in own}
    return out


def mode_impute(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """NULL -> mode of the train rows."""
    modes = fit_modes(train if train is not None else df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), modes[c][0]) for c in cols}) if cols else df


def standardise(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std_pop`` with train statistics; zero std scales by 1."""
    # one pass for every statistic, shipped as one scalar struct
    fit = (train if train is not None else df).select(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("st"))
    stats = fit.scalar()
    out = df.withColumn("_st", stats)
    cols_out = {}
    for c in cols:
        m, s = F.col(f"_st.m_{c}"), F.col(f"_st.s_{c}")
        cols_out[c] = (F.col(c) - m) / F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
    return out.withColumns(cols_out).drop("_st")


def undersample(df: DataFrame, label: str = "label", id_col: str = "id", ratio: float = 0.8,
                seed: int = 42) -> DataFrame:
    """Keep every row of the smallest class and of each other class the first ``int(n_min / ratio)``
    rows in hash order. Rows without a label are of no class and are not kept."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    # (size, label) of the smallest class: one row
    least = counts.select(F.min(F.struct(F.col("_c").alias("n"), F.col(label).alias("label"))).alias("m")).first().m
    if least is None:
        return known
    cuts = hash_cutoffs(known, row_hash(id_col, seed), F.lit(int(least.n / ratio)).cast("long"), [label])
    kept = _below_cut(known, cuts, label, id_col, seed)
    return kept.where((F.col(label) == F.lit(least.label)) | F.col("_below")).drop("_below")


def class_weights(df: DataFrame, label: str = "label", mode: str = "balanced",
                  weights: dict | None = None, out: str = "weight") -> DataFrame:
    """Per-row weight: 'balanced' = n / (k * n_class); 'inverse' = 1 / n_class; or a dict (missing -> 1.0)."""
    if weights is not None:
        expr = F.lit(1.0)
        for k, w in weights.items():
            expr = F.when(F.col(label) == F.lit(k), F.lit(float(w))).otherwise(expr)
        return df.withColumn(out, expr)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    # counts has one row per class: totals by a window over it, no extra job
    allc = Window.partitionBy()
    total, k = F.sum("_nc").over(allc), F.count(F.lit(1)).over(allc)
    w = counts.select(label, (total / (k * F.col("_nc")) if mode == "balanced" else 1.0 / F.col("_nc")).alias(out))
    # one row per class
    return df.join(F.broadcast(w), label, "left")


# ---- encoders ------------------------------------------------------------------

#: Levels of a column up to which their names go into the vector's attributes; more are only in ``levels``.
NAMED_LEVELS = 1_000
_OTHER = "__other"


@dataclass
class OneHotLevels:
    """Fitted one-hot encoder: a table of levels, numbered alphabetically, joined to the rows.

    ``levels``: (name, value, rank), one row for each column and level; ``sizes``: how many levels each column
    has. With ``drop_first`` the first level has no slot. NULL, unseen and dropped levels are all zeros.
    """

    levels: DataFrame
    sizes: dict[str, int]
    names: dict[str, list[str]]
    drop_first: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with a sparse vector ``<column>_ohe`` for each column. The levels of a column are broadcast
        up to ``MOST_BROADCAST_ROWS`` counted rows; more are joined by shuffles with adaptive skew splitting."""
        first = int(self.drop_first)
        for c, n in self.sizes.items():
            width = max(n - first, 0)
            own = self.levels.where(F.col("name") == c).select(F.col("value").alias("_value"), (F.col("rank") - first).alias("_slot"))
            joined = df.join(F.broadcast(own) if n <= MOST_BROADCAST_ROWS else own, F.col(c) == F.col("_value"), "left").drop("_value")
            if not width:
                df = joined.withColumn(f"{c}_ohe", array_to_vector(F.array().cast("array<double>"))).drop("_slot")
                continue
            slot = F.when(F.col("_slot") >= 0, F.col("_slot")).otherwise(F.lit(width)).cast("double")
            attribute = {"type": "nominal", "num_vals": width + 1}
            if c in self.names:
                attribute = {"type": "nominal", "vals": [*self.names[c][first:], _OTHER]}
            df = joined.withColumn("_slot", slot.alias("_slot", metadata={"ml_attr": attribute}))
            # the sizes are known, so fitting reads no row; the last slot, of all others, is the one it drops
            encoder = OneHotEncoder(inputCol="_slot", outputCol=f"{c}_ohe", dropLast=True)
            df = encoder.fit(df).transform(df).drop("_slot")
        return df


def fit_one_hot(train: DataFrame, cols: Sequence[str], drop_first: bool) -> OneHotLevels:
    """Number the levels of the columns by a distributed dense rank. The driver sees one row for each column, and
    the names of columns with at most ``NAMED_LEVELS`` levels."""
    levels = materialize(dense_ranks(_stacked(train, cols, "string"), ["name"], "value"))
    sizes = dict.fromkeys(cols, 0) | {r["name"]: r.n for r in levels.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [c for c, n in sizes.items() if n <= NAMED_LEVELS]
    names: dict[str, list[str]] = {c: [] for c in few}
    for r in levels.where(F.col("name").isin(few)).orderBy("name", "rank").collect():
        names[r["name"]].append(r["value"])
    return OneHotLevels(levels, sizes, names, drop_first)


def fit_one_hot_drop_first(train: DataFrame, cols: Sequence[str]) -> OneHotLevels:
    """Dummies with the alphabetically first level dropped and NULL -> all zeros."""
    return fit_one_hot(train, cols, drop_first=True)


def fit_one_hot_all_levels(train: DataFrame, cols: Sequence[str]) -> OneHotLevels:
    """All levels kept; unseen and NULL -> all zeros (fit on train, apply to both)."""
    return fit_one_hot(train, cols, drop_first=False)


# ---- I12: the full classification preparation -------------------------------------

CATEGORICAL = ["day_of_week", "location_description", "district", "beat"]


def preprocess_classification(df: DataFrame, target: str = "arrest", test_frac: float = 0.2, seed: int = 42,
                              numeric: Sequence[str] = ("latitude", "longitude", "hour", "month", "year", "day"),
                              id_col: str = "id") -> tuple[DataFrame, OneHotLevels]:
    """B1-B5, C1, C2, C5, I1 (fit on train), I3, I5-I7 -> ``(id, split, label, features)``.

    Returns the prepared frame and the fitted encoder.
    """
    from ..functions.temporal import day_name
    from .clean import binary_target, coerce_numeric, drop_missing_coordinates
    d, n_parts = F.col("date"), df.rdd.getNumPartitions()
    df = df.withColumn("date", d.cast("timestamp_ntz")).withColumns({
        "hour": F.hour(d), "day_of_week": day_name(d), "month": F.month(d), "year": F.year(d),
        "day": F.dayofmonth(d), "is_weekend": (F.weekday(d) >= 5).cast("int"),
    })
    df = drop_missing_coordinates(coerce_numeric(df, ["latitude", "longitude", "x_coordinate", "y_coordinate"]))
    df = df.withColumn("label", binary_target(F.col(target), dict(df.dtypes)[target]))
    df = random_split(df, id_col, test_frac, seed)
    cats = [c for c in CATEGORICAL if c in df.columns]
    df = df.withColumns({c: F.col(c).cast("string") for c in cats})
    nums = [c for c in numeric if c in df.columns]
    df = df.select(id_col, "split", "label", *nums, "is_weekend", *cats)
    cores = df.sparkSession.sparkContext.defaultParallelism
    # a table in few files would be prepared, fitted and scored on as few cores; written, since every statistic reads it
    df = materialize(df.repartition(cores) if n_parts < cores else df)
    train = df.where(F.col("split") == "train")
    df = median_impute(df, nums, train)
    df = standardise(df, nums, df.where(F.col("split") == "train"))
    enc = fit_one_hot_drop_first(df.where(F.col("split") == "train"), cats)
    inputs = nums + ["is_weekend"] + [f"{c}_ohe" for c in cats]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    rows = assembler.transform(enc.transform(df)).select(id_col, "split", "label", "features")
    # cut lineage: every model iteration would run the preparation again
    out = materialize(rows)
    return out, enc

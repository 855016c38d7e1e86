"""Time series: resampling with gap filling, sliding sequences, scaling, splits,
forecast pairing and error analysis (H1-H5, H9-H12, G3, G4).

Many series are handled at once: every operator takes ``series_cols`` and
partitions its windows by them. After the first aggregation a series holds
one row per period, so window partitions are bounded by the time span, not by
the number of records (a series with a third of all records is still just
its periods).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

FREQS = ("D", "W", "M", "Y")


def period_end(date: Column, freq: str) -> Column:
    """Period label of a date: D day, W week ending Sunday, M month end, Y year end."""
    if freq == "D":
        return F.to_date(date)
    if freq == "W":
        return F.date_add(F.date_trunc("week", date).cast("date"), 6)
    if freq == "M":
        return F.last_day(date)
    if freq == "Y":
        return F.make_date(F.year(date), F.lit(12), F.lit(31))
    raise ValueError(f"freq must be one of {FREQS}, got {freq!r}")


def _calendar(lo: Column, hi: Column, freq: str) -> Column:
    """All period labels from lo to hi (both labels of ``freq``)."""
    if freq == "D":
        return F.sequence(lo, hi, F.expr("interval 1 day"))
    if freq == "W":
        return F.sequence(lo, hi, F.expr("interval 7 days"))
    if freq == "M":
        starts = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))
        return F.transform(starts, lambda d: F.last_day(d))
    if freq == "Y":
        return F.transform(F.sequence(F.year(lo), F.year(hi)), lambda y: F.make_date(y, F.lit(12), F.lit(31)))
    raise ValueError(freq)


def resample_counts(df: DataFrame, freq: str = "D", date_col: str = "date",
                    series_cols: Sequence[str] = (), count_col: str = "n") -> DataFrame:
    """H1 (+G3): counts per period, every period between a series' first and last filled with 0.

    ``(series..., period_end, n)``.
    """
    s = list(series_cols)
    counts = (df.where(F.col(date_col).isNotNull())
                .groupBy(*s, period_end(F.col(date_col), freq).alias("period_end"))
                .agg(F.count(F.lit(1)).alias(count_col)))
    # read twice (span and fill): checkpoint the small (series, period) table so
    # the records are scanned and shuffled once
    counts = materialize(counts)
    span = counts.groupBy(*s).agg(F.min("period_end").alias("_lo"), F.max("period_end").alias("_hi"))
    cal = span.select(*s, F.explode(_calendar(F.col("_lo"), F.col("_hi"), freq)).alias("period_end"))
    return (cal.join(counts, [*s, "period_end"], "left")
               .withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("long")))


def sliding_sequences(counts: DataFrame, seq_length: int = 8, value_col: str = "n", order_col: str = "period_end",
                      series_cols: Sequence[str] = ()) -> DataFrame:
    """H2: for each period with ``seq_length`` predecessors: ``x`` = the previous values, ``y`` = this value.

    Also ``sample_idx`` (0-based position of the sample within its series).
    """
    s = list(series_cols)
    w = Window.partitionBy(*s).orderBy(order_col)
    x = F.collect_list(F.col(value_col).cast("double")).over(w.rowsBetween(-seq_length, -1))
    seq = counts.select(*s, order_col, x.alias("x"), F.col(value_col).cast("double").alias("y"),
                        (F.row_number().over(w) - 1).alias("_pos"))
    return (seq.where(F.size("x") == seq_length)
               .withColumn("sample_idx", F.col("_pos") - seq_length).drop("_pos"))


def chrono_split(samples: DataFrame, train_frac: float = 0.8, order_col: str = "period_end",
                 series_cols: Sequence[str] = ()) -> DataFrame:
    """H4: first ``int(train_frac * n)`` samples of each series are 'train', the rest 'test'."""
    s = list(series_cols)
    n = F.count(F.lit(1)).over(Window.partitionBy(*s))
    rn = F.row_number().over(Window.partitionBy(*s).orderBy(order_col)) - 1
    return samples.withColumn("split", F.when(rn < F.floor(n * F.lit(train_frac)), "train").otherwise("test"))


def minmax_scale(samples: DataFrame, fit_on: str = "train", series_cols: Sequence[str] = (),
                 seq_length: int | None = None) -> DataFrame:
    """H3: min-max scale ``x`` and ``y`` per series with bounds fitted on the x values.

    ``fit_on='train'`` uses the x entries of train samples; ``'all'`` uses every
    sample's x (the reference's behaviour). A zero range scales by 1.
    Adds ``x_scaled``, ``y_scaled``, ``scale_min``, ``scale_max``.
    """
    s = list(series_cols)
    src = samples if fit_on == "all" else samples.where(F.col("split") == "train")
    # bounds per series from the x arrays' own min/max (one row per sample)
    bounds = src.groupBy(*s).agg(F.min(F.array_min("x")).alias("scale_min"), F.max(F.array_max("x")).alias("scale_max"))
    out = samples.join(bounds, s, "left") if s else samples.withColumns({
        "scale_min": bounds.select("scale_min").scalar(), "scale_max": bounds.select("scale_max").scalar()})
    rng = F.when(F.col("scale_max") == F.col("scale_min"), F.lit(1.0)).otherwise(F.col("scale_max") - F.col("scale_min"))
    return out.withColumns({
        "x_scaled": F.transform("x", lambda v: (v - F.col("scale_min")) / rng),
        "y_scaled": (F.col("y") - F.col("scale_min")) / rng,
    })


def inverse_scale(c: Column) -> Column:
    """H3 inverse: ``v * (max - min) + min`` (range 0 -> 1)."""
    rng = F.when(F.col("scale_max") == F.col("scale_min"), F.lit(1.0)).otherwise(F.col("scale_max") - F.col("scale_min"))
    return c * rng + F.col("scale_min")


def prepare_series(df: DataFrame, freq: str = "W", seq_length: int = 8, train_frac: float = 0.8,
                   fit_on: str = "train", date_col: str = "date", series_cols: Sequence[str] = ()) -> DataFrame:
    """H5: H1 -> H2 -> H4 -> H3; one row per sample with its target period."""
    counts = resample_counts(df, freq, date_col, series_cols)
    seq = sliding_sequences(counts, seq_length, series_cols=series_cols)
    return minmax_scale(chrono_split(seq, train_frac, series_cols=series_cols), fit_on, series_cols)


def pair_with_actuals(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str] = ("series", "period_end"),
                      actual_col: str = "n") -> DataFrame:
    """Pair forecasts with actuals by (series, period) instead of by position."""
    a = actuals.select(*keys, F.col(actual_col).cast("double").alias("actual"))
    return predictions.join(a, list(keys), "inner")


# ---- error analysis -----------------------------------------------------------

def regression_aggs(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """K4 as aggregate expressions: mse, rmse, mae, r2, mape (zero actuals excluded)."""
    y, p = F.col(actual), F.col(predicted)
    err = p - y
    mse = F.avg(err * err)
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    ape = F.when(y != 0, F.abs((y - p) / y))
    return [mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
            # constant actuals: 1 for a perfect forecast, else 0
            F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"), (F.avg(ape) * 100).alias("mape")]


def regression_metrics(df: DataFrame, group_cols: Sequence[str] = (), actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """K4 / H9: one row per group (per model for a forecast comparison)."""
    return df.groupBy(*group_cols).agg(*regression_aggs(actual, predicted), F.count(F.lit(1)).alias("count"))


def prediction_intervals(df: DataFrame, group_cols: Sequence[str] = ("model", "series"), lower_q: float = 0.025,
                         upper_q: float = 0.975) -> DataFrame:
    """Forecast +/- residual percentiles of its (model, series); ``inside`` flags coverage.

    A (model, series) group holds one residual per forecast period, so its
    exact percentile buffer is bounded by the horizon.
    """
    g = list(group_cols)
    resid = F.col("actual") - F.col("predicted")
    q = df.groupBy(*g).agg(F.percentile(resid, lower_q).alias("_rlo"), F.percentile(resid, upper_q).alias("_rhi"))
    out = df.join(q, g).withColumns({"lower": F.col("predicted") + F.col("_rlo"),
                                     "upper": F.col("predicted") + F.col("_rhi")})
    return out.withColumn("inside", F.col("actual").between(F.col("lower"), F.col("upper"))).drop("_rlo", "_rhi")


def conformal_intervals(df: DataFrame, group_cols: Sequence[str] = ("model", "series"), alpha: float = 0.05, calibration: float = 0.8,
                        order_col: str = "period_end") -> DataFrame:
    """H10, split conformal: bounds from one span, judged on another.

    The first ``calibration`` share of a group's forecasts, each made from earlier periods only, gives the
    scores ``|actual - predicted|``; the radius is the ``ceil((n + 1)(1 - alpha))``-th smallest of the ``n``
    scores. The later rows are returned with ``lower``, ``upper`` and ``inside``; they had no part in the radius.
    With too few scores for ``alpha`` the bounds are NULL (unbounded) and everything is inside. A group holds
    one row for each period.
    """
    g = list(group_cols)
    w = Window.partitionBy(*g)
    score = F.abs(F.col("actual") - F.col("predicted"))
    place = F.row_number().over(w.orderBy(order_col)) - 1
    dealt = df.withColumn("_calibrates", place < F.floor(F.count(F.lit(1)).over(w) * F.lit(calibration))).withColumn("_score", score)
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*g, "_calibrates").orderBy("_score", order_col)))
    used = F.col("_calibrates")
    n = F.count(F.when(used, 1)).over(w)
    ranked = ranked.withColumn("_k", F.ceil((n + 1) * F.lit(1 - alpha)))
    radius = F.max(F.when(used & (F.col("_rank") == F.col("_k")), F.col("_score"))).over(w)
    out = ranked.withColumn("_radius", radius).where(~used)
    out = out.withColumns({"lower": F.col("predicted") - F.col("_radius"), "upper": F.col("predicted") + F.col("_radius"),
                           "inside": F.col("_radius").isNull() | (F.col("_score") <= F.col("_radius"))})
    return out.drop("_calibrates", "_score", "_rank", "_k", "_radius")


def error_by_month(df: DataFrame, group_cols: Sequence[str] = ("model",), date_col: str = "period_end") -> DataFrame:
    """RMSE, MAE and count per calendar month ('yyyy-MM')."""
    err = F.col("predicted") - F.col("actual")
    return df.groupBy(*group_cols, F.date_format(date_col, "yyyy-MM").alias("month")).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.count(F.lit(1)).alias("count"))


def error_distribution(df: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, median, population std, min, max of ``predicted - actual``.

    The median is exact per group; a group holds one error per forecast row.
    """
    err = F.col("predicted") - F.col("actual")
    return df.groupBy(*group_cols).agg(
        F.avg(err).alias("mean_error"), F.median(err).alias("median_error"), F.stddev_pop(err).alias("std_error"),
        F.min(err).alias("min_error"), F.max(err).alias("max_error"), F.count(F.lit(1)).alias("count"))


def error_histogram(df: DataFrame, width: float = 1.0, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """H12 density data: counts of ``predicted - actual`` in bins ``[k*width, (k+1)*width)``."""
    err = F.col("predicted") - F.col("actual")
    return (df.groupBy(*group_cols, (F.floor(err / width) * width).alias("bin_lo"))
              .agg(F.count(F.lit(1)).alias("count")))

"""Registered queries: time series (H1-H5, H9-H12, G4, K4) on ``incident_log`` and ``forecasts``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as TS
from . import fixtures as fx
from .registry import r6, register
from .sqlviews import with_views

LOG = with_views("incident_log")
FC = with_views("forecasts")

_LABEL_SQL = {
    "D": "cast(date as date)",
    "W": "cast(date_trunc('week', date) + interval 6 day as date)",
    "M": "last_day(date)",
    "Y": "make_date(year(date), 12, 31)",
}
_CAL_SQL = {
    "D": "select series, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as period_end from span",
    "W": "select series, cast(unnest(generate_series(lo, hi, interval 7 day)) as date) as period_end from span",
    "M": "select series, last_day(cast(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), "
         "interval 1 month)) as date)) as period_end from span",
    "Y": "select series, make_date(cast(unnest(generate_series(year(lo), year(hi))) as bigint), 12, 31) as period_end "
         "from span",
}


def _resample_sql(freq: str) -> str:
    """CTEs ``cnt``, ``span``, ``cal``, ``filled(series, period_end, n)`` (needs incident_log)."""
    return (f"cnt as (select series, {_LABEL_SQL[freq]} as period_end, count(*) as n from incident_log group by 1, 2), "
            "span as (select series, min(period_end) as lo, max(period_end) as hi from cnt group by 1), "
            f"cal as ({_CAL_SQL[freq]}), "
            "filled as (select cal.series, cal.period_end, coalesce(cnt.n, 0) as n from cal "
            "left join cnt on cnt.series = cal.series and cnt.period_end = cal.period_end)")


for _freq, _name in [("D", "daily"), ("W", "weekly"), ("M", "monthly"), ("Y", "yearly")]:
    def _q(spark, sf, _freq=_freq):
        return TS.resample_counts(fx.gapped_log(spark, sf), _freq, series_cols=["series"])
    _q.__doc__ = f"H1: {_name} counts per series, gaps filled with 0."
    register(f"h1_resample_{_name}", with_views("gapped_log") + ", " + _resample_sql(_freq).replace("from incident_log", "from gapped_log") + " select series, period_end, n from filled")(_q)


def _seq_sql(freq: str, L: int) -> str:
    """CTE ``seq(series, period_end, x, y, sample_idx)``."""
    w = "partition by series order by period_end"
    return (_resample_sql(freq) + ", "
            f"seq0 as (select series, period_end, list(cast(n as double)) over ({w} rows between {L} preceding and 1 "
            f"preceding) as x, cast(n as double) as y, row_number() over ({w}) - 1 - {L} as sample_idx from filled), "
            f"seq as (select * from seq0 where len(x) = {L})")


def _split_sql() -> str:
    return ("split as (select *, case when row_number() over (partition by series order by period_end) - 1 < "
            "floor(count(*) over (partition by series) * 0.8) then 'train' else 'test' end as split from seq)")


@register("h2_sequences", LOG + ", " + _seq_sql("W", 8) + " select series, period_end, x, y, sample_idx from seq")
def h2_sequences(spark, sf):
    counts = TS.resample_counts(fx.incident_log(spark, sf), "W", series_cols=["series"])
    return TS.sliding_sequences(counts, 8, series_cols=["series"])


@register("h4_chrono_split", LOG + ", " + _seq_sql("W", 8) + ", " + _split_sql() +
          " select series, period_end, split from split")
def h4_chrono_split(spark, sf):
    counts = TS.resample_counts(fx.incident_log(spark, sf), "W", series_cols=["series"])
    return TS.chrono_split(TS.sliding_sequences(counts, 8, series_cols=["series"]), series_cols=["series"]).select(
        "series", "period_end", "split")


def _scaled_sql(fit_where: str) -> str:
    rng = "case when b.scale_max = b.scale_min then 1.0 else b.scale_max - b.scale_min end"
    return (f"bounds as (select series, min(list_min(x)) as scale_min, max(list_max(x)) as scale_max from split "
            f"{fit_where} group by series) "
            f"select s.series, s.period_end, s.split, b.scale_min, b.scale_max, "
            f"list_transform(s.x, lambda v: round((v - b.scale_min) / ({rng}), 6) + 0.0) as x_scaled, "
            f"{r6(f'(s.y - b.scale_min) / ({rng})')} as y_scaled from split s join bounds b on b.series = s.series")


@register("h3_minmax_scale", LOG + ", " + _seq_sql("W", 8) + ", " + _split_sql() + ", " + _scaled_sql("where split = 'train'"))
def h3_minmax_scale(spark, sf):
    counts = TS.resample_counts(fx.incident_log(spark, sf), "W", series_cols=["series"])
    seq = TS.chrono_split(TS.sliding_sequences(counts, 8, series_cols=["series"]), series_cols=["series"])
    out = TS.minmax_scale(seq, "train", ["series"])
    return out.select("series", "period_end", "split", "scale_min", "scale_max",
                      F.transform("x_scaled", lambda v: F.round(v, 6)).alias("x_scaled"), "y_scaled")


@register("h3_minmax_scale_all", LOG + ", " + _seq_sql("W", 8) + ", " + _split_sql() + ", " + _scaled_sql(""))
def h3_minmax_scale_all(spark, sf):
    """H3 with the reference's fit on all windows (train and test)."""
    counts = TS.resample_counts(fx.incident_log(spark, sf), "W", series_cols=["series"])
    seq = TS.chrono_split(TS.sliding_sequences(counts, 8, series_cols=["series"]), series_cols=["series"])
    out = TS.minmax_scale(seq, "all", ["series"])
    return out.select("series", "period_end", "split", "scale_min", "scale_max",
                      F.transform("x_scaled", lambda v: F.round(v, 6)).alias("x_scaled"), "y_scaled")


@register("h5_monthly_prep", LOG + ", " + _seq_sql("M", 6).replace("partition by series order by period_end", "partition by series order by period_end")
          + ", " + _split_sql() + ", " + _scaled_sql("where split = 'train'").replace(
              "select s.series, s.period_end, s.split,", "select s.series, s.period_end, s.split, s.x, s.y,"))
def h5_monthly_prep(spark, sf):
    """H5: monthly preparation, L = 6, with the target period kept as a column."""
    out = TS.prepare_series(fx.incident_log(spark, sf), "M", 6, series_cols=["series"])
    return out.select("series", "period_end", "split", "x", "y", "scale_min", "scale_max",
                      F.transform("x_scaled", lambda v: F.round(v, 6)).alias("x_scaled"), "y_scaled")


@register("g4_pair_predictions", LOG + ", " + _resample_sql("W") + ", " + with_views("forecasts")[5:].replace(
          "incident_log as (", "incident_log_unused as (", 1) +
          " select f.model, f.series, f.period_end, f.predicted, cast(w.n as double) as actual "
          "from forecasts f join filled w on w.series = f.series and w.period_end = f.period_end")
def g4_pair_predictions(spark, sf):
    log = fx.incident_log(spark, sf)
    preds = fx.forecasts_from_log(log).select("model", "series", "period_end", "predicted")
    return TS.pair_with_actuals(preds, TS.resample_counts(log, "W", series_cols=["series"]))


_K4_SQL = (f"{r6('avg((predicted - actual) * (predicted - actual))')} as mse, "
           f"{r6('sqrt(avg((predicted - actual) * (predicted - actual)))')} as rmse, "
           f"{r6('avg(abs(predicted - actual))')} as mae, "
           f"{r6('1 - sum((predicted - actual) * (predicted - actual)) / (var_pop(actual) * count(actual))')} as r2, "
           f"{r6('avg(case when actual <> 0 then abs((actual - predicted) / actual) end) * 100')} as mape, "
           "count(*) as count")


@register("k4_regression_metrics", FC + f"select {_K4_SQL} from forecasts")
def k4_regression_metrics(spark, sf):
    return TS.regression_metrics(fx.forecasts(spark, sf))


@register("h9_forecast_comparison", FC + f"select model, {_K4_SQL} from forecasts group by model")
def h9_forecast_comparison(spark, sf):
    return TS.regression_metrics(fx.forecasts(spark, sf), ["model"])


@register("h10_prediction_intervals", FC + ", q as (select model, series, quantile_cont(actual - predicted, 0.025) as rlo, "
          "quantile_cont(actual - predicted, 0.975) as rhi from forecasts group by 1, 2) "
          "select f.model, f.series, f.period_end, f.actual, f.predicted, "
          f"{r6('f.predicted + q.rlo')} as lower, {r6('f.predicted + q.rhi')} as upper, "
          "f.actual between f.predicted + q.rlo and f.predicted + q.rhi as inside "
          "from forecasts f join q on q.model = f.model and q.series = f.series")
def h10_prediction_intervals(spark, sf):
    return TS.prediction_intervals(fx.forecasts(spark, sf))


@register("h10_interval_coverage", FC + ", q as (select model, series, quantile_cont(actual - predicted, 0.025) as rlo, "
          "quantile_cont(actual - predicted, 0.975) as rhi from forecasts group by 1, 2) "
          f"select f.model, {r6('avg(case when f.actual between f.predicted + q.rlo and f.predicted + q.rhi then 1.0 else 0.0 end)')} "
          "as coverage from forecasts f join q on q.model = f.model and q.series = f.series group by f.model")
def h10_interval_coverage(spark, sf):
    iv = TS.prediction_intervals(fx.forecasts(spark, sf))
    return iv.groupBy("model").agg(F.avg(F.col("inside").cast("double")).alias("coverage"))


_CONFORMAL = (FC + ", pl as (select *, abs(actual - predicted) as score, row_number() over (partition by model, series order by period_end) - 1 "
              "< floor(count(*) over (partition by model, series) * cast(0.8 as double)) as cal from forecasts), "
              "sc as (select model, series, list_sort(list(score)) as s from pl where cal group by 1, 2), "
              "rd as (select model, series, s[cast(ceil((len(s) + 1) * cast(0.95 as double)) as bigint)] as radius from sc), "
              "iv as (select p.*, p.predicted - r.radius as lower, p.predicted + r.radius as upper, "
              "r.radius is null or p.score <= r.radius as inside from pl p join rd r on r.model = p.model and r.series = p.series where not p.cal) ")


@register("h10_conformal_intervals", _CONFORMAL + f"select model, series, period_end, actual, predicted, {r6('lower')} as lower, {r6('upper')} as upper, inside from iv")
def h10_conformal_intervals(spark, sf):
    """Bounds from the residuals of earlier one-step forecasts, on later rows only."""
    return TS.conformal_intervals(fx.forecasts(spark, sf))


@register("h10_conformal_coverage", _CONFORMAL + f"select model, {r6('avg(inside::int)')} as coverage, count(*) as count from iv group by model")
def h10_conformal_coverage(spark, sf):
    iv = TS.conformal_intervals(fx.forecasts(spark, sf))
    return iv.groupBy("model").agg(F.avg(F.col("inside").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("count"))


@register("h11_error_by_month", FC + "select model, strftime(period_end, '%Y-%m') as month, "
          f"{r6('sqrt(avg((predicted - actual) * (predicted - actual)))')} as rmse, "
          f"{r6('avg(abs(predicted - actual))')} as mae, count(*) as count from forecasts group by 1, 2")
def h11_error_by_month(spark, sf):
    return TS.error_by_month(fx.forecasts(spark, sf))


@register("h12_error_distribution", FC + f"select model, {r6('avg(predicted - actual)')} as mean_error, "
          f"{r6('median(predicted - actual)')} as median_error, {r6('stddev_pop(predicted - actual)')} as std_error, "
          f"{r6('min(predicted - actual)')} as min_error, {r6('max(predicted - actual)')} as max_error, "
          "count(*) as count from forecasts group by model")
def h12_error_distribution(spark, sf):
    return TS.error_distribution(fx.forecasts(spark, sf))


@register("h12_error_histogram", FC + f"select model, {r6('floor((predicted - actual) / 1.0) * 1.0')} as bin_lo, "
          "count(*) as count from forecasts group by 1, 2")
def h12_error_histogram(spark, sf):
    return TS.error_histogram(fx.forecasts(spark, sf), 1.0)

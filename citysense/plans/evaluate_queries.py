"""Registered queries: evaluation (K1-K3, K5-K12, J7, W6, W7) on ``scored`` and ``forecasts``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import spatial as S
from ..operators import timeseries as TS
from . import fixtures as fx
from .registry import r6, register
from .sqlviews import with_views

SC = with_views("scored")

_COUNTS = ("cast(sum(case when label = 0 and pred = 0 then 1 else 0 end) as bigint) as tn, "
           "cast(sum(case when label = 0 and pred = 1 then 1 else 0 end) as bigint) as fp, "
           "cast(sum(case when label = 1 and pred = 0 then 1 else 0 end) as bigint) as fn, "
           "cast(sum(case when label = 1 and pred = 1 then 1 else 0 end) as bigint) as tp")


def _ratio(a, b):
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0)"


_RATIOS = (f"{r6(_ratio('tp + tn', 'tp + tn + fp + fn'))} as accuracy, {r6(_ratio('tp', 'tp + fp'))} as precision, "
           f"{r6(_ratio('tp', 'tp + fn'))} as recall, {r6(_ratio('2 * tp', '2 * tp + fp + fn'))} as f1_score")

# K6/K11 input: two threshold "models" over the same scores, in long form.
_MODELS_SQL = ("models as (select 'gt20' as model, label, case when score > 0.2 then 1 else 0 end as pred, score "
               "from scored union all select 'ge50', label, case when score >= 0.5 then 1 else 0 end, score from scored)")


def _models(spark, sf):
    sc = fx.scored(spark, sf)
    return sc.select("label", "score", F.explode(F.array(
        F.struct(F.lit("gt20").alias("model"), EV.threshold("score", 0.2, strict=True).alias("pred")),
        F.struct(F.lit("ge50").alias("model"), EV.threshold("score", 0.5).alias("pred")))).alias("m")
    ).select("m.model", "label", "m.pred", "score")


@register("k1_classification_metrics", SC + f", c as (select {_COUNTS} from scored) select tn, fp, fn, tp, {_RATIOS} from c")
def k1_classification_metrics(spark, sf):
    return EV.classification_metrics(fx.scored(spark, sf))


_CUM = ("st as (select score, cast(sum(case when label = 1 then 1 else 0 end) as bigint) as pos, "
        "cast(sum(case when label = 1 then 0 else 1 end) as bigint) as neg from scored group by score), "
        "cum as (select score, pos, neg, sum(pos) over (order by score rows between unbounded preceding and current row) "
        "as pos_upto, sum(neg) over (order by score rows between unbounded preceding and current row) as neg_upto, "
        "sum(pos) over () as P, sum(neg) over () as N from st)")


@register("k2_roc_auc", SC + f", {_CUM} select {r6('sum(pos * ((neg_upto - neg) + 0.5 * neg)) / (max(P) * max(N))')} "
          "as auc from cum")
def k2_roc_auc(spark, sf):
    return EV.roc_auc(fx.scored(spark, sf))


@register("k3_confusion_matrix", SC + f", c as (select {_COUNTS} from scored) "
          "select cast(0 as bigint) as label, cast(0 as bigint) as pred, tn as count from c union all "
          "select 0, 1, fp from c union all select 1, 0, fn from c union all select 1, 1, tp from c")
def k3_confusion_matrix(spark, sf):
    return EV.confusion_matrix(fx.scored(spark, sf))


@register("k5_error_summary", SC + f"select {r6('avg(case when label <> pred then 1.0 else 0.0 end)')} as error_rate, "
          "cast(sum(case when label <> pred then 1 else 0 end) as bigint) as num_errors, "
          "cast(sum(case when pred = 1 and label = 0 then 1 else 0 end) as bigint) as num_false_positives, "
          "cast(sum(case when pred = 0 and label = 1 then 1 else 0 end) as bigint) as num_false_negatives from scored")
def k5_error_summary(spark, sf):
    return EV.error_analysis_summary(fx.scored(spark, sf))


_K5_FEATURES = ["hour", "district", "score"]


@register("k5_error_analysis", SC + "select feature, "
          f"{r6('avg(case when label = pred then v end)')} as correct_mean, "
          f"{r6('stddev_pop(case when label = pred then v end)')} as correct_std, "
          f"{r6('avg(case when label <> pred then v end)')} as error_mean, "
          f"{r6('stddev_pop(case when label <> pred then v end)')} as error_std, "
          f"{r6('avg(case when pred = 1 and label = 0 then v end)')} as fp_mean, "
          f"{r6('avg(case when pred = 0 and label = 1 then v end)')} as fn_mean from (" + " union all ".join(
              f"select '{f}' as feature, cast({f} as double) as v, label, pred from scored" for f in _K5_FEATURES)
          + ") t group by feature")
def k5_error_analysis(spark, sf):
    return EV.error_analysis(fx.scored(spark, sf), _K5_FEATURES)


@register("k6_compare_models", SC + f", {_MODELS_SQL}, c as (select model, {_COUNTS} from models group by model) "
          f"select model, 'classification' as task, {_RATIOS}, cast(null as double) as mse, cast(null as double) as mae, "
          "cast(null as double) as r2, cast(null as double) as rmse, cast(null as double) as mape from c")
def k6_compare_models(spark, sf):
    return EV.compare_models(_models(spark, sf))


def _k6_regression_sql():
    """Regression metrics where the actuals have more than 10 distinct values, else classification metrics."""
    from .timeseries_queries import _K4_SQL, FC
    ratios = ", ".join(f"case when not reg then r.{c} end as {c}" for c in ("accuracy", "precision", "recall", "f1_score"))
    errors = ", ".join(f"case when reg then m.{c} end as {c}" for c in ("mse", "mae", "r2", "rmse", "mape"))
    return (FC + ", f as (select model, actual as label, predicted as pred from forecasts), "
            f"c as (select model, {_COUNTS}, count(distinct label) > 10 as reg from f group by model), "
            f"r as (select model, reg, {_RATIOS} from c), m as (select model, {_K4_SQL} from forecasts group by model) "
            f"select r.model, case when reg then 'regression' else 'classification' end as task, {ratios}, {errors} from r join m on r.model = m.model")


@register("k6_compare_regressors", _k6_regression_sql())
def k6_compare_regressors(spark, sf):
    return EV.compare_models(fx.forecasts(spark, sf), "model", "actual", "predicted")


@register("k7_roc_curve", SC + f", {_CUM} select {r6('score')} as threshold, cast(P - (pos_upto - pos) as bigint) as tp, "
          f"cast(N - (neg_upto - neg) as bigint) as fp, {r6('(P - (pos_upto - pos)) / P')} as tpr, "
          f"{r6('(N - (neg_upto - neg)) / N')} as fpr from cum")
def k7_roc_curve(spark, sf):
    return EV.roc_curve(fx.scored(spark, sf))


@register("k8_pr_curve", SC + f", {_CUM} select {r6('score')} as threshold, "
          f"{r6('(P - (pos_upto - pos)) / ((P - (pos_upto - pos)) + (N - (neg_upto - neg)))')} as precision, "
          f"{r6('(P - (pos_upto - pos)) / P')} as recall from cum")
def k8_pr_curve(spark, sf):
    return EV.pr_curve(fx.scored(spark, sf))


@register("k8_average_precision", SC + f", {_CUM} select "
          f"{r6('sum(pos / P * (P - (pos_upto - pos)) / ((P - (pos_upto - pos)) + (N - (neg_upto - neg))))')} "
          "as average_precision from cum")
def k8_average_precision(spark, sf):
    return EV.average_precision(fx.scored(spark, sf))


_BIN = " + ".join(f"cast(score > cast('{e!r}' as double) as int)" for e in
                  [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9])


@register("k9_calibration_curve", SC + f"select cast({_BIN} as bigint) as bin, {r6('avg(score)')} as mean_predicted, "
          f"{r6('avg(cast(label as double))')} as fraction_positive, count(*) as count from scored group by 1")
def k9_calibration_curve(spark, sf):
    return EV.calibration_curve(fx.scored(spark, sf))


def _report_sql():
    p0, r0, f0 = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp"), _ratio("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn"), _ratio("2 * tp", "2 * tp + fp + fn")
    tot = "(tn + fp + fn + tp)"
    return (SC + f", c as (select {_COUNTS} from scored) "
            f"select '0' as class, {r6(p0)} as precision, {r6(r0)} as recall, {r6(f0)} as f1_score, tn + fp as support from c "
            f"union all select '1', {r6(p1)}, {r6(r1)}, {r6(f1)}, tp + fn from c "
            f"union all select 'macro avg', {r6(f'({p0} + {p1}) / 2')}, {r6(f'({r0} + {r1}) / 2')}, "
            f"{r6(f'({f0} + {f1}) / 2')}, {tot} from c "
            f"union all select 'weighted avg', {r6(f'({p0} * (tn + fp) + {p1} * (tp + fn)) / {tot}')}, "
            f"{r6(f'({r0} * (tn + fp) + {r1} * (tp + fn)) / {tot}')}, {r6(f'({f0} * (tn + fp) + {f1} * (tp + fn)) / {tot}')}, "
            f"{tot} from c "
            f"union all select 'accuracy', null, null, {r6(_ratio('tp + tn', tot))}, {tot} from c")


@register("k10_class_report", _report_sql())
def k10_class_report(spark, sf):
    return EV.class_report(fx.scored(spark, sf))


@register("k11_comparison_table", SC + f", {_MODELS_SQL}, c as (select model, {_COUNTS} from models group by model), "
          f"m as (select model, {_RATIOS} from c) "
          "unpivot m on accuracy, precision, recall, f1_score into name metric value value")
def k11_comparison_table(spark, sf):
    return EV.comparison_table(_models(spark, sf))


_LN = "greatest(ln(greatest({x}, cast('1e-300' as double))), -100.0)"


@register("k12_log_loss", SC + "select " + r6("avg(-(cast(label as double) * " + _LN.format(x="score") +
          " + (1.0 - cast(label as double)) * " + _LN.format(x="1.0 - score") + "))") + " as log_loss, "
          + r6("avg((score - label) * (score - label))") + " as mse from scored")
def k12_log_loss(spark, sf):
    return EV.log_loss(fx.scored(spark, sf))


@register("j7_threshold_decision", SC + "select id, cast(case when score > 0.2 then 1 else 0 end as bigint) as pred_strict_20, "
          "cast(case when score >= 0.5 then 1 else 0 end as bigint) as pred_50 from scored")
def j7_threshold_decision(spark, sf):
    sc = fx.scored(spark, sf)
    return sc.select("id", EV.threshold("score", 0.2, strict=True).alias("pred_strict_20"),
                     EV.threshold("score", 0.5).alias("pred_50"))


_W6_FEATURES = ["hour_mean", "hour_std", "cell_crime_count", "cell_arrest_rate", "cell_night_crime_rate"]


@register("w6_unpivot_profile", with_views("incidents") + ", cells as (select *, hour(date) as hour, "
          "case arrest when 'true' then 1 when 'false' then 0 end as a, "
          "cast(hour(date) >= 20 or hour(date) < 6 as int) as nt from incidents "
          "where latitude is not null and longitude is not null), "
          "p as (select latitude, longitude, hour, a, nt, " + __import__("citysense.plans.gridsql", fromlist=["x"]).cell_sql()
          + " as grid_cell from cells), "
          "w as (select grid_cell, avg(hour) as hour_mean, coalesce(stddev_samp(hour), 0) as hour_std, "
          "cast(count(*) as double) as cell_crime_count, avg(a) as cell_arrest_rate, avg(nt) as cell_night_crime_rate "
          "from p group by grid_cell) "
          f"select cast(grid_cell as bigint) as grid_cell, feature, {r6('value')} as value from "
          "(unpivot w on " + ", ".join(_W6_FEATURES) + " into name feature value value)")
def w6_unpivot_profile(spark, sf):
    prof = S.cell_profile(fx.incidents(spark, sf))
    return EV.to_long(prof, ["grid_cell"], _W6_FEATURES, "feature", "value")


@register("w7_summary_union", with_views("scored", "forecasts") + f", {_MODELS_SQL}, "
          f"c as (select model, {_COUNTS} from models group by model), m as (select model, {_RATIOS} from c), "
          "cl as (select model, metric, value from (unpivot m on accuracy, f1_score into name metric value value)), "
          f"rg as (select model, {r6('sqrt(avg((predicted - actual) * (predicted - actual)))')} as rmse, "
          f"{r6('avg(abs(predicted - actual))')} as mae from forecasts group by model), "
          "rl as (select model, metric, value from (unpivot rg on rmse, mae into name metric value value)) "
          "select 'classification' as task, * from cl union all select 'forecast' as task, * from rl")
def w7_summary_union(spark, sf):
    cls = EV.classification_metrics(_models(spark, sf), group_cols=["model"])
    cl = EV.to_long(cls, ["model"], ["accuracy", "f1_score"]).withColumn("task", F.lit("classification"))
    reg = TS.regression_metrics(fx.forecasts(spark, sf), ["model"])
    rl = EV.to_long(reg, ["model"], ["rmse", "mae"]).withColumn("task", F.lit("forecast"))
    return cl.unionByName(rl).select("task", "model", "metric", "value")

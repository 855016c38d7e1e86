"""Registered queries: encoders, sampling, models and forecasters.

Model outputs depend on Spark ML's partition-dependent training, so these
queries get the driver's rows/schema check; their invariants (probabilities in
range, importances summing to one, save/load equality, forecast horizon) are
asserted in ``tests/``.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clean as CL
from ..operators import evaluate as EV
from ..operators import forecast as FC
from ..operators import models as M
from ..operators import prepare as PR
from ..operators import sampling as SM
from ..operators import spatial as S
from ..operators import timeseries as TS
from ..operators import trees as TR
from ..session import materialize, scratch_path
from . import area_safety as AS
from . import fixtures as fx
from .registry import register
from .spatial_queries import CELLS, INC
from .sqlviews import with_views


def _prepared(spark, sf):
    return PR.preprocess_classification(fx.incidents(spark, sf))


def _onehot_sql(value: str, levels: str) -> str:
    return f"list_transform({levels}, lambda l: cast(case when {value} = l then 1 else 0 end as double))"


@register("i1_one_hot_drop_first", with_views("incidents") + ", lv as (select list_sort(list_distinct(list(dayname(date)))) "
          "as dl, list_sort(list_distinct(list(location_description))) as ll from incidents) "
          f"select id, {_onehot_sql('dayname(date)', 'dl[2:]')} as day_of_week_ohe, "
          f"{_onehot_sql('location_description', 'll[2:]')} as location_description_ohe from incidents, lv")
def i1_one_hot_drop_first(spark, sf):
    inc = fx.incidents(spark, sf).withColumn("day_of_week", F.date_format("date", "EEEE"))
    model = PR.fit_one_hot_drop_first(inc, ["day_of_week", "location_description"])
    out = model.transform(inc)
    return out.select("id", vector_to_array("day_of_week_ohe").alias("day_of_week_ohe"),
                      vector_to_array("location_description_ohe").alias("location_description_ohe"))


@register("i2_one_hot_all_levels", with_views("incidents") + ", sp as (select *, case when substr(md5('42:' || "
          "cast(id as varchar)), 1, 8) < '33333333' then 'test' else 'train' end as split from incidents), "
          "lv as (select list_sort(list_distinct(list(location_description))) as ll from sp where split = 'train') "
          f"select id, split, {_onehot_sql('location_description', 'll')} as ohe from sp, lv")
def i2_one_hot_all_levels(spark, sf):
    inc = PR.random_split(fx.incidents(spark, sf), "id", 0.2, 42)
    model = PR.fit_one_hot_all_levels(inc.where(F.col("split") == "train"), ["location_description"])
    return model.transform(inc).select("id", "split", vector_to_array("location_description_ohe").alias("ohe"))


def _scored_features(spark, sf):
    sc = fx.scored(spark, sf)
    return CL.assemble(sc, ["hour", "district", "score"], "features")


def _unit_sql(tag: str) -> str:
    key = f"'42:' || cast(r.id as varchar) || ':' || cast(r.copy as varchar) || ':{tag}'"
    return f"(cast(cast('0x' || substr(md5({key}), 1, 12) as bigint) as double) / cast({16 ** 12} as double))"


_D2 = " + ".join(f"(n.x[{i}] - r.x[{i}]) * (n.x[{i}] - r.x[{i}])" for i in (1, 2, 3))
_SMOTE_SQL = (
    with_views("scored") + ", b as (select id, label, [cast(hour as double), cast(district as double), score] as x "
    "from scored), "
    "m as (select id, x, row_number() over (order by md5('42:' || cast(id as varchar))) - 1 as r from b where label = 1), "
    "cnt as (select count(*) filter (where label = 1) as n_min, count(*) filter (where label <> 1) as n_maj from b), "
    "nd as (select cast(floor(0.1 * n_maj) as bigint) - n_min as need, n_min from cnt), "
    "cp as (select m.id, m.x, (nd.need // nd.n_min) + case when m.r < nd.need % nd.n_min then 1 else 0 end as copies "
    "from m, nd), "
    "rw as (select id, x, unnest(range(copies)) as copy from cp where copies > 0), "
    f"nn as (select r.id, r.copy, r.x, n.x as nx, row_number() over (partition by r.id, r.copy order by {_D2}, n.id) as k "
    "from rw r join m n on n.id <> r.id), "
    f"sel as (select r.id, r.copy, r.x, r.nx, {_unit_sql('gap')} as u from nn r where r.k = floor({_unit_sql('nn')} * 5) + 1), "
    "over as (select cast(id as varchar) as sample_key, cast(label as bigint) as label, false as synthetic, x as features "
    "from b union all select 's:' || cast(id as varchar) || ':' || cast(copy as varchar), 1, true, "
    "[x[1] + u * (nx[1] - x[1]), x[2] + u * (nx[2] - x[2]), x[3] + u * (nx[3] - x[3])] from sel)")


@register("i8_smote", _SMOTE_SQL + " select * from over")
def i8_smote(spark, sf):
    out = SM.smote(_scored_features(spark, sf), "label", "features", "id", ratio=0.1, k=5, seed=42)
    return out.select("sample_key", "label", "synthetic", vector_to_array("features").alias("features"))


@register("i10_smote_undersample", _SMOTE_SQL + ", rk as (select sample_key, label, synthetic, row_number() over "
          "(partition by label order by md5('42:' || sample_key)) as rk from over), "
          "c as (select label, count(*) as n from over group by label) "
          "select sample_key, label, synthetic from rk where label = (select arg_min(label, n) from c) "
          "or rk <= floor((select min(n) from c) / 0.8)")
def i10_smote_undersample(spark, sf):
    out = SM.smote_then_undersample(_scored_features(spark, sf), "label", "features", "id", 0.1, 0.8)
    return out.select("sample_key", "label", "synthetic")


_I12_NUMS = ["latitude", "longitude", "hour", "month", "year", "day"]


def _i12_sql() -> str:
    split = "case when substr(md5('42:' || cast(id as varchar)), 1, 8) < '33333333' then 'test' else 'train' end"
    med = ", ".join(f"quantile_cont({c}, 0.5) as md_{c}" for c in _I12_NUMS)
    imp = ", ".join(f"coalesce({c}, md_{c}) as {c}_i" for c in _I12_NUMS)
    st = ", ".join(f"avg({c}_i) as m_{c}, stddev_pop({c}_i) as s_{c}" for c in _I12_NUMS)
    scaled = ", ".join(f"({c}_i - m_{c}) / (case when s_{c} = 0 or s_{c} is null then 1.0 else s_{c} end)"
                       for c in _I12_NUMS)
    return (with_views("incidents") +
            f", p as (select id, case arrest when 'true' then 1 when 'false' then 0 end as label, {split} as split, "
            "latitude, longitude, cast(hour(date) as double) as hour, cast(month(date) as double) as month, "
            "cast(year(date) as double) as year, cast(day(date) as double) as day, "
            "cast(isodow(date) >= 6 as double) as is_weekend, dayname(date) as day_of_week, location_description, "
            "cast(district as varchar) as district from incidents where latitude is not null and longitude is not null), "
            f"med as (select {med} from p where split = 'train'), "
            f"q as (select p.*, {imp} from p, med), "
            f"st as (select {st} from q where split = 'train'), "
            "lv as (select list_sort(list_distinct(list(day_of_week))) as dl, "
            "list_sort(list_distinct(list(location_description))) as ll, "
            "list_sort(list_distinct(list(district))) as tl from q where split = 'train') "
            "select id, split, cast(label as bigint) as label, list_transform("
            f"[{scaled}, is_weekend] || {_onehot_sql('day_of_week', 'dl[2:]')} || "
            f"{_onehot_sql('location_description', 'll[2:]')} || {_onehot_sql('district', 'tl[2:]')}, "
            "lambda v: round(v, 6) + 0.0) as features from q, st, lv")


@register("i12_preprocess_classification", _i12_sql())
def i12_preprocess_classification(spark, sf):
    out, _ = _prepared(spark, sf)
    return out.select("id", "split", "label",
                      F.transform(vector_to_array("features"), lambda v: F.round(v, 6)).alias("features"))


@register("b15_assemble", with_views("scored") + "select id, [cast(hour as double), cast(district as double), score] "
          "as features from scored")
def b15_assemble(spark, sf):
    df = CL.assemble(fx.scored(spark, sf), ["hour", "district", "score"], "features")
    return df.select("id", vector_to_array("features").alias("features"))


_TEST_SQL = (with_views("incidents") + "select id, cast(case arrest when 'true' then 1 when 'false' then 0 end as bigint) as label, "
             "true as p_valid, true as pred_valid from incidents where latitude is not null and longitude is not null "
             "and substr(md5('42:' || cast(id as varchar)), 1, 8) < '33333333'")


def _fit(spark, sf, estimator, **how):
    """Fitted as the reference trains: SMOTE on the training rows (or weights instead)."""
    data, _ = _prepared(spark, sf)
    model = M.fit_balanced(estimator, data.where(F.col("split") == "train"), **how)
    return model, data.where(F.col("split") == "test")


def _checked(scored, cut=0.5):
    """Scores differ with the partitioning; what must hold whatever they are is returned as columns."""
    return scored.select("id", "label", F.col("p1").between(0, 1).alias("p_valid"),
                         (F.col("pred") == (F.col("p1") > cut).cast("int")).alias("pred_valid"))


@register("j1_random_forest", _TEST_SQL)
def j1_random_forest(spark, sf):
    """J1 with SMOTE, decided at the reference's threshold of 0.2."""
    model, test = _forest(spark, sf)
    scored = M.score(model, test)
    return _checked(scored.withColumn("pred", EV.threshold("p1", 0.2, strict=True)), 0.2)


@register("j1_random_forest_weighted", _TEST_SQL)
def j1_random_forest_weighted(spark, sf):
    model, test = _fit(spark, sf, M.random_forest(seed=42), use_smote=False, class_weight="balanced")
    return _checked(M.score(model, test))


@register("j2_gradient_boosting", _TEST_SQL)
def j2_gradient_boosting(spark, sf):
    model, test = _fit(spark, sf, M.gradient_boosting(max_iter=100, step_size=0.1, max_depth=3))
    return _checked(M.score(model, test))


@register("j3_mlp", _TEST_SQL)
def j3_mlp(spark, sf):
    data, _ = _prepared(spark, sf)
    d = len(data.select("features").first()[0])
    model = M.fit_balanced(M.mlp(d, max_iter=100), data.where(F.col("split") == "train"), use_smote=False)
    return _checked(M.score(model, data.where(F.col("split") == "test")))


@register("j4_area_safety_model")
def j4_area_safety_model(spark, sf):
    res = AS.train_area_safety(fx.incidents(spark, sf))
    return res.importances


@register("j4_area_safety_report")
def j4_area_safety_report(spark, sf):
    return AS.train_area_safety(fx.incidents(spark, sf)).report


def searched(estimator, grid, data, cut=0.2, folds=5):
    """The reference's whole path: the search on the training rows, the refit of the best point, and that model on the
    test rows, decided at ``cut``. A row for each point; the scores on the test rows stand with the best one."""
    found, model = M.grid_search_balanced(estimator, grid, data.where(F.col("split") == "train"), folds=folds)
    test = M.score(model, data.where((F.col("split") == "test") & F.col("label").isNotNull()))
    test = materialize(test.select("label", "p1", EV.threshold("p1", cut, strict=True).alias("pred")))
    f1, auc = M.f1_of_class1(test, pred="pred"), EV.roc_auc(test, score="p1").first()["auc"]
    best = max(range(len(found)), key=lambda i: found[i][1])
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(params.items())), mean, i == best, *((f1, auc) if i == best else (None, None)))
            for i, (params, mean) in enumerate(found)]
    return data.sparkSession.createDataFrame(rows, "params string, cv_f1 double, best boolean, test_f1 double, test_auc double")


def j5_rf_grid_search(spark, sf):
    """The whole of RF_GRID; not registered: see README."""
    return searched(M.random_forest(seed=42), M.RF_GRID, _prepared(spark, sf)[0])


def j5_gb_grid_search(spark, sf):
    """The whole of GB_GRID; not registered: see README."""
    return searched(M.gradient_boosting(seed=42), M.GB_GRID, _prepared(spark, sf)[0])


#: Axes of RF_GRID that this query searches, in two fits for each fold.
_J5_GRID = {"numTrees": [50, 100], "maxDepth": [10], "minInstancesPerNode": [1, 5]}


@register("j5_grid_search", "select * from (values " + ", ".join(
    f"('maxDepth=10, minInstancesPerNode={m}, numTrees={t}', true)" for t in _J5_GRID["numTrees"] for m in _J5_GRID["minInstancesPerNode"])
    + ") t(params, f1_valid)")
def j5_grid_search(spark, sf):
    data, _ = _prepared(spark, sf)
    found, _ = M.grid_search_balanced(M.random_forest(max_depth=10, seed=42), _J5_GRID, data.where(F.col("split") == "train"), folds=5)
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(params.items())), 0.0 <= f1 <= 1.0) for params, f1 in found]
    return spark.createDataFrame(rows, "params string, f1_valid boolean")


@lru_cache(maxsize=2)
def _forest_of(application: str, spark, sf):
    return _fit(spark, sf, M.random_forest(seed=42))


def _forest(spark, sf):
    """The forest of J1 (SMOTE, 100 trees, unlimited depth) and the test rows; one fit serves all queries on it."""
    return _forest_of(spark.sparkContext.applicationId, spark, sf)


@register("j6_batch_scoring", _TEST_SQL)
def j6_batch_scoring(spark, sf):
    model, test = _forest(spark, sf)
    return _checked(M.score(model, test))


@register("j6_node_scoring", _TEST_SQL.replace("true as p_valid, true as pred_valid", "true as p_equal, true as pred_equal"))
def j6_node_scoring(spark, sf):
    """J6 by a fold over the forest's node table, at J1's depth, against ``transform`` row by row."""
    model, test = _forest(spark, sf)
    mine = TR.score_by_nodes(M.score_by_transform(model, test, "theirs", "their_pred"), model)
    return mine.select("id", "label", (F.abs(F.col("p1") - F.col("theirs")) < 1e-9).alias("p_equal"), (F.col("pred") == F.col("their_pred")).alias("pred_equal"))


@register("j8_feature_importances")
def j8_feature_importances(spark, sf):
    model, test = _forest(spark, sf)
    return M.feature_importances(model, test)


def _compared(model, rows):
    """Importances by the model and from its nodes, feature by feature."""
    theirs = M.feature_importances(model, rows).withColumnRenamed("importance", "theirs")
    return M.importances_from_nodes(model, rows).join(theirs, "feature", "full")


def _equal_importances(model, rows):
    both = _compared(model, rows)
    total = both.agg(F.round(F.sum("importance"), 6).alias("total"))  # one row
    return both.join(F.broadcast(total)).select("feature", F.coalesce(F.abs(F.col("importance") - F.col("theirs")) < 1e-9, F.lit(False)).alias("equal"), "total")


def _feature_list_sql() -> str:
    names = "[" + ", ".join(f"'{c}'" for c in [*_I12_NUMS, "is_weekend"]) + "]"
    for column, levels in (("day_of_week", "dl"), ("location_description", "ll"), ("district", "tl")):
        names += f" || list_transform({levels}[2:], lambda x: '{column}_ohe_' || x)"
    return _i12_sql().split("select id, split, cast(label")[0] + f"select unnest({names}) as feature from lv"


@register("j8_importances_from_nodes", f"select feature, true as equal, cast(1 as double) as total from ({_feature_list_sql()})")
def j8_importances_from_nodes(spark, sf):
    """J8 recomputed by grouped aggregates over the node table: equal to the model's, summing to 1."""
    return _equal_importances(*_forest(spark, sf))


@register("w5_top_features")
def w5_top_features(spark, sf):
    return M.top_features(j8_feature_importances(spark, sf), 10)


@register("w5_top_from_nodes", f"select cast(place as bigint) as place, true as equal from range(1, 1 + least(10, (select count(*) from ({_feature_list_sql()})))) t(place)")
def w5_top_from_nodes(spark, sf):
    """W5 on the node table's importances: place by place as important as the model's top features."""
    both = _compared(*_forest(spark, sf))
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "feature"))  # noqa: E731  one row for each feature
    mine = M.top_features(both.select("feature", "importance"), 10).select(place("importance").alias("place"), "importance")
    theirs = M.top_features(both.select("feature", F.col("theirs").alias("importance")), 10).select(place("importance").alias("place"), F.col("importance").alias("other"))
    return mine.join(theirs, "place").select("place", (F.abs(F.col("importance") - F.col("other")) < 1e-9).alias("equal"))


@register("j4_importances_from_nodes", "select feature, true as equal, cast(1 as double) as total from (values "
          + ", ".join(f"('{c}')" for c in AS.PROFILE_FEATURES) + ") t(feature)")
def j4_importances_from_nodes(spark, sf):
    """The area model's importances recomputed from its nodes."""
    res = AS.train_area_safety(fx.incidents(spark, sf))
    return _equal_importances(res.model, res.model.transform(res.profile))


@register("j4_held_out_cells", INC + f", {CELLS}, prof as (select cell, count(*) as n from cells group by cell), "
          "lab as (select cell, cast(n >= (select quantile_cont(n, 0.75) from prof) as int) as label from prof), "
          "rk as (select cell, label, row_number() over (partition by label order by md5('42:' || cast(cell as varchar))) as r, "
          "count(*) over (partition by label) as m from lab) "
          "select cast(cell as bigint) as cell, cast(label as bigint) as label, true as p_equal, true as pred_equal from rk where r <= ceil(m * cast(0.3 as double))")
def j4_held_out_cells(spark, sf):
    """J4's held-out cells: their labels, and the area model's scores against its own nodes, cell by cell."""
    res = AS.train_area_safety(fx.incidents(spark, sf))
    test = PR.stratified_split(res.profile, "safety_label", "grid_cell", 0.3, 42).where("split = 'test'")
    scored = TR.score_by_nodes(M.score(res.model, test, "theirs", "their_pred"), res.model)
    return scored.select(F.col("grid_cell").alias("cell"), F.col("safety_label").alias("label"), (F.abs(F.col("p1") - F.col("theirs")) < 1e-9).alias("p_equal"),
                         (F.col("pred") == F.col("their_pred")).alias("pred_equal"))


@register("a9_model_roundtrip", INC + f", {CELLS} select distinct cast(cell as bigint) as cell, true as equal from cells")
def a9_model_roundtrip(spark, sf):
    res = AS.train_area_safety(fx.incidents(spark, sf))
    path = scratch_path(spark, f"a9-{uuid.uuid4().hex}")
    M.save_model(res.model, path)
    again = M.load_model(path)
    a = res.model.transform(res.profile).select("grid_cell", F.col("prediction").alias("before"))
    b = again.transform(res.profile).select("grid_cell", F.col("prediction").alias("after"))
    return a.join(b, "grid_cell").select(F.col("grid_cell").alias("cell"), (F.col("before") == F.col("after")).alias("equal"))


def _weekly(spark, sf):
    return TS.resample_counts(fx.incident_log(spark, sf), "W", series_cols=["series"])


@register("h6_global_lag_forecast")
def h6_global_lag_forecast(spark, sf):
    samples = TS.prepare_series(fx.incident_log(spark, sf), "W", 8, series_cols=["series"])
    return FC.global_lag_regressor(samples, "linear")


@register("h6_global_gbt_forecast")
def h6_global_gbt_forecast(spark, sf):
    samples = TS.prepare_series(fx.incident_log(spark, sf), "W", 8, series_cols=["series"])
    return FC.global_lag_regressor(samples, "gbt")


def _h7_sql() -> str:
    """AR(2) on first differences per series, solved in closed form (Cramer) from the same sums."""
    from .timeseries_queries import LOG, _resample_sql
    w = "over (partition by series order by period_end)"
    det = "(a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13))"
    d0 = "(b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3))"
    d1 = "(a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13))"
    d2 = "(a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13))"
    return (LOG + ", " + _resample_sql("W") + ", "
            f"a as (select series, period_end, cast(n as double) as y, lag(cast(n as double)) {w} as prev, "
            f"cast(n as double) - lag(cast(n as double)) {w} as d from filled), "
            f"b as (select *, lag(d, 1) {w} as d1, lag(d, 2) {w} as d2 from a), "
            "c as (select * from b where d2 is not null), "
            "s as (select *, case when row_number() over (partition by series order by period_end) - 1 < "
            "floor(count(*) over (partition by series) * 0.8) then 'train' else 'test' end as split from c), "
            "st as (select series, count(*) + 1e-9 as a11, sum(d1) as a12, sum(d2) as a13, sum(d1 * d1) + 1e-9 as a22, "
            "sum(d1 * d2) as a23, sum(d2 * d2) + 1e-9 as a33, sum(d) as b1, sum(d1 * d) as b2, sum(d2 * d) as b3 "
            "from s where split = 'train' group by series), "
            f"co as (select series, {d0} / {det} as c0, {d1} / {det} as c1, {d2} / {det} as c2 from st) "
            "select 'ar2_diff' as model, s.series, s.period_end, s.split, s.y as actual, "
            "round(s.prev + ((c0 + co.c1 * s.d1) + co.c2 * s.d2), 6) + 0.0 as predicted "
            "from s join co on co.series = s.series")


@register("h7_differenced_ar", _h7_sql())
def h7_differenced_ar(spark, sf):
    return FC.differenced_ar(_weekly(spark, sf), p=2)


def _h7_recursive_sql() -> str:
    """The same coefficients, iterated over the test horizon with a recursive CTE."""
    base = _h7_sql()
    head, tail = base.split("select 'ar2_diff' as model", 1)
    assert head.startswith("with ")
    head = "with recursive " + head[len("with "):]
    return (head.rstrip() + ", "
            "lt as (select series, arg_max(y, period_end) as n0, arg_max(d, period_end) as l10, "
            "arg_max(d1, period_end) as l20 from s where split = 'train' group by series), "
            "te as (select series, period_end, y, row_number() over (partition by series order by period_end) as h "
            "from s where split = 'test'), "
            "hz as (select series, max(h) as hmax from te group by series), "
            "rec(series, h, n, l1, l2) as (select series, 0, n0, l10, l20 from lt union all "
            "select r.series, r.h + 1, r.n + ((co.c0 + co.c1 * r.l1) + co.c2 * r.l2), "
            "(co.c0 + co.c1 * r.l1) + co.c2 * r.l2, r.l1 from rec r join co on co.series = r.series "
            "join hz on hz.series = r.series where r.h < hz.hmax) "
            "select 'ar2_diff_recursive' as model, te.series, te.period_end, 'test' as split, te.y as actual, "
            "round(rec.n, 6) + 0.0 as predicted from te join rec on rec.series = te.series and rec.h = te.h")


@register("h7_differenced_ar_recursive", _h7_recursive_sql())
def h7_differenced_ar_recursive(spark, sf):
    """H7 multi-step: the whole test horizon forecast from the end of training."""
    return FC.differenced_ar_recursive(_weekly(spark, sf), p=2)


@register("h8_trend_seasonal")
def h8_trend_seasonal(spark, sf):
    return FC.trend_seasonal(_weekly(spark, sf))


def _residual_sums(rows, residual, features, keys=()):
    """Mean of residual times feature over the training rows: 0 for a least-squares fit."""
    sums = rows.groupBy(*keys).agg(*[F.avg(residual * x).alias(name) for name, x in features.items()])
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), (F.round(F.col(name), 4) + 0.0).alias("mean_product")) for name in features])
    return sums.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


@register("h6_lag_forecast_residuals", "select feature, cast(0 as double) as mean_product from (values ('one'), "
          + ", ".join(f"('x{i}')" for i in range(8)) + ") t(feature)")
def h6_lag_forecast_residuals(spark, sf):
    """H6 (linear) solves its normal equations: residuals are orthogonal to every lag."""
    samples = materialize(TS.prepare_series(fx.incident_log(spark, sf), "W", 8, series_cols=["series"]))
    found = FC.global_lag_regressor(samples, "linear").select("series", "period_end", "predicted")
    rows = samples.where(F.col("split") == "train").join(found, ["series", "period_end"])
    span = F.when(F.col("scale_max") == F.col("scale_min"), 1.0).otherwise(F.col("scale_max") - F.col("scale_min"))
    residual = F.col("y_scaled") - (F.col("predicted") - F.col("scale_min")) / span
    return _residual_sums(rows, residual, {"one": F.lit(1.0), **{f"x{i}": F.col("x_scaled")[i] for i in range(8)}})


def _h8_residuals_sql() -> str:
    from .timeseries_queries import LOG, _resample_sql
    names = ", ".join(f"('{x}')" for x in ("one", "t", "s1", "c1", "s2", "c2", "s3", "c3"))
    return (LOG + ", " + _resample_sql("W") + " select series, feature, cast(0 as double) as mean_product "
            f"from (select distinct series from filled), (values {names}) t(feature)")


@register("h8_trend_seasonal_residuals", _h8_residuals_sql())
def h8_trend_seasonal_residuals(spark, sf):
    """H8 solves the normal equations of each series."""
    t = (F.row_number().over(Window.partitionBy("series").orderBy("period_end")) - 1).cast("double")
    rows = FC.trend_seasonal(_weekly(spark, sf)).withColumn("t", t).where(F.col("split") == "train")
    turn = {f"{n}{k}": f(F.col("t") * (2 * math.pi * k / (365.25 / 7))) for k in (1, 2, 3) for n, f in (("s", F.sin), ("c", F.cos))}
    # the trend is scaled to about 1, so that rounding means the same for all features
    return _residual_sums(rows, F.col("actual") - F.col("predicted"), {"one": F.lit(1.0), "t": F.col("t") / 100, **turn}, ["series"])


def _arima_features_sql() -> str:
    from .timeseries_queries import LOG, _resample_sql
    names = ", ".join(f"('{x}')" for x in ("one", "d1", "d2", "e1", "e2"))
    return (LOG + ", " + _resample_sql("W") + " select series, feature, cast(0 as double) as mean_product "
            f"from (select distinct series from filled), (values {names}) t(feature)")


@register("h7_arima_residuals", _arima_features_sql())
def h7_arima_residuals(spark, sf):
    """H7 with moving-average terms solves its normal equations: residuals are orthogonal to lags and innovations."""
    rows, feats = FC.arima_rows(_weekly(spark, sf))
    fitted = sum(F.col("coef")[i] * F.col(x) for i, x in enumerate(feats))
    train = materialize(rows.where("split = 'train'").withColumn("fitted", fitted))
    # innovations are as large as the counts: products are taken in units of their squares
    size = F.greatest(F.max(F.abs("_d")).over(Window.partitionBy("series")), F.lit(1.0))
    train = train.withColumn("size", size)
    return _residual_sums(train, (F.col("_d") - F.col("fitted")) / F.col("size"),
                          {x[1:]: F.col(x) / (F.lit(1.0) if x == "_one" else F.col("size")) for x in feats}, ["series"])


def _arima_test_sql() -> str:
    from .timeseries_queries import LOG, _resample_sql
    return (LOG + ", " + _resample_sql("W") + ", nn as (select series, period_end, n, row_number() over (partition by series order by period_end) - 12 as r, "
            "count(*) over (partition by series) - 11 as m from filled), "
            "te as (select series, period_end, n, r - floor(m * cast(0.8 as double)) as h from nn where r >= floor(m * cast(0.8 as double))) "
            "select series, period_end, cast(n as double) as actual, case when h = 0 then true end as first_step_equal from te")


@register("h7_arima_recursive", _arima_test_sql())
def h7_arima_recursive(spark, sf):
    """H7 with moving-average terms over the test horizon; its first step is the one-step forecast."""
    weekly = materialize(_weekly(spark, sf))
    one = FC.arima(weekly).select("series", "period_end", F.col("predicted").alias("one_step"))
    h = F.row_number().over(Window.partitionBy("series").orderBy("period_end"))
    both = FC.arima_recursive(weekly).join(one, ["series", "period_end"]).withColumn("h", h)
    return both.select("series", "period_end", "actual", F.when(F.col("h") == 1, F.abs(F.col("predicted") - F.col("one_step")) < 1e-6).alias("first_step_equal"))


_KNOTS, _L1 = 12, 1e-3


def _h8_optimal_sql() -> str:
    from .timeseries_queries import LOG, _resample_sql
    names = ", ".join(f"('{x}')" for x in ["one", "t", "s1", "c1", "s2", "c2", "s3", "c3", *[f"knot{i}" for i in range(1, _KNOTS + 1)]])
    return (LOG + ", " + _resample_sql("W") + f" select series, feature, true as optimal from (select distinct series from filled), (values {names}) t(feature)")


@register("h8_changepoint_optimality", _h8_optimal_sql())
def h8_changepoint_optimality(spark, sf):
    """H8 with changepoints meets its optimality conditions, feature by feature, on the rows themselves."""
    rows, names = FC.changepoint_rows(_weekly(spark, sf), _KNOTS, _L1)
    rows = rows.where("split = 'train'")
    fitted = F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("x").alias("v"), F.col("coef").alias("b"))).alias("p")
    slopes = (rows.withColumn("r", F.col("target") - fitted).select("series", "r", pairs)
              .groupBy("series", F.col("p.feature").alias("feature")).agg(F.avg(F.col("r") * F.col("p.v")).alias("slope"), F.max("p.b").alias("b")))
    free, tol = ~F.col("feature").startswith("knot"), 1e-6
    optimal = (F.when(free, F.abs("slope") < tol).when(F.col("b") == 0, F.abs("slope") <= _L1 + tol)
               .otherwise(F.abs(F.col("slope") - _L1 * F.signum("b")) < tol))
    return slopes.select("series", "feature", optimal.alias("optimal"))


@register("h8_trend_changepoints")
def h8_trend_changepoints(spark, sf):
    return FC.trend_changepoints(_weekly(spark, sf), _KNOTS, _L1)


@register("h9_model_comparison")
def h9_model_comparison(spark, sf):
    """H9 over the three forecasters' test periods."""
    samples = TS.prepare_series(fx.incident_log(spark, sf), "W", 8, series_cols=["series"])
    weekly = _weekly(spark, sf)
    allf = (FC.global_lag_regressor(samples, "linear")
            .unionByName(FC.differenced_ar(weekly, p=2)).unionByName(FC.trend_seasonal(weekly))
            .unionByName(FC.differenced_ar_recursive(weekly, p=2))
            .unionByName(FC.arima(weekly)).unionByName(FC.arima_recursive(weekly)).unionByName(FC.trend_changepoints(weekly)))
    return TS.regression_metrics(allf.where(F.col("split") == "test"), ["model"])


def _h9_sql() -> str:
    from .timeseries_queries import _K4_SQL
    one, many = _h7_sql(), _h7_recursive_sql()
    return (f"select model, {_K4_SQL} from (select * from ({one}) union all by name select * from ({many})) where split = 'test' group by model")


@register("h9_forecaster_comparison", _h9_sql())
def h9_forecaster_comparison(spark, sf):
    """H9 over fitted forecasters whose coefficients SQL finds in closed form: one step ahead, and the whole horizon."""
    weekly = _weekly(spark, sf)
    every = FC.differenced_ar(weekly, p=2).unionByName(FC.differenced_ar_recursive(weekly, p=2)).withColumn("predicted", F.round("predicted", 6))
    return TS.regression_metrics(every.where(F.col("split") == "test"), ["model"])


@register("d14_score_locations_model")
def d14_score_locations_model(spark, sf):
    """D14 plus the area model's probability for the nearest occupied cell."""
    inc = fx.incidents(spark, sf)
    pts = (S.drop_missing_coordinates(inc).groupBy("community_area")
             .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
             .select(F.concat(F.lit("area "), F.col("community_area").cast("string")).alias("name"),
                     "latitude", "longitude"))
    res = AS.train_area_safety(inc)
    return AS.score_with_model(res, pts, inc)


@register("k2_model_auc", with_views("incidents") + "select count(*) as rows, cast(sum(case arrest when 'true' then 1 else 0 end) as bigint) as positives, "
          "true as auc_valid from incidents where latitude is not null and longitude is not null and arrest in ('true', 'false') "
          "and substr(md5('42:' || cast(id as varchar)), 1, 8) < '33333333'")
def k2_model_auc(spark, sf):
    """K1/K2 on a fitted forest's test-set probabilities."""
    model, test = _forest(spark, sf)
    scored = materialize(M.score(model, test).select("label", "p1", "pred"))
    auc = EV.roc_auc(scored, "label", "p1").select("auc").scalar()
    m = EV.classification_metrics(scored, "label", "pred")
    return m.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"), (F.col("fn") + F.col("tp")).alias("positives"),
                    auc.between(0, 1).alias("auc_valid"))

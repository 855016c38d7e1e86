"""Registered queries: preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as PR
from . import fixtures as fx
from .registry import r6, register
from .sqlviews import with_views

INC = with_views("incidents")
SC = with_views("scored")
_H = "md5('42:' || cast(id as varchar))"
_SPLIT = f"case when substr({_H}, 1, 8) < '33333333' then 'test' else 'train' end"
_INC_SPLIT = INC + f", sp as (select *, {_SPLIT} as split from incidents)"


def _inc_split(spark, sf):
    return PR.random_split(fx.incidents(spark, sf), "id", 0.2, 42)


@register("i3_random_split", INC + f"select id, {_SPLIT} as split from incidents")
def i3_random_split(spark, sf):
    return _inc_split(spark, sf).select("id", "split")


@register("i4_stratified_split", SC + f"select id, cast(label as bigint) as label, case when row_number() over "
          f"(partition by label order by {_H}) <= ceil(0.3 * count(*) over (partition by label)) then 'test' "
          "else 'train' end as split from scored")
def i4_stratified_split(spark, sf):
    return PR.stratified_split(fx.scored(spark, sf), "label", "id", 0.3, 42).select("id", "label", "split")


#: Some labels unknown, as B4 leaves them for arrests that are neither true nor false.
_SCN = SC + ", scored_n as (select id, case when id % 13 <> 0 then label end as label from scored)"


def _scored_with_nulls(spark, sf):
    return fx.scored(spark, sf).withColumn("label", F.when(F.col("id") % 13 != 0, F.col("label")))


@register("i4_stratified_split_unknown_labels", _SCN + f" select id, cast(label as bigint) as label, case when row_number() over "
          f"(partition by label order by {_H}) <= ceil(0.3 * count(*) over (partition by label)) then 'test' "
          "else 'train' end as split from scored_n")
def i4_stratified_split_unknown_labels(spark, sf):
    return PR.stratified_split(_scored_with_nulls(spark, sf), "label", "id", 0.3, 42).select("id", "label", "split")


@register("i9_undersample_unknown_labels", _SCN + ", r as (select id, label, row_number() over (partition by label order by "
          f"{_H}) as rk, count(*) over (partition by label) as n from scored_n where label is not null), "
          "m as (select min(n) as n_min, arg_min(label, n) as least from r) select id, cast(label as bigint) as label from r, m "
          "where label = least or rk <= floor(n_min / 0.8)")
def i9_undersample_unknown_labels(spark, sf):
    return PR.undersample(_scored_with_nulls(spark, sf), "label", "id", 0.8, 42).select("id", "label")


@register("i5_median_impute", _INC_SPLIT + f" select id, split, {r6('coalesce(latitude, (select quantile_cont(latitude, 0.5) '
          'from sp where split = \'train\'))')} as latitude from sp")
def i5_median_impute(spark, sf):
    df = _inc_split(spark, sf)
    return PR.median_impute(df, ["latitude"], df.where(F.col("split") == "train")).select("id", "split", "latitude")


@register("i6_mode_impute", _INC_SPLIT + " select id, split, coalesce(location_description, (select location_description "
          "from sp where split = 'train' and location_description is not null group by 1 "
          "order by count(*) desc, 1 limit 1)) as location_description from sp")
def i6_mode_impute(spark, sf):
    df = _inc_split(spark, sf)
    return PR.mode_impute(df, ["location_description"], df.where(F.col("split") == "train")).select(
        "id", "split", "location_description")


def _std_sql(c):
    return (f"{r6(f'({c} - (select avg({c}) from sp where split = \'train\')) / '
                  f'(select case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end from sp where split = \'train\')')}"
            f" as {c}")


@register("i7_standardise", _INC_SPLIT + ", sp2 as (select *, hour(date) as hour from sp) select id, split, "
          + ", ".join(_std_sql(c).replace("from sp ", "from sp2 ") for c in ["hour", "district", "latitude"]) + " from sp2")
def i7_standardise(spark, sf):
    df = _inc_split(spark, sf).withColumn("hour", F.hour("date"))
    return PR.standardise(df, ["hour", "district", "latitude"], df.where(F.col("split") == "train")).select(
        "id", "split", "hour", "district", "latitude")


@register("i9_undersample", SC + ", r as (select id, label, row_number() over (partition by label order by "
          f"{_H}) as rk, count(*) over (partition by label) as n from scored), m as (select min(n) as n_min from "
          "(select distinct label, n from r)) select id, cast(label as bigint) as label from r where "
          "label = (select arg_min(label, n) from (select distinct label, n from r)) or rk <= floor((select n_min from m) / 0.8)")
def i9_undersample(spark, sf):
    return PR.undersample(fx.scored(spark, sf), "label", "id", 0.8, 42).select("id", "label")


@register("i11_class_weights", SC + ", c as (select label, count(*) as nc from scored group by label) "
          "select s.id, cast(s.label as bigint) as label, "
          f"{r6('(select sum(nc) from c) / ((select count(*) from c) * c.nc)')} as weight "
          "from scored s join c on c.label = s.label")
def i11_class_weights(spark, sf):
    return PR.class_weights(fx.scored(spark, sf), "label").select("id", "label", "weight")

"""Many-series count forecasting (H6-H8, re-aimed single-series models).

* H6 ``global_lag_regressor``: one model over all series' lag windows (the
  sequence model of the reference re-aimed as a lag-feature regressor);
  Spark ML fits it distributed.
* H7 ``differenced_ar``: ARIMA(p,1,0)-style autoregression on first
  differences, one set of coefficients per series.
  ``arima`` adds moving-average terms by two grouped regressions.
* H8 ``trend_seasonal``: linear trend + Fourier seasonality per series.
  ``trend_changepoints`` lets the trend bend, with an L1 penalty on the bends.

Per-series models are solved from sufficient statistics: one grouped
aggregate computes ``X'X`` and ``X'y`` for every series in a single pass (partial
aggregation, so a series holding a third of all rows is no hot spot), and a
``mapInPandas`` solves the tiny systems, one row per series. No series is
pulled to the driver or into one task as raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeseries import inverse_scale


def per_group_ols(df: DataFrame, group_cols: Sequence[str], feature_cols: Sequence[str], target: str,
                  ridge: float = 1e-9) -> DataFrame:
    """Least squares per group: ``(group..., coef array<double>)`` in feature order."""
    g, xs = list(group_cols), list(feature_cols)
    d = len(xs)
    xtx = [F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(d) for j in range(d)]
    xty = [F.sum(F.col(x) * F.col(target)) for x in xs]
    stats = df.where(F.col(target).isNotNull()).groupBy(*g).agg(
        F.array(*xtx).alias("_xtx"), F.array(*xty).alias("_xty"), F.count(F.lit(1)).alias("_n"))

    def solve(batches):
        for pdf in batches:
            coefs = []
            for a, b in zip(pdf["_xtx"], pdf["_xty"]):
                A = np.asarray(a, dtype=float).reshape(d, d)
                A = A + ridge * np.eye(d)
                coefs.append(np.linalg.lstsq(A, np.asarray(b, dtype=float), rcond=None)[0].tolist())
            out = pdf[g].copy()
            out["coef"] = coefs
            yield out

    schema = ", ".join([f"`{c}` {t}" for c, t in stats.select(*g).dtypes] + ["coef array<double>"])
    return stats.mapInPandas(solve, schema)


def _dot(coef: Column, cols: Sequence[str]) -> Column:
    return sum((F.element_at(coef, i + 1) * F.col(c) for i, c in enumerate(cols)), F.lit(0.0))


def _split_col(series_cols: Sequence[str], train_frac: float, order_col: str = "period_end",
               valid: Column | None = None) -> Column:
    """'train' for the first ``int(train_frac * n)`` usable rows of each series, else 'test'."""
    w = Window.partitionBy(*series_cols)
    rn = F.row_number().over(w.orderBy(order_col)) - 1
    return F.when(rn < F.floor(F.count(F.lit(1)).over(w) * F.lit(train_frac)), "train").otherwise("test")


def differenced_ar(counts: DataFrame, p: int = 2, series_cols: Sequence[str] = ("series",), value: str = "n",
                   train_frac: float = 0.8) -> DataFrame:
    """H7: one-step forecasts ``n_{t-1} + c0 + sum_i c_i * d_{t-i}`` with ``d = n - lag(n)``.

    Coefficients per series from the train rows. Returns
    ``(model, series..., period_end, split, actual, predicted)``.
    """
    s = list(series_cols)
    w = Window.partitionBy(*s).orderBy("period_end")
    y = F.col(value).cast("double")
    df = counts.withColumns({"_prev": F.lag(y, 1).over(w), "_d": y - F.lag(y, 1).over(w)})
    lags = {f"_d{i}": F.lag("_d", i).over(w) for i in range(1, p + 1)}
    df = df.withColumns(lags).withColumn("_one", F.lit(1.0))
    df = df.where(F.col(f"_d{p}").isNotNull())
    df = df.withColumn("split", _split_col(s, train_frac))
    feats = ["_one", *lags]
    coef = per_group_ols(df.where(F.col("split") == "train"), s, feats, "_d")
    out = df.join(coef, s)
    return out.select(F.lit(f"ar{p}_diff").alias("model"), *s, "period_end", "split",
                      y.alias("actual"), (F.col("_prev") + _dot(F.col("coef"), feats)).alias("predicted"))


def differenced_ar_recursive(counts: DataFrame, p: int = 2, series_cols: Sequence[str] = ("series",),
                             value: str = "n", train_frac: float = 0.8) -> DataFrame:
    """H7, multi-step: forecast the whole test horizon from the end of the train periods.

    As an ARIMA forecast does, each step feeds its own predicted difference
    back as a lag. Per series the recursion is a ``sequence`` + ``aggregate``
    fold over the horizon on one row (coefficients, last level, last ``p``
    differences); the predictions are exploded and joined to the test periods
    by step number. Returns test rows ``(model, series..., period_end, split,
    actual, predicted)``.
    """
    s = list(series_cols)
    w = Window.partitionBy(*s).orderBy("period_end")
    y = F.col(value).cast("double")
    df = counts.withColumn("_d", y - F.lag(y, 1).over(w))
    df = df.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, p + 1)}).withColumn("_one", F.lit(1.0))
    df = df.where(F.col(f"_d{p}").isNotNull()).withColumn("split", _split_col(s, train_frac))
    feats = ["_one", *[f"_d{i}" for i in range(1, p + 1)]]
    coef = per_group_ols(df.where(F.col("split") == "train"), s, feats, "_d")
    # state after the last train period: its level and its last p differences (newest first)
    last = (df.where(F.col("split") == "train").groupBy(*s)
              .agg(F.max_by(F.struct(y.alias("n"), F.array("_d", *[f"_d{i}" for i in range(1, p)]).alias("lags")),
                            F.col("period_end")).alias("st")))
    test = df.where(F.col("split") == "test").withColumn(
        "_h", F.row_number().over(Window.partitionBy(*s).orderBy("period_end")))
    horizon = test.groupBy(*s).agg(F.max("_h").alias("_H"))
    c = F.col("coef")

    def step(acc, _i):
        dhat = F.aggregate(F.zip_with(F.slice(c, 2, p), acc["lags"], lambda a, b: a * b), F.element_at(c, 1),
                           lambda t, v: t + v)
        lvl = acc["n"] + dhat
        return F.struct(lvl.alias("n"), F.concat(F.array(dhat), F.slice(acc["lags"], 1, p - 1)).alias("lags"),
                        F.array_append(acc["preds"], lvl).alias("preds"))

    init = F.struct(F.col("st.n").alias("n"), F.col("st.lags").alias("lags"),
                    F.array().cast("array<double>").alias("preds"))
    paths = (last.join(coef, s).join(horizon, s)
                 .select(*s, F.aggregate(F.sequence(F.lit(1), F.col("_H")), init, step)["preds"].alias("_preds")))
    preds = paths.select(*s, F.posexplode("_preds").alias("_pos", "predicted")).withColumn("_h", F.col("_pos") + 1)
    out = test.join(preds, [*s, "_h"])
    return out.select(F.lit(f"ar{p}_diff_recursive").alias("model"), *s, "period_end", "split",
                      y.alias("actual"), "predicted")


def arima_rows(counts: DataFrame, p: int = 2, q: int = 2, long: int = 8, series_cols: Sequence[str] = ("series",),
               value: str = "n", train_frac: float = 0.8) -> tuple[DataFrame, list[str]]:
    """The rows of an ARIMA(p,1,q) by Hannan and Rissanen, with ``coef`` and the names of its features.

    First a long autoregression of the differences is fitted for each series; its residuals stand for the
    innovations. Then the differences are regressed on their own last ``p`` values and the last ``q``
    innovations. Both fits are grouped aggregates over the train rows of all series at once.
    """
    s = list(series_cols)
    w = Window.partitionBy(*s).orderBy("period_end")
    y = F.col(value).cast("double")
    df = counts.withColumns({"_y": y, "_prev": F.lag(y, 1).over(w), "_d": y - F.lag(y, 1).over(w)})
    df = df.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, max(p, long) + 1)}).withColumn("_one", F.lit(1.0))
    df = df.where(F.col(f"_d{max(p, long)}").isNotNull())
    place, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*s))
    # the first q rows have no innovations before them: they only serve the long fit
    df = df.withColumns({"_use": place >= q, "split": F.when(place - q < F.floor((n - q) * F.lit(train_frac)), "train").otherwise("test")})
    far = ["_one", *[f"_d{i}" for i in range(1, long + 1)]]
    first = per_group_ols(df.where(F.col("split") == "train"), s, far, "_d").withColumnRenamed("coef", "_long")
    df = df.join(first, s).withColumn("_e", F.col("_d") - _dot(F.col("_long"), far))
    df = df.withColumns({f"_e{i}": F.lag("_e", i).over(w) for i in range(1, q + 1)}).where("_use")
    feats = ["_one", *[f"_d{i}" for i in range(1, p + 1)], *[f"_e{i}" for i in range(1, q + 1)]]
    return df.join(per_group_ols(df.where(F.col("split") == "train"), s, feats, "_d"), s), feats


def arima(counts: DataFrame, p: int = 2, q: int = 2, long: int = 8, series_cols: Sequence[str] = ("series",), value: str = "n",
          train_frac: float = 0.8) -> DataFrame:
    """H7 with moving-average terms, one step ahead: ``(model, series..., period_end, split, actual, predicted)``."""
    df, feats = arima_rows(counts, p, q, long, series_cols, value, train_frac)
    return df.select(F.lit(f"arima_{p}_1_{q}").alias("model"), *series_cols, "period_end", "split", F.col("_y").alias("actual"),
                     (F.col("_prev") + _dot(F.col("coef"), feats)).alias("predicted"))


def arima_recursive(counts: DataFrame, p: int = 2, q: int = 2, long: int = 8, series_cols: Sequence[str] = ("series",), value: str = "n",
                    train_frac: float = 0.8) -> DataFrame:
    """H7 with moving-average terms over the whole test horizon: forecast differences are fed back, innovations
    beyond the train rows are 0. A fold over the horizon on one row for each series."""
    s = list(series_cols)
    df, _ = arima_rows(counts, p, q, long, series_cols, value, train_frac)
    recent = lambda name, k: F.array(f"_{name}", *[f"_{name}{i}" for i in range(1, k)]) if k else F.array().cast("array<double>")
    state = F.struct(F.col("_y").alias("n"), recent("d", p).alias("d"), recent("e", q).alias("e"), "coef")
    last = df.where(F.col("split") == "train").groupBy(*s).agg(F.max_by(state, F.col("period_end")).alias("st"))
    test = df.where(F.col("split") == "test").withColumn("_h", F.row_number().over(Window.partitionBy(*s).orderBy("period_end")))
    horizon = test.groupBy(*s).agg(F.max("_h").alias("_H"))
    total = lambda c, x: F.aggregate(F.zip_with(c, x, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)

    def step(acc, _i):
        c = F.col("st.coef")
        d = F.element_at(c, 1) + total(F.slice(c, 2, p), acc["d"]) + (total(F.slice(c, 2 + p, q), acc["e"]) if q else F.lit(0.0))
        level = acc["n"] + d
        return F.struct(level.alias("n"), F.slice(F.concat(F.array(d), acc["d"]), 1, p).alias("d"),
                        F.slice(F.concat(F.array(F.lit(0.0)), acc["e"]), 1, q).alias("e") if q else acc["e"].alias("e"),
                        F.array_append(acc["preds"], level).alias("preds"))

    start = F.struct(F.col("st.n").alias("n"), F.col("st.d").alias("d"), F.col("st.e").alias("e"), F.array().cast("array<double>").alias("preds"))
    paths = last.join(horizon, s).select(*s, F.aggregate(F.sequence(F.lit(1), F.col("_H")), start, step)["preds"].alias("_preds"))
    steps = paths.select(*s, F.posexplode("_preds").alias("_pos", "predicted")).withColumn("_h", F.col("_pos") + 1)
    return test.drop("coef").join(steps, [*s, "_h"]).select(F.lit(f"arima_{p}_1_{q}_recursive").alias("model"), *s, "period_end", "split",
                                                            F.col("_y").alias("actual"), "predicted")


def lasso_by_gram(gram: np.ndarray, cross: np.ndarray, penalised: np.ndarray, l1: float, sweeps: int = 20_000, tol: float = 1e-12) -> np.ndarray:
    """Coefficients that minimise ``b'Gb/2 - c'b + l1 * sum |b_j|`` over the penalised j, by coordinate descent.
    The others are eliminated first, so the descent runs over the penalised ones alone."""
    free = ~penalised
    inverse = np.linalg.pinv(gram[np.ix_(free, free)])
    link = inverse @ gram[np.ix_(free, penalised)]
    own = gram[np.ix_(penalised, penalised)] - gram[np.ix_(penalised, free)] @ link
    want = cross[penalised] - link.T @ cross[free]
    b = np.zeros(int(penalised.sum()))
    slope = want.copy()  # want - own @ b
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if own[j, j] <= 1e-14:
                continue
            z = slope[j] + own[j, j] * b[j]
            new = np.sign(z) * max(abs(z) - l1, 0.0) / own[j, j]
            if new != b[j]:
                slope -= own[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * own[j, j])
                b[j] = new
        if moved < tol:
            break
    out = np.zeros(len(gram))
    out[penalised], out[free] = b, inverse @ cross[free] - link @ b
    return out


def changepoint_rows(counts: DataFrame, knots: int = 12, l1: float = 1e-3, period: float = 365.25 / 7, harmonics: int = 3,
                     series_cols: Sequence[str] = ("series",), value: str = "n", train_frac: float = 0.8) -> tuple[DataFrame, list[str]]:
    """The rows of a piecewise linear trend with seasonality: feature vector ``x``, ``target``, ``scale``, ``coef``; and the features' names.

    Hinges stand at ``knots`` even places in the first 0.8 of a series' train rows; time counts from 0 to 1
    over the train rows and values are divided by the greatest of them, so one ``l1`` suits all series. The Gram
    matrices of all series are one grouped aggregate of outer products; each row of it is solved on its own.
    """
    s = list(series_cols)
    every, w = Window.partitionBy(*s), Window.partitionBy(*s).orderBy("period_end")
    df = counts.withColumns({"split": _split_col(s, train_frac), "_t": (F.row_number().over(w) - 1).cast("double"), "_y": F.col(value).cast("double")})
    train = F.col("split") == "train"
    df = df.withColumns({"_tau": F.col("_t") / F.greatest(F.max(F.when(train, F.col("_t"))).over(every), F.lit(1.0)),
                         "scale": F.greatest(F.max(F.when(train, F.abs("_y"))).over(every), F.lit(1e-12))})
    turn = {f"{name}{k}": f(F.col("_t") * F.lit(2 * math.pi * k / period)) for k in range(1, harmonics + 1) for name, f in (("s", F.sin), ("c", F.cos))}
    hinge = {f"knot{i}": F.greatest(F.col("_tau") - F.lit(0.8 * i / (knots + 1)), F.lit(0.0)) for i in range(1, knots + 1)}
    names = ["one", "t", *turn, *hinge]
    d = len(names)
    df = df.withColumns({"x": F.array(F.lit(1.0), F.col("_tau"), *turn.values(), *hinge.values()), "target": F.col("_y") / F.col("scale")})
    full = F.concat("x", F.array("target"))
    outer = array_to_vector(F.flatten(F.transform("x", lambda a: F.transform(full, lambda b: a * b))))
    sums = df.where(train).withColumn("_outer", outer).groupBy(*s).agg(Summarizer.mean(F.col("_outer")).alias("m"))
    sums = sums.select(*s, vector_to_array("m").alias("m"))

    def solve(batches):
        penalised = np.array([n.startswith("knot") for n in names])
        for pdf in batches:
            out = pdf[s].copy()
            means = [np.asarray(m, dtype=float).reshape(d, d + 1) for m in pdf["m"]]
            out["coef"] = [lasso_by_gram(m[:, :d], m[:, d], penalised, l1).tolist() for m in means]
            yield out

    schema = ", ".join([f"`{c}` {t}" for c, t in sums.select(*s).dtypes] + ["coef array<double>"])
    return df.join(sums.mapInPandas(solve, schema), s), names


def trend_changepoints(counts: DataFrame, knots: int = 12, l1: float = 1e-3, period: float = 365.25 / 7, harmonics: int = 3,
                       series_cols: Sequence[str] = ("series",), value: str = "n", train_frac: float = 0.8) -> DataFrame:
    """H8 with changepoints: ``(model, series..., period_end, split, actual, predicted)``."""
    df, _ = changepoint_rows(counts, knots, l1, period, harmonics, series_cols, value, train_frac)
    fitted = F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) * F.col("scale")
    return df.select(F.lit("trend_changepoints").alias("model"), *series_cols, "period_end", "split", F.col("_y").alias("actual"), fitted.alias("predicted"))


def trend_seasonal(counts: DataFrame, period: float = 365.25 / 7, harmonics: int = 3,
                   series_cols: Sequence[str] = ("series",), value: str = "n", train_frac: float = 0.8) -> DataFrame:
    """H8: ``n ~ a + b t + sum_k (s_k sin(2 pi k t / P) + c_k cos(2 pi k t / P))`` per series."""
    s = list(series_cols)
    w = Window.partitionBy(*s).orderBy("period_end")
    t = (F.row_number().over(w) - 1).cast("double")
    df = counts.withColumns({"_one": F.lit(1.0), "_t": t})
    fourier = {}
    for k in range(1, harmonics + 1):
        ang = F.col("_t") * F.lit(2 * math.pi * k / period)
        fourier[f"_s{k}"] = F.sin(ang)
        fourier[f"_c{k}"] = F.cos(ang)
    df = df.withColumns(fourier).withColumn("split", _split_col(s, train_frac))
    feats = ["_one", "_t", *fourier]
    coef = per_group_ols(df.where(F.col("split") == "train").withColumn("_y", F.col(value).cast("double")),
                         s, feats, "_y")
    out = df.join(coef, s)
    return out.select(F.lit("trend_fourier").alias("model"), *s, "period_end", "split",
                      F.col(value).cast("double").alias("actual"), _dot(F.col("coef"), feats).alias("predicted"))


def global_lag_regressor(samples: DataFrame, kind: str = "linear", series_cols: Sequence[str] = ("series",),
                         seed: int = 42) -> DataFrame:
    """H6: one regressor over every series' scaled lag window (from ``prepare_series``).

    Fitted on train samples, applied to all; predictions are scaled back with
    each series' own min/max. Returns ``(model, series..., period_end, split, actual, predicted)``.
    """
    df = samples.withColumn("_xv", array_to_vector("x_scaled"))
    if kind == "linear":
        est = LinearRegression(featuresCol="_xv", labelCol="y_scaled", predictionCol="_p", regParam=0.0)
    elif kind == "gbt":
        est = GBTRegressor(featuresCol="_xv", labelCol="y_scaled", predictionCol="_p", maxIter=50, maxDepth=3,
                           seed=seed)
    else:
        raise ValueError(kind)
    model = est.fit(df.where(F.col("split") == "train"))
    out = model.transform(df)
    return out.select(F.lit(f"global_{kind}").alias("model"), *series_cols, "period_end", "split",
                      F.col("y").alias("actual"), inverse_scale(F.col("_p")).alias("predicted"))

"""Forecasters with moving-average terms and with changepoints, against numpy on each series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from citysense.operators import forecast as FC
from citysense.operators.timeseries import conformal_intervals


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    out = {}
    for name in ("a", "b"):
        e, d = rng.normal(size=130), np.zeros(130)
        for t in range(2, 130):
            d[t] = 0.3 * d[t - 1] - 0.2 * d[t - 2] + e[t] + 0.5 * e[t - 1]
        out[name] = (50 + np.cumsum(d)).round(4)
    rows = [(name, dt.date(2020, 1, 5) + dt.timedelta(weeks=i), float(v)) for name, y in out.items() for i, v in enumerate(y)]
    return out, spark.createDataFrame(rows, "series string, period_end date, n double").cache()


def hannan_rissanen(y, p=2, q=2, long=8, frac=0.8):
    d = np.diff(y, prepend=np.nan)
    lag = lambda x, k: np.concatenate([np.full(k, np.nan), x[:-k]])
    rows = np.arange(long + 1, len(y))
    n = len(rows) - q
    train_end = rows[0] + q + int(n * frac)
    far = np.column_stack([np.ones(len(y)), *[lag(d, k) for k in range(1, long + 1)]])
    fit = rows[rows < train_end]
    e = d - far @ np.linalg.lstsq(far[fit], d[fit], rcond=None)[0]
    near = np.column_stack([np.ones(len(y)), *[lag(d, k) for k in range(1, p + 1)], *[lag(e, k) for k in range(1, q + 1)]])
    use = rows[q:]
    fit = use[use < train_end]
    c = np.linalg.lstsq(near[fit], d[fit], rcond=None)[0]
    one = {t: y[t - 1] + near[t] @ c for t in use}
    t = train_end - 1
    level, ds, es, many = y[t], [d[t], d[t - 1]], [e[t], e[t - 1]], {}
    for t in use[use >= train_end]:
        step = c[0] + c[1:1 + p] @ ds + c[1 + p:] @ es
        level, ds, es = level + step, [step, ds[0]], [0.0, es[0]]
        many[t] = level
    return one, many


def test_arima_equals_numpy(series):
    values, df = series
    day = lambda r: (r.period_end - dt.date(2020, 1, 5)).days // 7
    one = {(r.series, day(r)): r.predicted for r in FC.arima(df).collect()}
    many = {(r.series, day(r)): r.predicted for r in FC.arima_recursive(df).collect()}
    for name, y in values.items():
        want_one, want_many = hannan_rissanen(y)
        assert {t for s, t in one if s == name} == set(want_one) and {t for s, t in many if s == name} == set(want_many)
        assert all(abs(one[name, t] - v) < 1e-5 for t, v in want_one.items())
        assert all(abs(many[name, t] - v) < 1e-5 for t, v in want_many.items())


def test_changepoints(spark):
    """A trend that bends once is followed; a heavy penalty leaves a straight line; the conditions hold."""
    t = np.arange(200)
    y = 10 + 0.1 * t + np.where(t > 80, 0.4 * (t - 80), 0) + 2 * np.sin(2 * np.pi * t / (365.25 / 7))
    df = spark.createDataFrame([("x", dt.date(2020, 1, 5) + dt.timedelta(weeks=int(i)), float(v)) for i, v in enumerate(y)], "series string, period_end date, n double")
    error = lambda l1: FC.trend_changepoints(df, l1=l1).where("split = 'train'").agg(F.max(F.abs(F.col("predicted") - F.col("actual")))).first()[0]
    assert error(1e-6) < 0.8 and error(10.0) > 3
    rng = np.random.default_rng(0)
    x, target = rng.normal(size=(80, 6)), rng.normal(size=80)
    penalised = np.array([False, False, True, True, True, True])
    b = FC.lasso_by_gram(x.T @ x / 80, x.T @ target / 80, penalised, 0.05)
    slope = x.T @ (target - x @ b) / 80
    assert np.abs(slope[~penalised]).max() < 1e-9
    for s, v in zip(slope[penalised], b[penalised]):
        assert abs(s) <= 0.05 + 1e-9 if v == 0 else abs(s - 0.05 * np.sign(v)) < 1e-9


def test_conformal_coverage_is_judged_on_other_rows(spark):
    rng = np.random.default_rng(1)
    rows = [("m", g, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.normal()), 0.0) for g in "abcd" for i in range(200)]
    rows += [("m", "short", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "model string, series string, period_end date, actual double, predicted double")
    out = conformal_intervals(df, alpha=0.1)
    assert out.columns == [*df.columns, "lower", "upper", "inside"]
    got = out.collect()
    assert len(got) == 4 * 40 + 1
    for g in "abcd":
        scores = sorted(abs(r[3]) for r in rows if r[1] == g)[:0] or sorted(abs(r[3]) for r in [x for x in rows if x[1] == g][:160])
        radius = scores[int(np.ceil(161 * 0.9)) - 1]
        assert all(abs(r.upper - radius) < 1e-12 and r.inside == (abs(r.actual) <= radius) for r in got if r.series == g)
    assert [(r.lower, r.inside) for r in got if r.series == "short"] == [(None, True)]
    assert 0.8 < np.mean([r.inside for r in got if r.series != "short"]) < 0.98

"""Exact statistics and metrics against brute force on small fixtures."""

import numpy as np
import pytest

from citysense.operators import evaluate as EV
from citysense.operators.stats import exact_quantiles, ordered_prefix


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = (rng.uniform(size=n) < 0.2).astype(int)
    s = np.round(rng.uniform(size=n) * 0.6 + 0.4 * y, 2)   # rounded -> many ties
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id long, label int, score double"), y, s


def _auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_matches_pairwise(scored):
    df, y, s = scored
    got = EV.roc_auc(df).first().auc
    assert got == pytest.approx(_auc_brute(y, s), abs=1e-12)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "label int, score double")
    assert EV.roc_auc(df).first().auc is None


def test_roc_and_pr_points(scored):
    df, y, s = scored
    roc = {r.threshold: r for r in EV.roc_curve(df).collect()}
    pr = {r.threshold: r for r in EV.pr_curve(df).collect()}
    P, N = y.sum(), (1 - y).sum()
    ap = 0.0
    for t in np.unique(s):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        assert roc[t].tp == tp and roc[t].fp == fp
        assert roc[t].tpr == pytest.approx(tp / P) and roc[t].fpr == pytest.approx(fp / N)
        assert pr[t].precision == pytest.approx(tp / (tp + fp)) and pr[t].recall == pytest.approx(tp / P)
        ap += ((s == t) & (y == 1)).sum() / P * tp / (tp + fp)
    assert EV.average_precision(df).first().average_precision == pytest.approx(ap)


def test_classification_metrics_and_confusion(scored):
    df, y, s = scored
    p = (s > 0.5).astype(int)
    d = df.withColumn("pred", EV.threshold("score", 0.5, strict=True))
    m = EV.classification_metrics(d).first()
    tp, fp = int(((p == 1) & (y == 1)).sum()), int(((p == 1) & (y == 0)).sum())
    fn, tn = int(((p == 0) & (y == 1)).sum()), int(((p == 0) & (y == 0)).sum())
    assert (m.tn, m.fp, m.fn, m.tp) == (tn, fp, fn, tp)
    assert m.precision == pytest.approx(tp / (tp + fp)) and m.recall == pytest.approx(tp / (tp + fn))
    cm = {(r.label, r.pred): r["count"] for r in EV.confusion_matrix(d).collect()}
    assert cm == {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}


def test_confusion_single_class_has_four_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    assert EV.confusion_matrix(df).count() == 4


def test_calibration_bins(scored):
    df, y, s = scored
    got = {r.bin: r for r in EV.calibration_curve(df).collect()}
    edges = np.linspace(0, 1, 11)[1:-1]
    ids = np.searchsorted(edges, s)
    for b in np.unique(ids):
        assert got[b].mean_predicted == pytest.approx(s[ids == b].mean())
        assert got[b].fraction_positive == pytest.approx(y[ids == b].mean())


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=997), 1)
    g = rng.integers(0, 3, size=997)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    qs = [0.025, 0.25, 0.5, 0.75, 0.975]
    got = exact_quantiles(df, "v", qs, ["g"], buckets=7).collect()
    for r in got:
        want = np.percentile(v[g == r.g], [q * 100 for q in qs])
        assert [r[f"q_{i}"] for i in range(len(qs))] == pytest.approx(want.tolist())
    whole = exact_quantiles(df, "v", [0.5], buckets=5).first().q_0
    assert whole == pytest.approx(np.median(v))


def test_ordered_prefix_matches_cumsum(spark):
    rng = np.random.default_rng(9)
    keys = rng.permutation(500).astype(float)
    w = rng.integers(1, 5, size=500)
    df = spark.createDataFrame([(float(k), int(x)) for k, x in zip(keys, w)], "k double, w long")
    got = {r.k: r.w_upto for r in ordered_prefix(df, "k", ["w"], buckets=9).collect()}
    order = np.argsort(keys)
    cum = np.cumsum(w[order])
    for k, c in zip(keys[order], cum):
        assert got[k] == c


def test_regression_and_log_loss(spark):
    from citysense.operators import timeseries as TS
    a = np.array([3.0, 0.0, 5.0, 2.0]); p = np.array([2.5, 1.0, 4.0, 2.0])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p)], "actual double, predicted double")
    m = TS.regression_metrics(df).first()
    assert m.mse == pytest.approx(np.mean((a - p) ** 2))
    assert m.r2 == pytest.approx(1 - np.sum((a - p) ** 2) / np.sum((a - a.mean()) ** 2))
    nz = a != 0
    assert m.mape == pytest.approx(np.mean(np.abs((a[nz] - p[nz]) / a[nz])) * 100)
    ll = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.0)], "label int, score double")
    want = np.mean([-np.log(0.9), -np.log(0.8), 100.0])
    assert EV.log_loss(ll).first().log_loss == pytest.approx(want)

"""Evaluation (K1-K12, J7, W6, W7): exact metrics as aggregates.

Curves and AUC are exact: scores are first pre-aggregated to one row per
distinct score (partial aggregation, so a score shared by a third of the rows
is one hash entry per task), then cumulative counts come from the
bucketed prefix sums of :mod:`.stats`, never from a single-task global window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .stats import ordered_prefix


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def threshold(prob: str | Column, t: float = 0.5, strict: bool = False) -> Column:
    """1 when ``p > t`` (strict) or ``p >= t``, else 0."""
    p = _c(prob)
    return F.when(p > t if strict else p >= t, 1).otherwise(0)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_aggs(label: str = "label", pred: str = "pred") -> list[Column]:
    y, p = _c(label), _c(pred)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return [cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
            cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp")]


def _ratios_from_counts(df: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return df.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """K1: accuracy, precision, recall, F1 (0 when undefined) and the four counts."""
    return _ratios_from_counts(df.groupBy(*group_cols).agg(*confusion_aggs(label, pred)))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """K3: ``(label, pred, count)`` for all four pairs, zeros included (one aggregate, then stacked)."""
    counts = df.groupBy(*group_cols).agg(*confusion_aggs(label, pred))
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(n).alias("count"))
                      for a, b, n in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return counts.select(*group_cols, F.explode(cells).alias("c")).select(*group_cols, "c.*")


def score_table(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score) with positive and negative counts, cumulated.

    Adds ``pos_upto``/``neg_upto`` (counts with score <= this score) and the
    group totals ``P``/``N``.
    """
    g = list(group_cols)
    y = _c(label)
    agg = df.where(_c(score).isNotNull() & y.isNotNull()).groupBy(*g, _c(score).alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"))
    # The prefix sums read this table several times (bucket bounds, bucket
    # totals, rows); checkpoint it once so the input is scanned and shuffled once.
    pre = ordered_prefix(materialize(agg), "score", ["pos", "neg"], g)
    return pre.withColumnsRenamed({"pos_total": "P", "neg_total": "N"})


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """K2: exact ROC AUC with ties counted one half; NULL when a class is absent."""
    t = score_table(df, label, score, group_cols)
    neg_below = F.col("neg_upto") - F.col("neg")
    contrib = F.col("pos").cast("double") * (neg_below.cast("double") + F.col("neg").cast("double") * 0.5)
    return t.groupBy(*group_cols).agg(
        F.try_divide(F.sum(contrib), F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """K7: one point per distinct score threshold: ``fpr``, ``tpr`` for predicting ``score >= threshold``."""
    t = score_table(df, label, score, group_cols)
    tp = F.col("P") - (F.col("pos_upto") - F.col("pos"))
    fp = F.col("N") - (F.col("neg_upto") - F.col("neg"))
    return t.select(*group_cols, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    F.try_divide(tp.cast("double"), F.col("P").cast("double")).alias("tpr"),
                    F.try_divide(fp.cast("double"), F.col("N").cast("double")).alias("fpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """K8: precision and recall per distinct score threshold."""
    t = score_table(df, label, score, group_cols)
    tp = F.col("P") - (F.col("pos_upto") - F.col("pos"))
    fp = F.col("N") - (F.col("neg_upto") - F.col("neg"))
    return t.select(*group_cols, F.col("score").alias("threshold"),
                    (tp.cast("double") / (tp + fp).cast("double")).alias("precision"),
                    F.try_divide(tp.cast("double"), F.col("P").cast("double")).alias("recall"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """K8: AP = sum over thresholds of (R_i - R_{i-1}) * P_i; the recall step at a threshold is pos/P."""
    t = score_table(df, label, score, group_cols)
    tp = F.col("P") - (F.col("pos_upto") - F.col("pos"))
    fp = F.col("N") - (F.col("neg_upto") - F.col("neg"))
    step = F.try_divide(F.col("pos").cast("double"), F.col("P").cast("double"))
    return t.groupBy(*group_cols).agg(F.sum(step * tp.cast("double") / (tp + fp).cast("double")).alias("average_precision"))


def calibration_curve(df: DataFrame, label: str = "label", prob: str = "score", n_bins: int = 10,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """K9: uniform bins on [0, 1]; mean predicted and fraction positive per non-empty bin.

    A probability on an inner edge belongs to the lower bin (edges from ``numpy.linspace``).
    """
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    p = _c(prob)
    bin_id = sum((p > F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return df.where(p.isNotNull()).groupBy(*group_cols, bin_id.alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg(_c(label).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class precision, recall, F1, support, plus accuracy, macro and weighted averages."""
    c = df.agg(*confusion_aggs(label, pred))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    rows = []
    for cls, t_, f_p, f_n, sup in [("0", tn, fn, fp, tn + fp), ("1", tp, fp, fn, tp + fn)]:
        pr, rc = _ratio(t_, t_ + f_p), _ratio(t_, t_ + f_n)
        rows.append((cls, pr, rc, _ratio(2 * t_, 2 * t_ + f_p + f_n), sup))
    macro = [sum((r[i] for r in rows), F.lit(0.0)) / 2 for i in (1, 2, 3)]
    weighted = [sum((r[i] * r[4] for r in rows), F.lit(0.0)) / total for i in (1, 2, 3)]
    rows.append(("macro avg", *macro, total))
    rows.append(("weighted avg", *weighted, total))
    rows.append(("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _ratio(tp + tn, total), total))
    arr = F.array(*[F.struct(F.lit(n).alias("class"), pr.alias("precision"), rc.alias("recall"),
                             f1.alias("f1_score"), sup.cast("long").alias("support")) for n, pr, rc, f1, sup in rows])
    return c.select(F.explode(arr).alias("r")).select("r.*")


def error_analysis_summary(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """K5: error rate and counts of errors, false positives, false negatives."""
    y, p = _c(label), _c(pred)
    return df.agg(F.avg((y != p).cast("double")).alias("error_rate"),
                  F.sum((y != p).cast("long")).alias("num_errors"),
                  F.sum(((p == 1) & (y == 0)).cast("long")).alias("num_false_positives"),
                  F.sum(((p == 0) & (y == 1)).cast("long")).alias("num_false_negatives"))


def error_analysis(df: DataFrame, features: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """K5: per feature, mean and population std over correct and error rows, mean over FP and FN rows.

    Features are stacked to long form and aggregated in one grouped pass.
    """
    y, p = _c(label), _c(pred)
    long = df.select(y.alias("_y"), p.alias("_p"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("s"))
    v = F.col("s.v")
    ok, err = F.col("_y") == F.col("_p"), F.col("_y") != F.col("_p")
    fp, fn = (F.col("_p") == 1) & (F.col("_y") == 0), (F.col("_p") == 0) & (F.col("_y") == 1)
    return long.groupBy(F.col("s.feature").alias("feature")).agg(
        F.avg(F.when(ok, v)).alias("correct_mean"), F.stddev_pop(F.when(ok, v)).alias("correct_std"),
        F.avg(F.when(err, v)).alias("error_mean"), F.stddev_pop(F.when(err, v)).alias("error_std"),
        F.avg(F.when(fp, v)).alias("fp_mean"), F.avg(F.when(fn, v)).alias("fn_mean"))


def compare_models(long: DataFrame, model: str = "model", label: str = "label", pred: str = "pred") -> DataFrame:
    """K6: per model, classification metrics, or regression metrics when the label has > 10 distinct values."""
    from .timeseries import regression_aggs
    numbers = long.withColumns({"_actual": _c(label).cast("double"), "_predicted": _c(pred).cast("double")})
    agg = numbers.groupBy(model).agg(
        F.count_distinct("_actual").alias("_k"), *confusion_aggs(label, pred), *regression_aggs("_actual", "_predicted"))
    out = _ratios_from_counts(agg)
    reg = F.col("_k") > 10
    cls_cols = ["accuracy", "precision", "recall", "f1_score"]
    return out.select(model, F.when(reg, "regression").otherwise("classification").alias("task"),
                      *[F.when(~reg, F.col(c)).alias(c) for c in cls_cols],
                      *[F.when(reg, F.col(c)).alias(c) for c in ("mse", "mae", "r2", "rmse", "mape")])


def to_long(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], var_name: str = "metric",
            value_name: str = "value") -> DataFrame:
    """Wide -> long (``unpivot``), values as double."""
    wide = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return wide.unpivot(list(id_cols), list(value_cols), var_name, value_name)


def comparison_table(df: DataFrame, label: str = "label", pred: str = "pred", model: str = "model") -> DataFrame:
    """Models x metrics in long form ``(model, metric, value)``."""
    m = classification_metrics(df, label, pred, [model])
    return to_long(m, [model], ["accuracy", "precision", "recall", "f1_score"])


def log_loss(df: DataFrame, label: str = "label", prob: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy (log terms clamped at -100, as BCE losses do) and MSE."""
    y, p = _c(label).cast("double"), _c(prob).cast("double")

    def clamped_ln(x):
        return F.greatest(F.ln(F.greatest(x, F.lit(1e-300))), F.lit(-100.0))
    bce = -(y * clamped_ln(p) + (F.lit(1.0) - y) * clamped_ln(F.lit(1.0) - p))
    return df.groupBy(*group_cols).agg(F.avg(bce).alias("log_loss"), F.avg((p - y) * (p - y)).alias("mse"))

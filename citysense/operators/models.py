"""Models (J1-J6, J8) and model persistence (A9) with ``pyspark.ml``.

Every fit is distributed by Spark ML itself (tree statistics are aggregated
per partition, L-BFGS gradients are tree-aggregated). Nothing here collects
rows; the only driver-side lists are model metadata (feature names,
importances: one entry per feature).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .boosting import can_boost, fit_boosted
from .forest import ENDS, GrownForest, can_grow, fit_forest, fit_forests
from .prepare import _ranked_by_hash, class_weights
from .sampling import smote
from .trees import is_boosted, node_importances, node_table, staged_scores, tree_model

SPARK_MAX_DEPTH = 30


def random_forest(label: str = "label", features: str = "features", num_trees: int = 100,
                  max_depth: int | None = None, min_instances_per_node: int = 1, seed: int = 42,
                  weight_col: str | None = None) -> RandomForestClassifier:
    """Random forest; ``max_depth=None`` (unlimited) maps to Spark's maximum (30), a depth that
    Spark can't grow raises."""
    if max_depth is not None and not 1 <= max_depth <= SPARK_MAX_DEPTH:
        raise ValueError(f"max_depth must be None or from 1 to {SPARK_MAX_DEPTH}, got {max_depth}")
    rf = RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=num_trees,
                                maxDepth=SPARK_MAX_DEPTH if max_depth is None else max_depth,
                                minInstancesPerNode=min_instances_per_node, seed=seed)
    return rf.setWeightCol(weight_col) if weight_col else rf


def gradient_boosting(label: str = "label", features: str = "features", max_iter: int = 100,
                      step_size: float = 0.1, max_depth: int = 3, subsampling_rate: float = 1.0, seed: int = 42,
                      weight_col: str | None = None) -> GBTClassifier:
    """Gradient-boosted trees."""
    gb = GBTClassifier(labelCol=label, featuresCol=features, maxIter=max_iter, stepSize=step_size,
                       maxDepth=max_depth, subsamplingRate=subsampling_rate, seed=seed)
    return gb.setWeightCol(weight_col) if weight_col else gb


def mlp(n_features: int, hidden: Sequence[int] = (128, 64), label: str = "label", features: str = "features",
        max_iter: int = 100, block_size: int = 64, seed: int = 42) -> MultilayerPerceptronClassifier:
    """Feed-forward network ``[d, 128, 64, 2]`` (sigmoid hidden layers, softmax output, L-BFGS)."""
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol=features,
                                          layers=[n_features, *hidden, 2], maxIter=max_iter,
                                          blockSize=block_size, seed=seed)


def classifier_pipeline(feature_cols: Sequence[str], estimator, features: str = "features") -> Pipeline:
    """Assembler + estimator, for frames with plain numeric feature columns."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(feature_cols), outputCol=features, handleInvalid="keep"),
                            estimator])


def score(model, df: DataFrame, prob_col: str = "p1", pred_col: str = "pred") -> DataFrame:
    """Batch scoring; positive-class probability and the 0/1 prediction as plain columns. Rows go to the
    subtrees of a grown forest; other models are transformed by Spark ML."""
    return _plain(model.scored(df) if isinstance(model, GrownForest) else model.transform(df), prob_col, pred_col)


def score_by_transform(model, df: DataFrame, prob_col: str = "p1", pred_col: str = "pred") -> DataFrame:
    """J6 by ``transform``: Spark ML's; the rows of a grown forest of many nodes walk down them by values and thresholds."""
    return _plain(model.transform(df), prob_col, pred_col)


def _plain(out: DataFrame, prob_col: str, pred_col: str) -> DataFrame:
    return out.withColumns({prob_col: vector_to_array("probability")[1],
                            pred_col: F.col("prediction").cast("int")})


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the slots of an assembled vector column (from its ML attributes)."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    if attrs:
        return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]
    return [f"feature_{i}" for i in range(meta.get("num_attrs", 0))]


def feature_importances(model, transformed: DataFrame, features: str = "features") -> DataFrame:
    """``(feature, importance)`` sorted descending; one driver-side entry per feature."""
    tree = model.stages[-1] if isinstance(model, PipelineModel) else model
    names = feature_names(transformed, features)
    imps = tree.featureImportances.toArray().tolist()
    if len(names) != len(imps):
        names = [f"feature_{i}" for i in range(len(imps))]
    spark = transformed.sparkSession
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(list(zip(names, imps)), schema).orderBy(F.desc("importance"), F.asc("feature"))


def importances_from_nodes(model, transformed: DataFrame, features: str = "features") -> DataFrame:
    """J8 from the node table: ``(feature, importance)`` of every feature, 0 for those that never split."""
    spark, names = transformed.sparkSession, feature_names(transformed, features)
    names = names or [f"feature_{i}" for i in range(tree_model(model).numFeatures)]
    named = spark.createDataFrame(list(enumerate(names)), "at int, feature string")  # one row for each feature
    own = node_importances(node_table(model, spark), is_boosted(model)).select(F.col("feature").alias("at"), "importance")
    return named.join(own, "at", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most important features."""
    return importances.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def stratified_folds(df: DataFrame, label: str = "label", id_col: str = "id", k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Fold ids 0..k-1 dealt round-robin in hash order within each class (exactly stratified)."""
    ranked = _ranked_by_hash(df, id_col, [label], seed)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n", "_h")


#: The grids of the arrest models. Unlimited depth is Spark's 30; a split needs twice as many rows as a leaf.
RF_GRID = {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2, 5]}
GB_GRID = {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]}


def balanced_rows(train: DataFrame, label: str = "label", features: str = "features", id_col: str = "id",
                  use_smote: bool = True, class_weight: str | dict | None = None, seed: int = 42) -> DataFrame:
    """The rows a classifier is fitted on, written once: labelled rows only, with SMOTE up to equal
    classes, or with a ``weight`` column (I11) for cost-sensitive fits."""
    known = train.where(F.col(label).isNotNull()).select(id_col, label, features)
    if use_smote:
        return materialize(smote(known, label, features, id_col, 1.0, seed=seed).select(label, features))
    if class_weight is not None:
        named = {"weights": class_weight} if isinstance(class_weight, dict) else {"mode": class_weight}
        return materialize(class_weights(known, label, **named).select(label, features, "weight"))
    return materialize(known.select(label, features))


def fit_balanced(estimator, train: DataFrame, label: str = "label", features: str = "features", id_col: str = "id",
                 use_smote: bool = True, class_weight: str | dict | None = None, seed: int = 42):
    """J1/J2 as trained by default: SMOTE on the training rows, then the fit. Without SMOTE a class
    weight sets the estimator's weight column."""
    rows = balanced_rows(train, label, features, id_col, use_smote, class_weight, seed)
    estimator = estimator.copy()
    return fitted(estimator.setWeightCol("weight") if "weight" in rows.columns else estimator, rows)


def fitted(estimator, rows: DataFrame):
    """The model on written rows: forests of two classes by :mod:`.forest`, whose work follows the rows of a node; boosted trees
    of two classes by :mod:`.boosting`, a job for each level; others by Spark ML."""
    if can_boost(estimator, rows):
        return fit_boosted(estimator, rows)
    return fit_forest(estimator, rows) if can_grow(estimator, rows) else estimator.fit(rows)


def f1_of_class1(scored: DataFrame, label: str = "label", pred: str = "prediction") -> float:
    y, p = F.col(label), F.col(pred)
    hit, said, true = scored.agg(*[F.count(F.when(c, 1)) for c in ((y == 1) & (p == 1), p == 1, y == 1)]).first()
    return 2 * hit / (said + true) if said + true else 0.0


#: Rows that one task of a small fit holds at least; fits of a search run side by side, so small data need few tasks each.
FIT_ROWS = 50_000


def staged_fits(grid: dict[str, list], boosted: bool) -> list[tuple[dict, list[tuple[dict, tuple[int, int]]]]]:
    """The fits that cover a whole grid: (parameters of the largest model, [(point, (trees, depth))]).

    Points that differ in the number of trees share a fit, and those of a forest that differ in depth too."""
    count = "maxIter" if boosted else "numTrees"
    staged = [count] if boosted else [count, "maxDepth"]
    fixed = [k for k in grid if k not in staged]
    fits = []
    for values in itertools.product(*[grid[k] for k in fixed]):
        own = dict(zip(fixed, values, strict=True))
        points = [own | dict(zip(staged, v, strict=True)) for v in itertools.product(*[grid[k] for k in staged])]
        largest = own | {k: max(grid[k]) for k in staged}
        fits.append((largest, [(p, (p[count], p["maxDepth"])) for p in points]))
    return fits


def grid_search_balanced(estimator, grid: dict[str, list], train: DataFrame, label: str = "label", features: str = "features",
                         id_col: str = "id", folds: int = 5, use_smote: bool = True, class_weight: str | dict | None = None,
                         parallelism: int = 8, seed: int = 42) -> tuple[list[tuple[dict, float]], object]:
    """Cross-validated search of a whole grid by the F1 of class 1, with SMOTE (or weights) inside each fold.

    The held-out rows of a fold are never oversampled, and no synthetic row is made from them. Each
    fold is prepared and written once. Points that are stages of one larger model share its fit (see
    :mod:`.trees`), and the fits of all folds run side by side. Forests of a fold that differ only in where
    their trees end are grown from the same bags. Returns the mean score of each point
    (first the first of the grid) and the best one refitted on all balanced training rows.
    """
    boosted = estimator.__class__.__name__.startswith("GBT")
    if boosted and estimator.getSubsamplingRate() != 1.0:
        raise ValueError("stages of a boosted fit are smaller fits only without subsampling")
    asked, count = list(grid), "maxIter" if boosted else "numTrees"
    grid = grid | {k: [estimator.getOrDefault(k)] for k in (count, "maxDepth") if k not in grid}
    fits = staged_fits(grid, boosted)
    dealt = materialize(stratified_folds(train.where(F.col(label).isNotNull()).select(id_col, label, features), label, id_col, folds, seed))

    def prepared(fold: int) -> tuple[DataFrame, DataFrame]:
        rows = balanced_rows(dealt.where(F.col("fold") != fold), label, features, id_col, use_smote, class_weight, seed)
        return rows.coalesce(max(1, -(-rows.count() // FIT_ROWS))), materialize(dealt.where(F.col("fold") == fold).select(label, features))

    def scored(rows: DataFrame, held: DataFrame, fits: list) -> list[tuple[dict, float]]:
        own = [estimator.copy({estimator.getParam(k): v for k, v in largest.items()}) for largest, _ in fits]
        own = [e.setWeightCol("weight") for e in own] if "weight" in rows.columns else own
        together = {p for largest, _ in fits for p in largest} <= ENDS | {count} and can_grow(own[0], rows)
        models = fit_forests(own, rows) if together else [fitted(e, rows) for e in own]
        return [s for model, (_, points) in zip(models, fits, strict=True) for s in scores(held, model, points)]

    def scores(held: DataFrame, model, points: list) -> list[tuple[dict, float]]:
        staged = staged_scores(held, model, [stage for _, stage in points], "_p", features)
        hit = [F.col("_p")[i] > 0.5 for i in range(len(points))]
        y = F.col(label) == 1
        sums = materialize(staged.select(label, "_p")).agg(*[F.count(F.when(c, 1)) for h in hit for c in (y & h, h, y)]).first()
        return [(p, 2 * sums[3 * i] / (sums[3 * i + 1] + sums[3 * i + 2]) if sums[3 * i + 1] + sums[3 * i + 2] else 0.0) for i, (p, _) in enumerate(points)]

    with ThreadPool(parallelism) as pool:
        if boosted:
            of_fold = pool.map(prepared, range(folds))
            found = pool.starmap(scored, [(*f, [fit]) for f in of_fold for fit in fits], chunksize=1)
        else:
            found = pool.map(lambda fold: scored(*prepared(fold), fits), range(folds), chunksize=1)
    points = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    sums = dict.fromkeys((tuple(sorted(p.items())) for p in points), 0.0)
    for point, f1 in itertools.chain.from_iterable(found):
        sums[tuple(sorted(point.items()))] += f1
    means = [sums[tuple(sorted(p.items()))] / folds for p in points]
    best = points[max(range(len(points)), key=lambda i: means[i])]
    model = fit_balanced(estimator.copy({estimator.getParam(k): v for k, v in best.items()}), train, label, features, id_col, use_smote, class_weight, seed)
    return [({k: p[k] for k in asked}, m) for p, m in zip(points, means, strict=True)], model


def grid_search(pipeline: Pipeline, grid, train: DataFrame, label: str = "label", fold_col: str = "fold",
                num_folds: int = 5, parallelism: int = 2, seed: int = 42):
    """Cross-validated grid search scored by the F1 of class 1 (``fMeasureByLabel``, label 1.0).

    ``train`` must carry ``fold_col`` (see :func:`stratified_folds`); folds are
    fixed by id, so the search is reproducible whatever the partitioning.
    """
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                                  metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator, foldCol=fold_col,
                        numFolds=num_folds, parallelism=parallelism, seed=seed)
    return cv.fit(train)


def cv_results(cv_model, grid) -> list[dict]:
    """Mean CV metric per parameter map (driver-side; one entry per grid point)."""
    out = []
    for params, metric in zip(grid, cv_model.avgMetrics):
        out.append({"params": {p.name: v for p, v in params.items()}, "f1_class1": float(metric)})
    return out


def param_grid(estimator, **values) -> list:
    """``ParamGridBuilder`` from keyword lists, e.g. ``numTrees=[50, 100]``."""
    b = ParamGridBuilder()
    for name, vals in values.items():
        b = b.addGrid(estimator.getParam(name), list(vals))
    return b.build()


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Read a fitted pipeline."""
    return PipelineModel.load(path)

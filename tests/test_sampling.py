"""Splits, folds and sampling with unknown labels and ids; exact neighbours; SMOTE beyond any cap."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from citysense.operators import models as M
from citysense.operators import prepare as PR
from citysense.operators import sampling as SM
from citysense.operators.neighbours import nearest_neighbours
from citysense.operators.stats import hash_cutoffs, ordered_prefix
from citysense.operators.timeseries import regression_metrics
from citysense.plans import model_queries


def labelled(spark, n=1000, extra=()):
    return spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(n)] + list(extra), "id long, label int")


def test_splits_lose_no_row(spark):
    df = labelled(spark, extra=[(5000, None), (None, 1), (None, None)])
    out = PR.stratified_split(df)
    assert out.count() == 1003
    sizes = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sizes[0, "test"] == 270 and sizes[1, "test"] in (31, 32)
    folds = M.stratified_folds(df)
    assert folds.count() == 1003 and folds.where("fold is null").count() == 0


def test_undersampling_ignores_unknown_labels(spark):
    assert PR.undersample(labelled(spark)).count() == 100 + 125
    assert PR.undersample(labelled(spark, extra=[(5000, None)])).count() == 100 + 125
    assert PR.undersample(labelled(spark).where("false")).count() == 0


@pytest.mark.parametrize(("digits", "most"), [(4, 100_000), (1, 3)])
def test_hash_cutoffs(spark, digits, most):
    df = labelled(spark, extra=[(7000, 2), (None, None)])
    h = PR.row_hash("id")
    for take in (0, 1, 37, 5000):
        cuts = hash_cutoffs(df, h, F.lit(take), ["label"], digits, most)
        rows = {r.label: r for r in cuts.collect()}
        for label in (0, 1, 2, None):
            own = sorted(r.h for r in df.where(F.col("label").eqNullSafe(label)).select(h.alias("h")).collect())
            assert rows[label].rows == len(own)
            assert rows[label].cut == (None if not take else own[min(take, len(own)) - 1])


def test_hash_cutoffs_of_repeated_hashes(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 5, "id long")
    h = PR.row_hash("id")
    hashes = sorted(df.select(h.alias("h")).distinct().toPandas()["h"])
    first = 50 if df.where("id = 1").select(h.alias("h")).first().h == hashes[0] else 5
    for take, want in ((1, hashes[0]), (first, hashes[0]), (first + 1, hashes[1]), (55, hashes[1])):
        assert hash_cutoffs(df, h, F.lit(take), [], 4, 10).first().cut == want


def test_prefix_sums_with_unknown_groups_and_many_buckets(spark):
    df = spark.createDataFrame([(g, float(k)) for g in ("a", None) for k in range(50)] + [("a", float("nan"))], "g string, k double").withColumn("w", F.lit(1))
    for buckets in (1, 7, 400):
        rows = ordered_prefix(df, "k", ["w"], ["g"], buckets).collect()
        assert len(rows) == 101
        assert all(r.w_upto == (51 if r.k != r.k else int(r.k) + 1) for r in rows)


def brute(x, ids, k):
    out = {}
    for i in range(len(x)):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - x[i, j]) ** 2
        out[ids[i]] = [b for _, b in sorted((float(d[j]), ids[j]) for j in range(len(x)) if j != i)[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "copies", "few"])
def test_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4 if kind == "few" else 260, 3))
    if kind == "copies":
        x = np.round(x)
        x[:90] = 1.0
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id long, x array<double>")
    rows = nearest_neighbours(df, 5, chunk=20, visitors=15).collect()
    assert {r.id: [n.id for n in r.neighbours] for r in rows} == brute(x, ids, 5)
    assert nearest_neighbours(df.where("false"), 5).count() == 0


def test_smote_beyond_the_old_cap(spark):
    n = 21_000
    df = (spark.range(n + 44_000).withColumn("label", (F.col("id") < n).cast("int"))
          .withColumn("features", array_to_vector(F.array(F.rand(1), F.rand(2), (F.col("id") % 7).cast("double")))))
    out = SM.smote(df, ratio=0.5)
    new = out.where("synthetic").select(vector_to_array("features").alias("x"), "label", "sample_key")
    assert new.count() == 1000 and new.select("sample_key").distinct().count() == 1000
    assert new.where("label != 1 or x[0] < 0 or x[0] > 1 or x[2] > 6").count() == 0


def test_training_rows(spark):
    df = labelled(spark, 300, [(900, None)]).withColumn("features", array_to_vector(F.array(F.col("id") * 1.0, F.lit(0.5))))
    sizes = {r.label: r["count"] for r in M.balanced_rows(df).groupBy("label").count().collect()}
    assert sizes == {0: 270, 1: 270}
    weights = {r.label: r.weight for r in M.balanced_rows(df, use_smote=False, class_weight="balanced").collect()}
    assert weights[1] == pytest.approx(5.0) and weights[0] == pytest.approx(300 / 540)
    rf = M.random_forest(num_trees=3, max_depth=3)
    found, model = M.grid_search_balanced(rf, {"maxDepth": [1, 2]}, df, folds=2)
    assert len(found) == 2 and all(0 <= f <= 1 for _, f in found) and model.getMaxDepth() in (1, 2)


def test_searches_cover_whole_grids_and_score_the_refitted_model(spark, monkeypatch):
    df = labelled(spark, 300, [(900, None)]).withColumns({
        "features": array_to_vector(F.array(F.col("id") * 1.0, F.lit(0.5))), "split": F.when(F.col("id") % 7 == 0, "test").otherwise("train")})
    out = model_queries.searched(M.random_forest(num_trees=3), {"maxDepth": [1, 2]}, df, folds=2).collect()
    assert [r.params for r in out] == ["maxDepth=1", "maxDepth=2"]
    (best,) = [r for r in out if r.best]
    assert best.cv_f1 == max(r.cv_f1 for r in out) and [r.test_f1 is None for r in out] == [not r.best for r in out]
    model = M.fit_balanced(M.random_forest(num_trees=3, max_depth=int(best.params[-1])), df.where("split = 'train'"))
    test = M.score(model, df.where("split = 'test' and label is not null")).withColumn("pred", (F.col("p1") > 0.2).cast("int"))
    assert best.test_f1 == pytest.approx(M.f1_of_class1(test, pred="pred")) and 0 <= best.test_auc <= 1
    asked = []
    monkeypatch.setattr(model_queries, "searched", lambda estimator, grid, data: asked.append((type(estimator).__name__, len(M.param_grid(estimator, **grid)))))
    monkeypatch.setattr(model_queries, "_prepared", lambda spark, sf: (None, None))
    for name in ("j5_rf_grid_search", "j5_gb_grid_search"):
        getattr(model_queries, name)(spark, "")
    assert asked == [("RandomForestClassifier", 27), ("GBTClassifier", 27)]


def test_depths_that_cannot_be_grown_raise():
    for depth in (0, 31, 50):
        with pytest.raises(ValueError):
            M.random_forest(max_depth=depth)


def test_constant_actuals(spark):
    df = spark.createDataFrame([("good", 2.0, 2.0), ("good", 2.0, 2.0), ("bad", 2.0, 3.0), ("bad", 2.0, 2.0)], "model string, actual double, predicted double")
    got = {r.model: r.r2 for r in regression_metrics(df, ["model"]).collect()}
    assert got == {"good": 1.0, "bad": 0.0}


def test_clustered_points_in_many_dimensions_visit_few_chunks(spark):
    """40 dimensions, 24 clusters: exact neighbours, and a vector visits less than a tenth of the chunks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 40)) * 4
    x = (centres[rng.integers(0, 24, 1500)] + rng.normal(size=(1500, 40)) * 0.3).round(6)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    watch = []
    got = {r.id: [n.id for n in r.neighbours] for r in nearest_neighbours(df, 5, chunk=60, watch=watch).select("id", "neighbours").collect()}
    assert got == brute(x, list(range(1500)), 5)
    chunks, vectors, visits = watch[0]
    assert chunks > 40 and visits / vectors < chunks / 10, watch


def test_few_chunks_are_searched_without_rounds(spark):
    """Some thousand points cost rounds of jobs, each shipping all vectors to every block; now one job compares them all."""
    x = np.random.default_rng(4).normal(size=(2_300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    watch = []
    got = {r.id: [n.id for n in r.neighbours] for r in nearest_neighbours(df, 3, watch=watch).select("id", "neighbours").collect()}
    assert watch[0][0] == 1 and got == brute(x, list(range(2_300)), 3)


def test_more_vectors_are_compared_tile_by_tile(spark, monkeypatch):
    """Where bounds prune little, rounds copied each vector to most of the chunks; copies, fractions and far values keep their order."""
    from citysense.operators import neighbours as N
    for name, value in (("FEW_CHUNKS", 0), ("LEAST_TILED", 100), ("TILE", 150), ("MOST_DISTANCES", 5_000)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.random((300, 6)), np.round(rng.random((150, 6))), 1e7 + rng.random((60, 6)), np.tile(rng.random((1, 6)), (9, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    watch = []
    got = {r.id: [n.id for n in r.neighbours] for r in nearest_neighbours(df, 4, chunk=30, watch=watch).select("id", "neighbours").collect()}
    assert watch[0][0] > 1 and watch[0][2] == watch[0][0] * watch[0][1]
    assert got == brute(x, list(range(len(x))), 4)


def test_the_gap_of_a_synthetic_row_is_hashed_once(spark):
    """Its hash stood in the function that is applied to each dimension, and was taken as often."""
    rows = [(i, int(i % 5 == 0), [float(i % 7), float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>").select("id", "label", array_to_vector("x").alias("features"))
    plan = SM.smote(df)._jdf.queryExecution().optimizedPlan().toString()
    inner = [part.split(", lambda")[0] for part in plan.split("lambdafunction(")[1:]]
    assert "zip_with" in plan and "md5" in plan and not any("md5" in part for part in inner)

"""Forests as node tables: scores, stages and importances equal those of Spark ML."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from citysense.operators import models as M
from citysense.operators import trees as TR
from citysense.operators.clean import assemble


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)).round(2)
    kind = rng.integers(0, 4, 240)
    y = ((x[:, 0] * x[:, 1] + (kind == 2) + rng.normal(size=240) * 0.5) > 0.3).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i]), float(kind[i] == 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double, c double, flag double")
    from pyspark.ml.feature import StringIndexer
    coded = StringIndexer(inputCol="kind", outputCol="code").fit(df.withColumn("kind", F.concat(F.lit("k"), F.col("id") % 4)))
    df = coded.transform(df.withColumn("kind", F.concat(F.lit("k"), F.col("id") % 4)))
    return assemble(df, ["a", "b", "c", "flag", "code"], "features").select("id", "label", "features").coalesce(1).cache()


def test_scores_equal_transform(data):
    for model in (M.random_forest(num_trees=7, seed=1).fit(data), M.gradient_boosting(max_iter=6, max_depth=3).fit(data)):
        for bound in (10, TR.MOST_NODES):  # one tree at a time, or all at once
            whole = (len(model.treeWeights), model.getMaxDepth())
            mine = TR.staged_scores(data, model, [whole], "p", most_nodes=bound).select("id", F.col("p")[0].alias("p"))
            both = model.transform(data).join(mine, "id").select(vector_to_array("probability")[1].alias("theirs"), "p").collect()
            assert max(abs(r.theirs - r.p) for r in both) < 1e-12 and len(both) == 240
        named = TR.score_by_nodes(data, model).join(model.transform(data).select("id", "prediction"), "id")
        assert named.where("pred <> prediction").count() == 0


def test_stages_of_a_boosted_fit_are_smaller_fits(data):
    model = M.gradient_boosting(max_iter=9, max_depth=3).fit(data)
    staged = TR.staged_scores(data, model, [(2, 3), (5, 3), (9, 3)], "p")
    for i, n in enumerate((2, 5, 9)):
        alone = M.gradient_boosting(max_iter=n, max_depth=3).fit(data).transform(data).select("id", vector_to_array("probability")[1].alias("q"))
        assert staged.join(alone, "id").agg(F.max(F.abs(F.col("p")[i] - F.col("q")))).first()[0] < 1e-9


def test_a_cut_tree_is_a_shallower_fit(data):
    """One tree over all rows and all features has no randomness, so the cut must give the same tree."""
    grown = lambda depth: RandomForestClassifier(numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="all", seed=5).fit(data)
    depths = [1, 2, 4, 8]
    staged = TR.staged_scores(data, grown(8), [(1, d) for d in depths], "p")
    for i, d in enumerate(depths):
        alone = grown(d).transform(data).select("id", vector_to_array("probability")[1].alias("q"))
        assert staged.join(alone, "id").agg(F.max(F.abs(F.col("p")[i] - F.col("q")))).first()[0] < 1e-12, d


def test_importances_equal_those_of_the_model(data):
    for model in (M.random_forest(num_trees=5, seed=2).fit(data), M.gradient_boosting(max_iter=4, max_depth=3).fit(data)):
        own = {r.feature: r.importance for r in M.importances_from_nodes(model, data).collect()}
        theirs = {r.feature: r.importance for r in M.feature_importances(model, data).collect()}
        assert own.keys() == theirs.keys() and abs(sum(own.values()) - 1) < 1e-9
        assert all(abs(own[k] - theirs[k]) < 1e-9 for k in own)


def test_staged_search_covers_the_grid(data):
    grid = {"numTrees": [2, 4], "maxDepth": [2, 3], "minInstancesPerNode": [1, 5]}
    found, model = M.grid_search_balanced(M.random_forest(seed=1), grid, data, folds=2, use_smote=False)
    assert [p for p, _ in found] == [dict(zip(grid, v)) for v in [(n, d, m) for n in (2, 4) for d in (2, 3) for m in (1, 5)]]
    assert all(0 <= f1 <= 1 for _, f1 in found)
    best = max(found, key=lambda x: x[1])[0]
    assert model.getNumTrees == best["numTrees"] and model.getMaxDepth() == best["maxDepth"]
    with pytest.raises(ValueError):
        M.grid_search_balanced(M.gradient_boosting(subsampling_rate=0.5), {"maxIter": [2]}, data, folds=2)

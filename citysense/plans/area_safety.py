"""End-to-end area safety job: grid -> labels -> cell profile -> forest -> report, importances, scoring.

Plan shape at scale: one scan of the incidents, one shuffle keyed by cell
(<= n_cells groups, partial aggregation), then everything downstream works on
<= n_cells rows (broadcast by construction), including the model fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import DEFAULT_GRID, Grid
from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import prepare as PR
from ..operators import spatial as S
from ..session import materialize

# Profile columns the classifier uses: everything except the cell id, its
# mean location and the label itself.
PROFILE_FEATURES = ["hour_mean", "hour_std", "day_of_week_mean", "day_of_week_std", "cell_crime_count",
                    "cell_arrest_rate", "cell_night_crime_rate", "cell_weekend_crime_rate", "is_night_mean",
                    "is_weekend_mean"]


@dataclass
class AreaSafetyResult:
    model: PipelineModel
    profile: DataFrame        # one row per occupied cell, with safety_label
    labels: DataFrame         # every cell: (cell, n, threshold, safety_label)
    report: DataFrame         # K10 on the held-out cells
    importances: DataFrame    # J8
    features: list


def train_area_safety(incidents: DataFrame, grid: Grid = DEFAULT_GRID, percentile: float = 75.0,
                      num_trees: int = 100, max_depth: int | None = None, seed: int = 42,
                      exclude_count: bool = False, test_frac: float = 0.3) -> AreaSafetyResult:
    """Forest on the cell profile, stratified 70/30 split by cell id hash.

    ``exclude_count`` drops ``cell_crime_count``, which defines the label and
    therefore leaks it (kept by default for parity).
    """
    feats = [c for c in PROFILE_FEATURES if not (exclude_count and c == "cell_crime_count")]
    prof = S.cell_profile(incidents, grid, percentile).withColumn("cell_arrest_rate",
                                                                  F.coalesce("cell_arrest_rate", F.lit(0.0)))
    prof = materialize(prof)  # <= n_cells rows, reused by split, fit, report and scoring
    split = PR.stratified_split(prof, "safety_label", "grid_cell", test_frac, seed)
    rf = M.random_forest(label="safety_label", num_trees=num_trees, max_depth=max_depth, seed=seed)
    model = M.classifier_pipeline(feats, rf).fit(split.where(F.col("split") == "train"))
    test = model.transform(split.where(F.col("split") == "test")).withColumn("pred", F.col("prediction").cast("int"))
    report = EV.class_report(test, "safety_label", "pred")
    importances = M.feature_importances(model, model.transform(prof))
    labels = S.area_safety(incidents, grid, percentile)
    return AreaSafetyResult(model, prof, labels, report, importances, feats)


def score_with_model(res: AreaSafetyResult, points: DataFrame, incidents: DataFrame,
                     grid: Grid = DEFAULT_GRID, percentile: float = 75.0) -> DataFrame:
    """D14 plus the model's probability of the nearest occupied cell's label.

    ``confidence`` keeps the reference's value (1.0 for an empty nearest
    centre, 0.7 otherwise); ``model_probability`` is the forest's probability
    of that label for the nearest occupied cell's profile.
    """
    scored = S.score_locations(points, incidents, grid, percentile)
    probs = res.model.transform(res.profile).select(
        F.col("grid_cell").alias("nearest_occupied_cell"), vector_to_array("probability").alias("_prob"))
    # probs has one row per occupied cell (<= n_cells)
    out = scored.join(F.broadcast(probs), "nearest_occupied_cell", "left")
    return out.select("name", "latitude", "longitude", "nearest_cell", "nearest_occupied_cell", "safety_label",
                      "confidence",
                      F.when(F.col("nearest_cell_count") > 0,
                             F.element_at("_prob", F.col("safety_label") + 1)).alias("model_probability"))

"""Plan-shape guards: the properties the scale design relies on, checked on physical plans."""

import pytest

import __spark_entry__ as E
from conftest import SMOKE_DIR

HEADLINE = ["d7_area_safety_label", "d12_nearest_centre", "d14_score_locations", "f11_cell_features",
            "f12_cell_profile", "d3_district_density", "h1_resample_weekly", "k2_roc_auc", "i4_stratified_split",
            "e3_all_features"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = _plan(E.queries()[name](spark, SMOKE_DIR))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_grid_counts_read_only_needed_columns(spark):
    df = E.queries()["d7_area_safety_label"](spark, SMOKE_DIR)
    fmt = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in fmt


def test_score_table_is_read_from_checkpoint(spark):
    # the per-score table is checkpointed: the AUC plan itself no longer scans the input
    plan = _plan(E.queries()["k2_roc_auc"](spark, SMOKE_DIR))
    assert "FileScan parquet" not in plan


def test_features_are_attached_without_shuffling_the_rows(spark):
    """With automatic broadcasts off, a table counted to be small is still broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("d3_district_density", "i4_stratified_split", "d13_nearest_occupied"):
            plan = _plan(E.queries()[name](spark, SMOKE_DIR))
            assert "SortMergeJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_correlation_scans_and_keeps_one_row_per_row(spark):
    plan = _plan(E.queries()["f10_correlation"](spark, SMOKE_DIR))
    assert plan.count("FileScan parquet") == 1 and plan.index("Generate") < plan.index("HashAggregate")


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from citysense.session import is_one_machine
    assert is_one_machine("local[4]") and is_one_machine("local")
    assert not any(map(is_one_machine, ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://x")))

"""Registered queries next to DuckDB, and the shape of the physical plans."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, connect
from studyframe.operators import metrics, split as sp
from studyframe.operators.labels import class_from_thresholds
from studyframe.plans.fixtures import KEYS, predictions, samples

SMALL = "/root/testdata/sf0.001"
COMPARED = "/root/testdata/sf0.01"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# A cross-section by default; ORACLE_ALL=1 runs every query that has SQL.
SOME = [
    "regression_metrics", "classification_metrics", "auc_ovr", "roc_points", "band_metrics", "diagnose", "rank_selection", "rank_ensemble", "scenario_sensitivity",
    "rank_recommended", "constraint_checks", "quality_status", "fold_summary", "importance_summary", "learning_summary", "corr_spearman", "dagostino_k2",
    "mann_whitney_median", "kruskal_wallis", "anova_type2", "split_stratified", "stratified_kfold", "learning_subsets", "scale_robust", "scale_minmax", "scale_maxabs", "impute_median", "encode_onehot", "target_mode", "class_report", "confusion_long", "ovr_points", "knn_classify", "final_ranking", "stream_quality",
]
NAMES = sorted(ORACLE) if os.environ.get("ORACLE_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(COMPARED)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    verdict = check(spark, duck, name, QUERIES[name], ORACLE[name], COMPARED)
    assert verdict.startswith("ok") and "types" not in verdict, verdict


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(ORACLE) > 120


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(r["selection_rank"] >= 1 for r in rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_level_plans_stay_distributed(spark):
    rows = samples(spark, SMALL)
    for df in (
        sp.kfold(rows, "partkey", 5), class_from_thresholds(rows, "y", 20.0, 60.0),
        metrics.regression_metrics(predictions(spark, SMALL), KEYS), metrics.r2_eps(predictions(spark, SMALL), KEYS),
    ):
        text = plan(df)
        assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_prefix_counts_meet_in_one_task(spark):
    """An exact-size split brings together nothing but the (at most 4096) counts per hash prefix."""
    text = plan(sp.split_grouped(samples(spark, SMALL), "grp", 0.2))
    before = text.split("SinglePartition")[1:]
    assert all(part.lstrip(", ENSURE_REQUIREMENTS").find("keys=[_prefix") >= 0 for part in before)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_needed_columns_and_push_filters(spark):
    from studyframe.sources.tables import read_table

    df = read_table(spark, SMALL, "lineitem").where("l_quantity > 49").select("l_tax")
    text = plan(df)
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text and "GreaterThan(l_quantity,49.0)" in text


def test_kfold_needs_no_shuffle_of_its_own(spark):
    rows = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert "Exchange" not in plan(sp.kfold(rows, "o_orderkey", 5)) and "Exchange" not in plan(sp.repeated_kfold(rows, "o_orderkey", 5, 3))

"""Cases that once went wrong: each would fail on the code before its mending."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyframe.operators import aggregates, cv, fit, labels, metrics, prep, split, stats
from studyframe.sources import stores


def test_fold_statistics_of_large_means(spark):
    rng = np.random.default_rng(1)
    y = 1e9 + rng.random(600)
    rows = spark.createDataFrame([(i % 3, float(v), float(v) + 0.1) for i, v in enumerate(y)], "fold int, y_true double, y_pred double")
    for r in aggregates.fold_summary(rows, []).collect():
        outside = y[np.arange(600) % 3 != r["fold"]]
        assert math.isclose(r["inner_target_std"], outside.std(ddof=1), rel_tol=1e-5)
        assert math.isclose(r["inner_target_mean"], outside.mean(), rel_tol=1e-12)


def test_labels_outside_the_list_count(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (1, 7), (0, 8), (9, 0), (1, None)], "y_true int, y_pred int").withColumn("m", F.lit("a"))
    table = metrics.confusion_long(rows, [0, 1], ["m"])
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in table.collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (0, None): 1, (1, None): 2, (None, 0): 1}
    score = metrics.classification_metrics(table, ["m"]).first()
    assert score["n"] == 6 and math.isclose(score["accuracy"], 2 / 6)
    assert {r["row"] for r in metrics.class_report(table, ["m"]).collect()} == {"0", "1", "macro avg", "weighted avg"}
    assert {r["label"] for r in metrics.ovr_points(table, ["m"]).collect()} == {0, 1}


def test_few_groups_are_never_split_over_folds(spark):
    rows = spark.range(300).selectExpr("id", "id % 3 as g", "case when id % 3 = 0 then 'a' else 'b' end as c")
    folds = split.stratified_group_kfold(rows, "g", "c", 5, key="id")
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 3


def test_a_second_split_leaves_nothing_behind(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as row_id", "cast(id as double) as x", "cast(id as double) as y", "case when id % 6 = 0 then 'test' else 'train' end as split")
    stores.write_split(rows, str(tmp_path), "t", "f", ["x"], "y")
    stores.write_split(rows, str(tmp_path), "t", "other", ["x"], "y")
    stores.write_split(rows.withColumn("split", F.lit("train")), str(tmp_path), "t", "f", ["x"], "y")
    assert stores.read_split(spark, str(tmp_path), "t", "f").count() == 300
    assert stores.read_split(spark, str(tmp_path), "t", "other", "test").count() == 50


def test_fingerprint_sums_past_the_range_of_a_long(spark):
    row = stores.fingerprint(spark.range(10).selectExpr("id")).first()
    assert row["n_rows"] == 10
    assert dict(stores.fingerprint(spark.range(1)).dtypes)["sum_hash"] == "decimal(38,0)"


def test_all_given_categories_are_found_among_many(spark):
    rows = spark.range(30_000).selectExpr("concat('v', id) as c")
    given = ["v7", "v12345", "v29999", "absent"]
    out = prep.encoder("onehot", ["c"], {"c": given}).fit(rows).transform(rows)
    sums = out.agg(*[F.sum(f"`c={v}`").alias(v) for v in given]).first().asDict()
    assert sums == {"v7": 1.0, "v12345": 1.0, "v29999": 1.0, "absent": 0.0}


def test_exponents_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = 1000 + 20 * rng.beta(6, 1, 4000)
    stage = prep.power("box-cox", ["x"])
    stage.fit(spark.createDataFrame([(float(v),) for v in x], "x double"))
    found = stage.lambdas["x"]

    def likelihood(lam):
        z = (x / np.exp(np.log(x).mean())) ** lam / lam
        return -len(x) / 2 * np.log(z.var())

    grid = np.arange(5.0, 800.0, 1.0)
    best = grid[np.argmax([likelihood(g) for g in grid])]
    assert best > 50 and likelihood(found) >= likelihood(best) - 0.5


def test_whole_grids_and_plain_values():
    grid = {"a": list(range(11)), "b": list(range(11))}
    assert len(cv.param_grid(grid)) == len(cv.param_grid(grid, "classification")) == 121
    assert len(cv.param_grid(grid, "classification", random_search=True)) == 40
    assert len(cv.param_grid(grid, quick=True)) == 20 and len(cv.param_grid(grid, cap=7)) == 7
    told = [cv.plain_value(v) for v in ("None", " yes ", "FALSE", "3", "-0.5", "1e-3", "sqrt", "nan", 4)]
    assert told == [None, True, False, 3, -0.5, 0.001, "sqrt", "nan", 4]


def test_limits_of_models_are_told():
    assert fit._ITER["max_iter"][1](3000, 10) == 3000
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert fit._depth(40) == 30
    assert said


def test_distinct_cuts_and_modes(spark):
    rows = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 6, 6]], "y double")
    assert labels._distinct_pick(rows, "y") == (2.5, 4.5)
    with pytest.raises(ValueError):
        labels._distinct_pick(rows.where("y < 3"), "y")
    facts = {r["column"]: r for r in labels.target_mode_facts(spark.createDataFrame([("1", "a"), ("1", "b"), (None, "b")], "p string, q string"), ["p", "q"]).collect()}
    assert (facts["p"]["n"], facts["p"]["n_distinct"], facts["p"]["n_unreadable"]) == (2, 1, 0)
    assert (facts["q"]["n"], facts["q"]["n_distinct"], facts["q"]["n_unreadable"]) == (3, 0, 3) and facts["q"]["mode"] == "categorical"
    assert labels.target_mode(rows, "y", " Existing-Classes ") == "categorical"


def test_all_points_by_default(spark):
    rows = spark.range(1000).selectExpr("cast(id * id as double) as v")
    assert stats.qq_points(rows, "v").count() == 1000
    assert stats.qq_points(rows, "v", k=100).count() <= 110

import pytest
from pyspark.sql import functions as F

from studyframe.functions.columns import model_name_parts, safe_name
from studyframe.operators import joins, quality, schema as sc, selection as sel
from studyframe.spec import StudySpec


def test_numbers_from_text(spark):
    texts = [" 1.5 ", "abc", "NaN", "", "1e3", "-2", "inf", "5d", ".5", None, "1,000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["t"] for r in sc.to_double(df, ["t"]).collect()] == [1.5, None, None, None, 1000.0, -2.0, None, None, 0.5, None, None]


def test_numeric_detection(spark):
    df = spark.createDataFrame([("1", "x", 1.0), ("2", "y", 2.0), (None, "3", None)], "a string, b string, c double")
    assert sc.detect_numeric(df) == ["a", "c"]
    with pytest.raises(ValueError, match="no numeric value"):
        sc.check_numeric(df.where("b <> '3'"), ["b"])


def test_column_matching():
    have = ["PI/FF", "Depth", "depth ", "Class 1", "x_y", "x-y"]
    with pytest.warns(UserWarning):
        got = sc.resolve_columns(["pi/ff", "PIFF", "class1", "Depth", "xy", "none"], have)
    assert got == {"pi/ff": "PI/FF", "PIFF": "PI/FF", "class1": "Class 1", "Depth": "Depth", "xy": None, "none": None}


def test_feature_set_policies_and_guard():
    spec = StudySpec(targets={"Y": {"a": ["p", "q"], "b": ["p", "zz"]}})
    with pytest.warns(UserWarning):
        assert {s for _, s, _, _ in sc.resolve_feature_sets(spec, ["y", "p", "q"])} == {"a"}
    assert {s for _, s, _, _ in sc.resolve_feature_sets(spec, ["y", "p", "q"], "lenient")} == {"a", "b"}
    with pytest.raises(ValueError, match="its own feature"):
        sc.leakage_guard(StudySpec(targets={"Y": {"a": ["y"]}}))
    assert StudySpec(targets={}, group_column="g").grouped and not StudySpec(targets={}, group_column="g", grouping_enabled=False).grouped
    assert StudySpec(targets={}, grids={"KNN": {"_cv_": 3}}).folds_for("KNN") == 3


def test_row_filters(spark):
    df = spark.createDataFrame([(float("inf"), None), (1.0, 2.0), (float("nan"), 3.0), (None, None)], "a double, b double")
    assert sc.drop_empty_rows(df).count() == 2 and sc.complete_cases(df, ["a", "b"]).count() == 1
    diff = sc.derive_difference(df, "d", "b", "a")
    assert diff.where("d = 1").count() == 1 and sc.derive_difference(diff, "d", "a", "b") is diff


def test_groups_must_be_named(spark):
    df = spark.createDataFrame([(1, " a "), (2, "None")], "id int, g string")
    with pytest.raises(ValueError, match="without a group"):
        sc.validate_groups(df, "g", ["id"])
    assert sc.validate_groups(df.where("id = 1"), "g").first()["g"] == "a"


def test_importance_names(spark):
    df = spark.createDataFrame([("f1", "a", 0.2), ("f1", "b", -0.5), ("f2", "a", 30.0)], "file string, Variable string, PermutationImportance double")
    got = [r["importance_pct"] for r in sc.normalize_importances(df).orderBy("file", "feature").collect()]
    assert got == [20.0, -50.0, 30.0]


def test_importances_of_files_with_other_names(spark):
    rows = [("f1", "a", 0.3, None, "0.25", None, None), ("f1", "b", -0.5, None, "0.75", None, None), ("f2", None, None, "5", None, "c", "0.1"), ("f2", None, None, "15", None, "d", "x"), ("f2", None, None, "15", None, "e", None)]
    df = spark.createDataFrame(rows, "file string, Variable string, MeanImportance double, importance string, `Contribution %` string, feature_name string, sd string")
    df = df.withColumnRenamed("Contribution %", "Relative Contribution")
    got = {r["feature"]: (r["mean_importance"], r["importance_std"], round(r["relative_contribution_pct"], 4), r["importance_rank_within_model"]) for r in sc.normalize_importances(df).collect()}
    assert got == {"a": (0.3, None, 25.0, 1), "b": (-0.5, None, 75.0, 2), "c": (5.0, 0.1, 14.2857, 2), "d": (15.0, None, 42.8571, 1), "e": (15.0, None, 42.8571, 1)}
    with pytest.raises(ValueError, match="no feature"):
        sc.normalize_importances(df.select("file", "importance"))


def test_quality_of_a_tiny_table(spark):
    df = spark.createDataFrame([(1, -1.0, 5.0), (2, 2.0, 101.0), (3, None, 5.0), (4, 2.0, 101.0)], "id int, a double, rate double")
    checks = {r["rule"]: r for r in quality.constraint_checks(df, ["a", "rate"], "id").collect()}
    assert checks["a_nonnegative"]["examples"] == "1" and checks["rate_in_0_100"]["n_violations"] == 2 and checks["rate_nonnegative"]["passed"]
    assert quality.duplicate_rows(df, ["a", "rate"]).first()[0] == 1
    missing = quality.missing_rate(df, ["a", "rate"])
    assert quality.quality_status(missing, quality.constraint_checks(df, ["a", "rate"], "id")).first()["status"] == "FAIL"
    assert quality.quality_status(missing, quality.constraint_checks(df, ["a"], "id"), fail=0.9, warn=0.9).first()["status"] == "WARN"


def test_joins_and_sets(spark):
    left = spark.createDataFrame([(1,), (2,)], "row_id int")
    meta = spark.createDataFrame([(1, "p")], "row_id int, project string")
    assert joins.attach_metadata(left, meta).count() == 2
    with pytest.raises(ValueError, match="repeats a key"):
        joins.attach_metadata(left, meta.union(meta))
    split = spark.createDataFrame([(1, "train"), (1, "test"), (9, "test")], "row_id int, split string")
    assert {r["row_id"]: r["problem"] for r in joins.split_coverage(left, split).collect()} == {1: "in several parts", 2: "in no part", 9: "unknown row"}
    names = spark.createDataFrame([("fs10",), ("fs2",), ("fs",)], "n string")
    assert [r["n"] for r in sel.natural_sort(names, "n").collect()] == ["fs", "fs2", "fs10"]


def test_pick_model(spark):
    lb = spark.createDataFrame([("best_a.pkl", 1), ("m2.pkl", 2), ("m3.pkl", 3)], "file string, selection_rank int")
    stored = spark.createDataFrame([("m3.pkl",), ("m2.pkl",), ("best_a.pkl",)], "file string")
    assert sel.pick_model(lb, stored).first()["file"] == "m2.pkl"
    assert sel.pick_model(lb, stored.union(spark.createDataFrame([("best.pkl",)], "file string"))).first()["file"] == "best.pkl"


def test_file_names(spark):
    df = spark.createDataFrame([("a/RF_fs2_AC_x.pkl",), ("best_fs1.pkl",), ("odd.pkl",)], "f string")
    rows = [tuple(r) for r in df.select(*model_name_parts(F.col("f"))).collect()]
    assert rows == [("RF", "fs2", "AC_x"), ("best", None, None), (None, None, None)]
    assert safe_name("PI/FF (%)") == "PI_FF"


def test_cv_scores_do_not_stand_for_train_scores(spark):
    """A leaderboard with cross-validated scores only has no train score, under any of their names."""
    lb = spark.createDataFrame([("RF", "fs1", 0.7)], "model string, feature_set string, cv_train_macro_f1 double")
    row = sc.normalize_leaderboard(lb, "classification").first()
    assert row["cv_macro_f1"] == 0.7 and row["train_macro_f1"] is None

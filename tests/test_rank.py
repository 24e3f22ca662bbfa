import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyframe.operators import aggregates as a, diagnose as d, rank as r, ranking, reports, sensitivity as s


@pytest.fixture(scope="module")
def board(spark):
    rng = np.random.default_rng(11)
    n = 60
    pdf = pd.DataFrame({"target": "t", "feature_set": [f"fs{i % 4}" for i in range(n)], "model": [f"m{i}" for i in range(n)]})
    for c in ("r2_train", "cv_r2_mean", "r2_test", "p20_test", "ioa_test", "ios_test"):
        pdf[c] = np.round(rng.random(n), 1)
    for c in ("cv_r2_std", "mae_test", "rmse_test", "mse_test"):
        pdf[c] = np.round(rng.random(n), 1)
    return pdf, d.gaps(spark.createDataFrame(pdf)).cache()


def test_ranks_match_pandas(spark):
    pdf = pd.DataFrame({"k": range(7), "v": [3.0, 1.0, None, 3.0, 2.0, None, 3.0]})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = df.select("k", ranking.rank_average("v", False).alias("a"), ranking.rank_min("v", False).alias("m"), ranking.rank_dense("v").alias("d")).orderBy("k").toPandas()
    assert got["a"].tolist() == pdf["v"].rank(ascending=False, na_option="bottom").tolist()
    assert got["m"].dropna().tolist() == pdf["v"].rank(ascending=False, method="min").dropna().tolist()
    assert got["d"].dropna().tolist() == pdf["v"].rank(ascending=False, method="dense").dropna().tolist()
    assert got["m"].isna().sum() == 2


def test_selection_rank_matches_pandas(board):
    pdf, lb = board
    rank = lambda c, up: c.rank(ascending=up, method="average", na_option="bottom")
    score = 0.6 * rank(pdf["cv_r2_mean"], False) + 0.2 * rank(pdf["cv_r2_std"], True) + 0.2 * rank((pdf["r2_train"] - pdf["cv_r2_mean"]).abs(), True)
    got = r.rank_selection(lb, "reg", tie_mode="raw").select("model", "selection_rank_score").toPandas().set_index("model")["selection_rank_score"]
    assert np.allclose(got[pdf["model"]].to_numpy(), score.to_numpy(), atol=1e-9)


def test_pair_counts_do_not_depend_on_blocks(board, monkeypatch):
    pdf, lb = board
    plain = r.pair_counts(lb, r.HIGHER, r.LOWER, ["target"], ["feature_set", "model"]).toPandas().set_index("model").sort_index()
    monkeypatch.setattr(r, "BLOCK", 7)
    cut = r.pair_counts(lb, r.HIGHER, r.LOWER, ["target"], ["feature_set", "model"]).toPandas().set_index("model").sort_index()
    pd.testing.assert_frame_equal(plain, cut)
    x = pdf[[*r.HIGHER, *r.LOWER]].to_numpy() * np.array([1] * 4 + [-1] * 3)
    for i, name in enumerate(pdf["model"]):
        others = np.delete(x, i, axis=0)
        assert plain.loc[name, "dominators"] == ((others >= x[i]).all(1) & (others > x[i]).any(1)).sum()
        assert plain.loc[name, "wins"] == (x[i] > others).sum()


def test_missing_test_scores_give_no_test_rank(board):
    _, lb = board
    out = r.rank_test(lb.drop("r2_test", "rmse_test", "mae_test"), "reg")
    assert out.where("test_performance_rank IS NOT NULL").count() == 0


def test_verdict_order(spark):
    rows = [(0.3, 0.2, 0.5, 0.2), (0.9, 0.5, 0.3, 0.5), (0.9, 0.5, 0.1, 0.5), (0.6, 0.5, 0.3, 0.5), (0.6, 0.5, 0.1, 0.2), (0.55, 0.5, 0.1, 0.5), (0.65, 0.5, 0.1, 0.5), (None, None, None, None)]
    lb = spark.createDataFrame(rows, "r2_train double, cv_r2_mean double, cv_r2_std double, r2_test double")
    got = [x["generalization_diagnosis"] for x in d.diagnose(lb, "reg_eval").collect()]
    assert got == ["Possible underfitting", "Overfitting with high CV instability", "Possible overfitting", "High CV instability", "Holdout-sensitive",
                   "Stable generalization", "Moderate generalization", "Moderate generalization"]


def test_weights_respect_limits_and_repeat(spark):
    w = s.monte_carlo_weights(spark, 200, 3, 1, [0], 0.5, 0.8).toPandas()
    assert w["simulation"].tolist() == list(range(1, 201)) and (w["w0"] >= 0.5).all() and w[["w0", "w1", "w2"]].max(axis=1).max() <= 0.8
    assert np.allclose(w[["w0", "w1", "w2"]].sum(axis=1), 1, atol=2e-6)
    assert s.monte_carlo_weights(spark, 200, 3, 1, [0], 0.5, 0.8).toPandas().equals(w)


def test_monte_carlo_and_final_table(board):
    _, lb = board
    out = reports.final_ranking(lb, simulations=50)
    assert out.count() == 60 and out.where("recommended_rank IS NULL").count() == 0
    row = out.orderBy("mc_mean_rank").first()
    assert row["mc_min_rank"] <= row["mc_median_rank"] <= row["mc_max_rank"] and 0 <= row["mc_top3_rate"] <= 1


def test_robustness_words(spark):
    df = spark.createDataFrame([(0.9, 1, 0.1), (0.7, 2, 0.1), (0.5, 9, 3.0), (0.1, 9, 1.0), (0.1, 9, 2.0), (None, 1, 0.0)], "a double, b int, c double")
    got = [x["v"] for x in df.select(s.robustness_verdict(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()]
    assert got == ["Highly robust", "Moderately robust", "Weight-sensitive", "Weight-sensitive", "Unstable selection", "Insufficient information"]


def test_contributions(spark):
    df = spark.createDataFrame([("p", 3.0), ("p", -1.0), ("n", -1.0), ("n", -3.0), ("z", 0.0)], "g string, mean_importance double")
    got = {(x["g"], x["mean_importance"]): x["relative_contribution_pct"] for x in a.relative_contribution(df, ["g"]).collect()}
    assert got == {("p", 3.0): 100.0, ("p", -1.0): 0.0, ("n", -1.0): 25.0, ("n", -3.0): 75.0, ("z", 0.0): None}
    assert a.abs_contribution(df, ["g"]).where("g = 'z'").first()["relative_contribution_percent"] == 0.0


def test_learning_curve_reading(spark):
    rows = [("t", "f", "m", 10, 0.9, 0.1, 0.40, 0.2), ("t", "f", "m", 20, 0.9, 0.1, 0.52, 0.1), ("t", "f", "one", 10, 0.5, 0.1, 0.48, 0.1)]
    curves = spark.createDataFrame(rows, "target string, feature_set string, model string, train_size int, train_mean double, train_sd double, cv_mean double, cv_sd double")
    got = {x["model"]: x for x in a.learning_summary(curves).collect()}
    assert got["m"]["validation_trend"] == "improving" and got["m"]["final_gap_level"] == "large" and got["m"]["more_data_likely_helpful"]
    assert got["one"]["recent_cv_gain"] == 0.0 and got["one"]["validation_trend"] == "near plateau"
    total = a.learning_by_feature_set(a.learning_summary(curves)).first()
    assert total["models"] == 2 and total["interpretation"] == "generally improving"

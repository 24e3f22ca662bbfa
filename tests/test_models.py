import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from studyframe.functions.columns import draw32
from studyframe.operators import cv, fit as ft, nested, prep
from studyframe.plans import flows
from studyframe.session import scratch_path
from studyframe.sources import stores
from studyframe.spec import StudySpec


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], "grp": [f"g{i % 12}" for i in range(n)], "a": rng.normal(size=n), "b": rng.exponential(size=n), "c": rng.choice(["u", "v", "w"], n)})
    pdf["label"] = 3 * pdf["a"] - pdf["b"] + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("fold", (draw32(F.lit(1), "grp") % 3).cast("int")).cache()
    return pdf, df


def test_scalers_use_population_formulas(data):
    pdf, df = data
    x = pdf["b"].to_numpy()
    q = np.quantile(x, [0.25, 0.5, 0.75])
    want = {"standard": (x - x.mean()) / x.std(), "minmax": (x - x.min()) / (x.max() - x.min()), "robust": (x - q[1]) / (q[2] - q[0]), "maxabs": x / abs(x).max()}
    for kind, values in want.items():
        got = prep.scaler(kind, ["b"]).fit(df).transform(df).toPandas().set_index("row_id")["b"]
        assert np.allclose(got[pdf["row_id"]], values)


def test_power_transforms_find_the_best_exponent(data):
    pdf, df = data
    for kind, c in (("yeo-johnson", "a"), ("box-cox", "b")):
        x = pdf[c].to_numpy()
        stage = prep.power(kind, [c])
        out = stage.fit(df).transform(df).toPandas()[c]
        assert abs(out.mean()) < 1e-9 and abs(out.std(ddof=0) - 1) < 1e-9

        def loglik(lam):
            with np.errstate(all="ignore"):
                if kind == "box-cox":
                    z, j = (x**lam - 1) / lam, np.log(x).sum()
                else:
                    z = np.where(x >= 0, ((1 + np.maximum(x, 0)) ** lam - 1) / lam, -((1 - np.minimum(x, 0)) ** (2 - lam) - 1) / (2 - lam))
                    j = (np.sign(x) * np.log(abs(x) + 1)).sum()
            return -len(x) / 2 * math.log(z.var()) + (lam - 1) * j

        lam = stage.lambdas[c]
        assert all(loglik(lam) >= loglik(lam + e) - 1e-6 for e in (-0.01, 0.01, 0.1, -0.1))
    with pytest.raises(ValueError, match="positive"):
        prep.power("box-cox", ["a"]).fit(df)


def test_quantile_transform_of_ties_and_many_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 12)), 1)
    x[:, 1], x[:, 2] = 7.0, np.where(x[:, 2] > 0, 1.0, 0.0)
    x[3, 0] = np.nan
    cols = [f"c {j}" for j in range(12)]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row], None) for i, row in enumerate(x)], "id int, " + ", ".join(f"`{c}` double" for c in cols) + ", none double")
    stage = prep.QuantileTransform([*cols, "none"], knots=50)
    model = stage.fit(df)
    assert max(len(s.getStatement()) for s in model.stages if hasattr(s, "getStatement")) < 3000
    got = model.transform(df).orderBy("id").toPandas()
    knots = prep._quantiles(df, cols, [i / 49 for i in range(50)])
    for j, c in enumerate(cols):
        v = x[:, j][~np.isnan(x[:, j])]
        q = np.array(knots[c])
        assert q == pytest.approx(np.quantile(v, np.linspace(0, 1, 50)))
        want = (np.interp(v, q, np.linspace(0, 1, 50)) - np.interp(-v, -q[::-1], -np.linspace(0, 1, 50)[::-1])) / 2
        want = np.where(v == q[0], 0.0, np.where(v == q[-1], 1.0, want))
        assert got[c].dropna().to_numpy() == pytest.approx(want, abs=1e-9), c
    assert got["none"].isna().all() and got["c 0"].isna().sum() == 1
    new = spark.createDataFrame([(1, *[-99.0] * 12, 1.0), (2, *[99.0] * 12, 1.0)], df.schema)
    model.write().save(str(tmp_path / "q"))
    from pyspark.ml import PipelineModel
    assert [set(r[1:13]) for r in PipelineModel.load(str(tmp_path / "q")).transform(new).select("id", *[f"`{c}`" for c in cols]).orderBy("id").collect()] == [{0.0}, {1.0}]


def test_quantile_transform(data):
    from statistics import NormalDist

    pdf, df = data
    got = prep.power("quantile_uniform", ["b"]).fit(df).transform(df).toPandas().set_index("row_id")["b"][pdf["row_id"]].to_numpy()
    want = (pdf["b"].rank().to_numpy() - 1) / (len(pdf) - 1)
    assert np.allclose(got, want, atol=1e-9)
    normal = prep.power("quantile_normal", ["b"]).fit(df).transform(df).toPandas().set_index("row_id")["b"][pdf["row_id"]].to_numpy()
    clipped = np.clip(want, 1e-7, 1 - 1e-7)
    assert np.allclose(normal, [NormalDist().inv_cdf(p) for p in clipped], atol=1e-9)


def test_spline_basis_sums_to_one(data):
    _, df = data
    stage = prep.spline(["a"], 5, 3)
    model = stage.fit(df.where("a BETWEEN -1 AND 1"))
    rows = model.transform(df).select(*stage.outputs()).toPandas().to_numpy()
    assert rows.shape[1] == 7 and np.allclose(rows.sum(axis=1), 1) and rows.min() > -1e-9


def test_encoders(data):
    _, df = data
    known = {"c": ["u", "v", "w"]}
    one = prep.encoder("onehot", ["c"], known, drop_first=True)
    out = one.fit(df.where("c <> 'w'")).transform(df)
    assert one.outputs() == ["c=v", "c=w"] and out.agg(F.sum("`c=w`")).first()[0] == 0.0
    ordinal = prep.encoder("ordinal", ["c"], known).fit(df.where("c <> 'w'")).transform(df)
    assert {r["c"]: r["c_code"] for r in ordinal.select("c", "c_code").distinct().collect()} == {"u": 0.0, "v": 1.0, "w": -1.0}


def test_pipeline_with_everything_is_saved_and_loaded(spark, data):
    _, df = data
    config = {"power_transform": "yeo-johnson", "scaling": "standard", "normalization": "l2", "polynomial_features": True, "spline_features": True,
              "categorical_columns": ["c"], "numeric_columns": ["a", "b"], "categorical_encoding": "onehot"}
    stages, names = prep.build_preprocessor(config, ["a", "b", "c"], df)
    model = Pipeline(stages=stages).fit(df)
    path = scratch_path(spark, "m")
    stores.save_model(model, {"features": ["a", "b", "c"], "target": "label"}, path, spark)
    loaded, meta = stores.load_model(path, spark)
    one, two = (m.transform(df).orderBy("row_id").select("features").limit(20).collect() for m in (model, loaded))
    assert one == two and len(one[0][0]) == len(names) and meta["target"] == "label"
    with pytest.raises(ValueError, match="lacks"):
        stores.save_model(model, {}, path, spark)


def test_linear_fit_and_scoring(data):
    pdf, df = data
    c = cv.Candidate("regression", "MLR", ["a", "b"])
    model = cv.fit(df, c)
    x = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b"]])
    want = x @ np.linalg.lstsq(x, pdf["label"], rcond=None)[0]
    got = cv.score_batch(model, df, ["a", "b"], ["row_id"]).toPandas().set_index("row_id")["prediction"][pdf["row_id"]]
    assert np.allclose(got, want, atol=1e-6)
    with pytest.raises(ValueError, match="missing"):
        cv.score_batch(model, df.drop("a"), ["a", "b"])


def test_ridge_matches_closed_form(data):
    pdf, df = data
    model = cv.fit(df, cv.Candidate("regression", "RIDGE", ["a", "b"], preprocessing={"scaling": "none"}), {"alpha": 50.0})
    x = pdf[["a", "b"]].to_numpy() - pdf[["a", "b"]].to_numpy().mean(0)
    beta = np.linalg.solve(x.T @ x + 50 * np.eye(2), x.T @ (pdf["label"] - pdf["label"].mean()))
    assert np.allclose(model.stages[-1].coefficients.toArray(), beta, rtol=1e-4)


def test_elastic_net_optimality(data):
    """At the optimum the gradient of the squared error balances both penalties."""
    pdf, df = data
    alpha, ratio = 0.3, 0.4
    model = cv.fit(df, cv.Candidate("regression", "EN", ["a", "b"], preprocessing={"scaling": "none"}), {"alpha": alpha, "l1_ratio": ratio, "max_iter": 500})
    w = model.stages[-1].coefficients.toArray()
    x = pdf[["a", "b"]].to_numpy() - pdf[["a", "b"]].to_numpy().mean(0)
    gradient = x.T @ (x @ w - (pdf["label"] - pdf["label"].mean())) / len(pdf)
    assert np.allclose(gradient + alpha * ratio * np.sign(w) + alpha * (1 - ratio) * w, 0, atol=2e-3)


def test_grids(spark):
    raw = {"a": [1, "2", "none"], "b": "true", "_cv_": 3, "_n_jobs_": -1}
    assert cv.param_grid(raw) == [{"a": 1, "b": True}, {"a": 2, "b": True}, {"a": None, "b": True}]
    big = {"a": list(range(30)), "b": list(range(30))}
    assert len(cv.param_grid(big)) == 900 and len(cv.param_grid(big, quick=True)) == 20 and len(cv.param_grid(big, cap=50)) == 50
    assert len(cv.param_grid(big, "classification", random_search=True)) == 40 and len(cv.param_grid(big, "regression", random_search=True)) == 900
    assert cv.param_grid(big, cap=50)[:20] == cv.param_grid(big, quick=True) and all(c in cv.param_grid(big) for c in cv.param_grid(big, quick=True))
    with pytest.warns(UserWarning, match="no counterpart"):
        ft.make_estimator("regression", "DT", {"max_depth": None, "ccp_alpha": 0.1})
    with pytest.raises(ValueError, match="unknown"):
        ft.make_estimator("regression", "NOPE")


def test_search_and_nested_cv(data):
    _, df = data
    c = cv.Candidate("regression", "DT", ["a", "b"])
    best, table = cv.grid_search_cv(df, c, [{"max_depth": 1}, {"max_depth": 6}], "fold", 3)
    assert best == {"max_depth": 6} and table.count() == 2
    inner = lambda rows, seed: rows.withColumn("inner_fold", (draw32(F.lit(seed), "grp") % 2).cast("int"))
    folds, pred = nested.nested_cv(df, c, [{"max_depth": 1}, {"max_depth": 6}], "fold", 3, inner, 2, group="grp")
    assert folds.count() == 3 and pred.count() == df.count() and pred.select("row_id").distinct().count() == df.count()
    assert {r["best_params"] for r in folds.collect()} == {'{"max_depth": 6}'}
    leaky = df.withColumn("fold", (draw32(F.lit(1), "row_id") % 3).cast("int"))
    with pytest.raises(ValueError, match="more than one outer fold"):
        nested.nested_cv(leaky, c, [{}], "fold", 3, inner, 2, group="grp")


def test_nested_fold_rows_equal_numpy(data):
    """Two repeats of a linear model, every number of a fold row against a fit by hand."""
    pdf, df = data
    c = cv.Candidate("regression", "MLR", ["a", "b"])
    df = df.withColumn("again", (draw32(F.lit(77), "grp") % 3).cast("int"))
    pdf = pdf.merge(df.select("row_id", "again").toPandas(), on="row_id")
    pdf["fold"] = pdf["row_id"].map({r["row_id"]: r["fold"] for r in df.collect()})
    folds, pred = nested.nested_cv(df, c, [{}], ["fold", "again"], 3, None, 2, group="grp", group_lists=True, outer_parallelism=3)
    rows = {(r["outer_repeat"], r["outer_fold"]): r for r in folds.collect()}
    assert len(rows) == 6 and pred.count() == 2 * len(pdf)
    for (repeat, f), r in rows.items():
        out = (pdf["again"] if repeat else pdf["fold"]) == f
        x = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b"]])
        beta = np.linalg.lstsq(x[~out], pdf["label"][~out], rcond=None)[0]
        e, y = x @ beta - pdf["label"], pdf["label"]
        r2 = lambda m: 1 - (e[m] ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum()
        want = {
            "n_inner_train": (~out).sum(), "n_outer_validation": out.sum(), "train_r2": r2(~out), "outer_r2": r2(out), "outer_mae": e[out].abs().mean(),
            "outer_rmse": np.sqrt((e[out] ** 2).mean()), "outer_bias": e[out].mean(), "outer_target_mean": y[out].mean(), "outer_target_std": y[out].std(),
            "outer_target_min": y[out].min(), "outer_target_max": y[out].max(), "inner_target_mean": y[~out].mean(), "inner_target_std": y[~out].std(),
            "train_outer_gap": r2(~out) - r2(out), "n_train_groups": pdf["grp"][~out].nunique(), "n_validation_groups": pdf["grp"][out].nunique(), "group_overlap_count": 0,
        }
        assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-5, abs=1e-6)
        assert json.loads(r["train_groups"]) == sorted(set(pdf["grp"][~out].astype(str))) and r["best_params"] == "{}"
    groups = nested.group_rows(pred, c, "grp")
    assert groups.count() == 2 * pdf["grp"].nunique() and groups.agg(F.sum("n_samples")).first()[0] == 2 * len(pdf)


def test_nested_fold_rows_of_classes_and_single_rows(spark):
    rows = [(0, 0, k % 3 == 0, f"g{k % 3}", float(k % 2), float(k % 4 == 1)) for k in range(12)] + [(0, 1, True, None, 1.0, 1.0), (0, 1, False, "g1", 0.0, 0.0)]
    tagged = spark.createDataFrame(rows, "outer_repeat int, fold int, held_out boolean, grp string, y_true double, y_pred double")
    out = {r["fold"]: r for r in nested.fold_rows(tagged, "classification", "macro_f1", 2, "grp").collect()}
    assert (out[0]["outer_class_counts"], out[0]["inner_class_counts"]) == ("[2,2]", "[4,4]") and out[0]["n_outer_validation"] == 4
    assert {"train_macro_f1", "outer_macro_f1", "outer_balanced_accuracy", "outer_accuracy"} <= set(out[0].asDict()) and out[1]["n_validation_groups"] == 1
    reg = {r["fold"]: r for r in nested.fold_rows(tagged, "regression", "r2").collect()}
    assert reg[1]["outer_target_std"] == 0 and reg[1]["outer_r2"] is None and reg[1]["outer_target_mean"] == 1
    assert nested.fold_rows(tagged.where("false"), "regression", "r2", group="grp").collect() == []


def test_permuted_columns_keep_their_values(data):
    pdf, df = data
    out = cv.permuted(df.select("row_id", "label", "a", "b"), ["a", "b"], 2, 9, block_rows=50).toPandas()
    assert len(out) == 4 * len(pdf)
    for (feature, _), part in out.groupby(["feature", "repeat"]):
        part = part.set_index("row_id").loc[pdf["row_id"]]
        other = "b" if feature == "a" else "a"
        assert np.array_equal(part[other].to_numpy(), pdf[other].to_numpy())
        assert sorted(part[feature]) == sorted(pdf[feature]) and not np.array_equal(part[feature].to_numpy(), pdf[feature].to_numpy())


def test_copies_need_one_shuffle_and_repeat(data):
    _, df = data
    rows = df.select("row_id", "label", "a", "b")
    out = cv.permuted(rows, ["a", "b"], 3, 9, block_rows=50)
    assert str(out._jdf.queryExecution().executedPlan().toString()).count("Exchange ") == 1
    again = cv.permuted(rows.repartition(3), ["a", "b"], 3, 9, block_rows=50)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert "row_id" not in cv.permuted(rows, ["a"], 1, 9, keep_key=False).columns
    assert cv.permuted(rows.where("false"), ["a"], 2, 9).collect() == []


def test_importance_equals_numpy(data):
    """Scores of the same copies by hand: mean and sd of the R2 lost, over 30 repeats."""
    pdf, df = data
    c = cv.Candidate("regression", "MLR", ["a", "b"])
    rows = {r["feature"]: r for r in cv.permutation_importance(cv.fit(df, c), df, ["a", "b"], c).collect()}
    x = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b"]])
    beta = np.linalg.lstsq(x, pdf["label"], rcond=None)[0]
    r2 = lambda t: 1 - ((np.column_stack([np.ones(len(t)), t["a"], t["b"]]) @ beta - t["label"]) ** 2).sum() / ((t["label"] - t["label"].mean()) ** 2).sum()
    copies = cv.permuted(df.select("row_id", "label", "a", "b"), ["a", "b"], 30, 42).toPandas()
    for name, part in copies.groupby("feature"):
        lost = np.array([r2(pdf) - r2(t) for _, t in part.groupby("repeat")])
        assert len(lost) == 30 == rows[name]["n_repeats"]
        assert (rows[name]["mean_importance"], rows[name]["std_importance"]) == pytest.approx((lost.mean(), lost.std()), rel=1e-5)


def test_importance_orders_features(data):
    _, df = data
    c = cv.Candidate("regression", "MLR", ["a", "b"])
    rows = cv.permutation_importance(cv.fit(df, c), df, ["a", "b"], c, n_repeats=2).collect()
    assert [r["feature"] for r in rows] == ["a", "b"] and math.isclose(sum(r["relative_contribution_percent"] for r in rows), 100)


def test_neighbours_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(60)], "id int, v array<double>, label int")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1)[:, :4]
    want = {i: float(np.mean(near[i] % 3)) for i in range(60)}
    for rows in (4000, 9):
        got = {r["id"]: r["prediction"] for r in ft.knn_predict(df, df, "v", "id", "label", 4, task="regression", exclude_self=True, tile_rows=rows).collect()}
        assert got == pytest.approx(want)


def test_evaluator_works_with_spark_tuning(data):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    _, df = data
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("label", (F.col("label") > 0).cast("double")))
    tree = DecisionTreeClassifier(seed=1)
    tuned = CrossValidator(estimator=tree, estimatorParamMaps=ParamGridBuilder().addGrid(tree.maxDepth, [1, 4]).build(), evaluator=cv.MacroF1(2), numFolds=3, foldCol="fold").fit(rows)
    assert tuned.bestModel.getMaxDepth() == 4 and max(tuned.avgMetrics) > 0.8


def test_spark_tuning_agrees_with_the_search(data):
    _, df = data
    grid = cv.param_grid({"max_depth": [1, 3], "min_samples_leaf": [1, 5]})
    c = cv.Candidate("regression", "DT", ["a", "b"])
    best, table = cv.grid_search_cv(df, c, grid, "fold", 3)
    same, other, model = cv.cross_validate(df, c, grid, "fold", 3)
    key = lambda rows: {tuple(sorted(r["params"].items())): r["mean_test"] for r in rows.collect()}
    assert same == best and key(other) == pytest.approx(key(table)) and other.where("best").count() == 1
    assert model.stages[-1].getMaxDepth() == best["max_depth"]
    rows = df.withColumn("label", (F.col("label") > 0).cast("int"))
    c = cv.Candidate("classification", "DT", ["a", "b"], n_classes=2)
    for metric in ("macro_f1", "balanced_accuracy"):
        best, table = cv.grid_search_cv(rows, c, grid, "fold", 3, metric)
        same, other, _ = cv.cross_validate(rows, c, grid, "fold", 3, metric)
        assert key(other) == pytest.approx(key(table)) and same == best
    with pytest.raises(ValueError, match="class weights"):
        cv.cross_validate(rows, c, [{"class_weight": "balanced"}], "fold", 3)


def test_study_flow(data):
    _, df = data
    spec = StudySpec(targets={"label": {"fs1": ["a"], "fs2": ["a", "b"]}}, group_column="grp", cv_splits=2)
    prepared = {name: flows.prepare(df.drop("fold"), spec, "label", name) for name in ("fs1", "fs2")}
    lb, held, fitted = flows.train_and_select(prepared, spec, "label", ["MLR"], "label")
    best = lb.orderBy("selection_rank").first()
    assert best["feature_set"] == "fs2" and set(fitted) == {"MLR_fs1_label", "MLR_fs2_label"}
    assert held.where("NOT test_used_for_selection").count() == held.count() == 4


def test_classification_study_flow(data):
    _, df = data
    rows = df.drop("fold").withColumn("label", (F.col("label") > 0).cast("int"))
    spec = StudySpec(targets={"label": {"fs1": ["a"], "fs2": ["a", "b"]}}, cv_splits=3)
    prepared = {name: flows.prepare(rows, spec, "label", name, stratify=None) for name in ("fs1", "fs2")}
    lb, held, fitted = flows.train_and_select(prepared, spec, "label", ["LOGREG"], "label", task="classification")
    best = lb.orderBy("selection_rank").first()
    assert best["feature_set"] == "fs2" and best["cv_macro_f1"] > 0.8 and best["cv_accuracy"] > 0.8 and len(fitted) == 2
    assert {"cv_balanced_accuracy", "rank_cv_accuracy", "train_cv_gap"} <= set(lb.columns)
    assert held.count() == 4 and held.where("macro_f1 is null").count() == 0
    train = prepared["fs2"].where("split = 'train'")
    share = flows.folds(train, spec, "row_id", 3, 1, label="label").groupBy("fold").agg(F.avg("label").alias("m")).toPandas().m
    assert share.max() - share.min() < 0.05


def test_spark_tuning_prepares_each_fold_once(data, monkeypatch):
    from studyframe.operators import prep

    fits, real = [], prep.Scaler._fit
    monkeypatch.setattr(prep.Scaler, "_fit", lambda self, df: fits.append(1) or real(self, df))
    _, df = data
    c = cv.Candidate("regression", "DT", ["a", "b"])
    _, table, model = cv.cross_validate(df, c, cv.param_grid({"max_depth": [1, 2, 3]}), "fold", 3)
    assert len(fits) == 4 and table.count() == 3 and "prediction" in model.transform(df.withColumn("label", F.col("label").cast("double"))).columns


def test_fits_of_many_rows_run_one_after_another(data, monkeypatch):
    _, df = data
    c, grid = cv.Candidate("regression", "DT", ["a", "b"]), [{"max_depth": 1}, {"max_depth": 2}, {"max_depth": 3}]
    together = cv.grid_search_cv(df, c, grid, "fold", 3)[1].collect()
    used, real = [], cv.ThreadPool
    monkeypatch.setattr(cv, "ROWS_SIDE_BY_SIDE", 1)
    monkeypatch.setattr(cv, "ThreadPool", lambda n: used.append(n) or real(n))
    alone = cv.grid_search_cv(df, c, grid, "fold", 3)[1].collect()
    assert used == [1, 1, 1] and alone == together


def test_nested_cv_writes_no_predictions(spark, data):
    """All rows times all folds were written, with their keys; now the held-out ones are worked out when they are read."""
    import os

    from studyframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    names = lambda: {f for _, _, files in os.walk(folder) for f in files}
    before = names()
    df = spark.createDataFrame(data[0]).withColumns({"fold": (draw32(F.lit(1), "grp") % 3).cast("int"), "again": (draw32(F.lit(77), "grp") % 3).cast("int")})
    c = cv.Candidate("regression", "MLR", ["a", "b"])
    for rows in (df, df.persist()):
        folds, pred = nested.nested_cv(rows, c, [{}], ["fold", "again"], 3, None, 2, group="grp")
        sizes = {(r["outer_repeat"], r["outer_fold"]): r["n_outer_validation"] for r in folds.collect()}
        got = pred.groupBy("outer_repeat", "fold").agg(F.count("row_id").alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae")).collect()
        assert sizes == {(r["outer_repeat"], r["fold"]): r["n"] for r in got} and sum(sizes.values()) == 2 * df.count()
        maes = {(r["outer_repeat"], r["outer_fold"]): r["outer_mae"] for r in folds.collect()}
        assert all(abs(maes[r["outer_repeat"], r["fold"]] - r["mae"]) < 1e-9 for r in got)
        assert pred.columns == ["outer_repeat", "fold", "row_id", "grp", "y_true", "y_pred"]
    df.unpersist()
    assert names() == before


def test_importances_of_a_linear_model_make_no_copies(spark, data, monkeypatch):
    """The numbers of the scored copies, from sums: with infinite labels, a feature that the model has not, a constant label."""
    pdf = data[0].copy()
    pdf["c"] = np.arange(len(pdf)) % 7 * 1.0
    pdf.loc[3, "label"] = np.inf
    df, same = spark.createDataFrame(pdf), spark.createDataFrame(pdf.assign(label=2.0))
    c = cv.Candidate("regression", "MLR", ["a", "b"])
    model = cv.fit(df.where("label < 1000"), c)
    monkeypatch.setattr(cv, "BLOCK_ROWS", 50)
    table = lambda rows, metric: {r["feature"]: (r["mean_importance"], r["std_importance"]) for r in cv.permutation_importance(model, rows, ["a", "b", "c"], c, metric, n_repeats=4).collect()}
    cases = [(rows, metric) for rows in (df, same) for metric in ("r2", "mae", "rmse")]
    with monkeypatch.context() as m:
        m.setattr(cv, "_additive", lambda *a: None)
        want = [table(*case) for case in cases]
    monkeypatch.setattr(cv, "permuted", None)
    for got, one in zip([table(*case) for case in cases], want):
        assert got.keys() == one.keys() and all(got[f] == pytest.approx(one[f], rel=1e-9, abs=1e-9) for f in one)
    assert cv._additive(cv.fit(df.where("label < 1000"), cv.Candidate("regression", "MLR", ["a", "b"], preprocessing={"polynomial_features": True})), c, "r2") is None

"""Queries: preprocessing, fits, search, cross-validation, importances, neighbours."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from studyframe.functions.columns import draw32, kept, round_doubles as rd, steady
from studyframe.operators import cv, fit as ft, neighbors as nb, nested, prep, split as sp
from studyframe.operators.labels import class_from_thresholds, encode_labels
from studyframe.operators.metrics import regression_metrics
from studyframe.plans.fixtures import F1, FEATURES, samples
from studyframe.plans.q_stats import _scores
from studyframe.plans.registry import query, steady_sql
from studyframe.sources.tables import read_table

SMALL = ["quantity", "retail"]


def _rows(spark, sf, identity=True):
    """Samples with label, whole-group folds and a target that depends on the features."""
    rows = samples(spark, sf, identity)
    signal = F.col("y") * 0.2 + F.col("quantity") * 1.5 + F.col("retail") * 0.01 - F.col("size") * 0.3
    rows = rows.select(*(["row_id"] if identity else []), "grp", *FEATURES, "discount_n", signal.alias("label"))
    return rows.withColumn("fold", (draw32(F.lit(5), "grp") % 3).cast("int"))


def _class_rows(spark, sf):
    rows = class_from_thresholds(_rows(spark, sf, False), "label", 40.0, 65.0, "cls")
    return rows.drop("label").withColumnRenamed("cls", "label")


# ------------------------------------------------------------------ preprocessing


def _prepared(spark, sf, stage, cols):
    rows = samples(spark, sf).select(*FEATURES, "discount_n")
    return rows, (stage.fit(rows) if hasattr(stage, "fit") else stage).transform(rows)


def _profile(df, cols):
    from studyframe.operators.schema import column_facts

    facts = {c: {"n": F.count(f"`{c}`"), "mean": F.avg(f"`{c}`"), "sd": F.stddev_pop(f"`{c}`"), "min": F.min(f"`{c}`"), "max": F.max(f"`{c}`")} for c in cols}
    return steady(column_facts(df, facts), 5)


def _scaled_sql(expr, cols=FEATURES):
    parts = []
    for c in cols:
        e = expr(c)
        parts.append(f"SELECT '{c}' AS \"column\", count(v) AS n, round(avg(v), 5) + 0.0::DOUBLE AS mean, round(stddev_pop(v), 5) AS sd, round(min(v), 5) + 0.0::DOUBLE AS min, round(max(v), 5) + 0.0::DOUBLE AS max FROM (SELECT {e} AS v FROM f1, st)")
    stats = ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr, max(abs({c})) AS {c}_top" for c in {*cols}
    )
    return steady_sql(f"WITH {F1}, st AS (SELECT {stats} FROM f1) " + " UNION ALL ".join(parts))


_SCALE = {
    "standard": lambda c: f"({c} - {c}_m) / {c}_s",
    "minmax": lambda c: f"({c} - {c}_lo) / ({c}_hi - {c}_lo)",
    "robust": lambda c: f"({c} - {c}_q2) / {c}_iqr",
    "maxabs": lambda c: f"{c} / {c}_top",
}


def _scaler_query(kind):
    def run(spark, sf):
        _, out = _prepared(spark, sf, prep.scaler(kind, FEATURES), FEATURES)
        return _profile(out, FEATURES)

    query(f"scale_{kind}", _scaled_sql(_SCALE[kind]))(run)


for _kind in _SCALE:
    _scaler_query(_kind)


@query("impute_median", _scaled_sql(lambda c: f"coalesce({c}, {c}_q2)", ["discount_n", "tax"]))
def impute_median(spark, sf):
    _, out = _prepared(spark, sf, prep.impute_median(["discount_n", "tax"]), [])
    return _profile(out, ["discount_n", "tax"])


_NORM = {"l1": "(abs(quantity) + abs(size) + abs(discount))", "l2": "sqrt(quantity*quantity + size*size + discount*discount)", "max": "greatest(abs(quantity), abs(size), abs(discount))"}


def _norm_query(kind):
    cols = ["quantity", "size", "discount"]

    def run(spark, sf):
        _, out = _prepared(spark, sf, prep.normalizer(cols, kind), cols)
        return _profile(out, cols)

    query(f"normalize_{kind}", _scaled_sql(lambda c: f"{c} / {_NORM[kind]}", cols))(run)


for _kind in _NORM:
    _norm_query(_kind)


@query("polynomial", steady_sql(f"""WITH {F1} SELECT 'quantity*quantity' AS "column", count(*) AS n, round(avg(quantity*quantity), 5) AS mean, round(stddev_pop(quantity*quantity), 5) AS sd, round(min(quantity*quantity), 5) AS min, round(max(quantity*quantity), 5) AS max FROM f1
UNION ALL SELECT 'quantity*size', count(*), round(avg(quantity*size), 5), round(stddev_pop(quantity*size), 5), round(min(quantity*size), 5), round(max(quantity*size), 5) FROM f1
UNION ALL SELECT 'size*size', count(*), round(avg(size*size), 5), round(stddev_pop(size*size), 5), round(min(size*size), 5), round(max(size*size), 5) FROM f1"""))
def polynomial(spark, sf):
    _, out = _prepared(spark, sf, prep.polynomial(["quantity", "size"], 2), [])
    return _profile(out, list(prep.polynomial_terms(["quantity", "size"], 2)))


@query("spline")
def spline(spark, sf):
    stage = prep.spline(["quantity", "retail"], 5, 3)
    _, out = _prepared(spark, sf, stage, [])
    return _profile(out, stage.outputs())


@query("power_yeo_johnson")
def power_yeo_johnson(spark, sf):
    _, out = _prepared(spark, sf, prep.power("yeo-johnson", FEATURES), FEATURES)
    return _profile(out, FEATURES)


@query("power_box_cox")
def power_box_cox(spark, sf):
    cols = ["quantity", "size", "retail"]
    _, out = _prepared(spark, sf, prep.power("box-cox", cols), cols)
    return _profile(out, cols)


_PLACES = f"""WITH {F1}, v AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS x FROM f1" for c in SMALL) + """),
s AS (SELECT col, list(x ORDER BY x) AS xs, count(*) AS n FROM v GROUP BY col),
p AS (SELECT col, i, xs, i / 999.0::DOUBLE * (n - 1) AS pos FROM s, range(1000) t(i)),
k AS (SELECT col, i, xs[floor(pos)::BIGINT + 1] AS a, xs[ceil(pos)::BIGINT + 1] AS b, pos - floor(pos) AS part FROM p),
g AS (SELECT col, CASE WHEN a = b THEN a ELSE a + (b - a) * part END AS knot, min(i) / 999.0::DOUBLE AS lo, max(i) / 999.0::DOUBLE AS hi FROM k GROUP BY ALL),
w AS (SELECT *, lead(knot) OVER o AS next_knot, lead(lo) OVER o AS next_lo FROM g WINDOW o AS (PARTITION BY col ORDER BY knot)),
u AS (SELECT v.col, CASE WHEN w.lo = 0 AND v.x = w.knot THEN 0 WHEN w.next_knot IS NULL THEN 1 WHEN v.x = w.knot THEN (w.lo + w.hi) / 2 ELSE w.hi + (w.next_lo - w.hi) * (v.x - w.knot) / (w.next_knot - w.knot) END AS place
  FROM v ASOF JOIN w ON v.col = w.col AND v.x >= w.knot)
"""


@query("power_quantile_uniform", steady_sql(_PLACES + """SELECT col AS "column", count(*) AS n, round(avg(place), 5) AS mean, round(stddev_pop(place), 5) AS sd, round(min(place), 5) AS min, round(max(place), 5) AS max FROM u GROUP BY col"""))
def power_quantile_uniform(spark, sf):
    _, out = _prepared(spark, sf, prep.power("quantile_uniform", SMALL), SMALL)
    return _profile(out, SMALL)


@query("power_quantile_normal", steady_sql(_PLACES + f""", {_scores('u', 'greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, place))', 'sc')}
SELECT col AS "column", count(*) AS n, round(avg(z), 5) AS mean, round(stddev_pop(z), 5) AS sd, round(min(z), 5) AS min, round(max(z), 5) AS max FROM sc GROUP BY col"""))
def power_quantile_normal(spark, sf):
    _, out = _prepared(spark, sf, prep.power("quantile_normal", SMALL), SMALL)
    return _profile(out, SMALL)


@query("encode_onehot", steady_sql("""SELECT 'p_type=' || p_type AS "column", sum(count(*)) OVER ()::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 5) AS mean,
 round(sqrt(count(*)::DOUBLE / sum(count(*)) OVER () * (1 - count(*)::DOUBLE / sum(count(*)) OVER ())), 5) AS sd, 0.0::DOUBLE AS min, 1.0::DOUBLE AS max FROM part GROUP BY p_type ORDER BY p_type OFFSET 1"""))
def encode_onehot(spark, sf):
    part = read_table(spark, sf, "part").select("p_type")
    stage = prep.encoder("onehot", ["p_type"], prep.categories_of(part, ["p_type"]), drop_first=True)
    return _profile(stage.fit(part).transform(part), stage.outputs())


@query("encode_ordinal", "SELECT p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS code, count(*) AS n FROM part GROUP BY p_type")
def encode_ordinal(spark, sf):
    part = read_table(spark, sf, "part").select("p_type")
    stage = prep.encoder("ordinal", ["p_type"], prep.categories_of(part, ["p_type"]))
    return stage.fit(part).transform(part).groupBy("p_type", F.col("p_type_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("build_preprocessor")
def build_preprocessor(spark, sf):
    """Imputation, power transform, scaling and products in one pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = samples(spark, sf).select(*FEATURES, "discount_n")
    stages, names = prep.build_preprocessor({"power_transform": "yeo-johnson", "scaling": "robust", "polynomial_features": True}, ["quantity", "discount_n", "size"], rows, impute=True)
    out = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("v", vector_to_array("features"))
    return _profile(out.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)]), names)


# ------------------------------------------------------------------ fits


def _fit_scores(spark, sf, c, params):
    rows = _class_rows(spark, sf) if c.task == "classification" else _rows(spark, sf, False)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    pred = cv.fit(train, c, params).transform(cv._ready(test, c))
    metric = "r2" if c.task == "regression" else "macro_f1"
    return rd(cv.score(pred, metric, c.label, c.n_classes)).select(F.lit(c.name).alias("model"), F.col("score").alias(metric), "n")


_REG = {
    "MLR": {}, "RIDGE": {"alpha": 1.0}, "LASSO": {"alpha": 0.01}, "EN": {"alpha": 0.01, "l1_ratio": 0.5}, "DT": {"max_depth": 5, "min_samples_leaf": 2},
    "RF": {"n_estimators": 10, "max_depth": 5}, "GBR": {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3},
}
_CLS = {
    "LOGREG": {"C": 1.0, "max_iter": 20, "class_weight": "balanced"}, "SVC": {"C": 1.0, "max_iter": 5}, "DT": {"max_depth": 5, "criterion": "gini"}, "RF": {"n_estimators": 10, "max_depth": 5},
    "GBC": {"n_estimators": 3, "max_depth": 3}, "ANN": {"hidden_layer_sizes": [8], "max_iter": 20},
}


def _fit_query(task, name, params):
    def run(spark, sf):
        c = cv.Candidate(task, name, FEATURES, n_classes=3 if task == "classification" else None)
        return _fit_scores(spark, sf, c, params)

    query(f"fit_{name.lower()}" + ("_class" if task == "classification" and name in ("DT", "RF") else ""))(run)


for _n, _p in _REG.items():
    _fit_query("regression", _n, _p)
for _n, _p in _CLS.items():
    _fit_query("classification", _n, _p)


@query("fit_mlr_insample", f"""WITH {F1}, a AS (SELECT count(*) AS n, corr(y, quantity) AS ya, corr(y, retail) AS yb, corr(quantity, retail) AS ab FROM f1)
SELECT n, round((ya*ya + yb*yb - 2*ya*yb*ab)/(1 - ab*ab), 6) AS r2 FROM a""")
def fit_mlr_insample(spark, sf):
    rows = samples(spark, sf).select(*SMALL, F.col("y").alias("label"))
    pred = cv.fit(rows, cv.Candidate("regression", "MLR", SMALL)).transform(rows)
    return rd(regression_metrics(pred, [], "label", "prediction", agreement=False).select("n", "r2"))


@query("class_weights", "SELECT l_returnflag AS flag, count(*) AS n, round((SELECT count(*) FROM lineitem)::DOUBLE / (count(*) * (SELECT count(DISTINCT l_returnflag) FROM lineitem)), 6) AS weight FROM lineitem GROUP BY l_returnflag")
def class_weights(spark, sf):
    rows = ft.class_weights(read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag")), "flag")
    return rd(rows.groupBy("flag", "weight").agg(F.count(F.lit(1)).alias("n")))


KNN = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, b.label, {dist} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist}, b.vec_id) AS rn
  FROM v a JOIN v b ON a.vec_id <> b.vec_id), n AS (SELECT * FROM d WHERE rn <= 5)"""
L2 = "list_distance(a.e, b.e)"
L1 = "list_sum(list_transform(list_zip(a.e, b.e), lambda t: abs(t[1] - t[2])))"


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


@query("knn_classify", KNN.format(dist=L2) + " SELECT vec_id, label::DOUBLE AS prediction FROM (SELECT vec_id, label, count(*) AS k FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, label) = 1")
def knn_classify(spark, sf):
    rows = _vectors(spark, sf)
    return ft.knn_predict(rows, rows, "e", "vec_id", "label", 5, exclude_self=True)


@query("knn_regress", KNN.format(dist=L2) + " SELECT vec_id, round(sum(label / d) / sum(1 / d), 6) AS prediction FROM n GROUP BY vec_id")
def knn_regress(spark, sf):
    rows = _vectors(spark, sf)
    return rd(ft.knn_predict(rows, rows, "e", "vec_id", "label", 5, weights="distance", task="regression", exclude_self=True))


@query("knn_regress_l1", KNN.format(dist=L1) + " SELECT vec_id, round(avg(label), 6) AS prediction FROM n GROUP BY vec_id")
def knn_regress_l1(spark, sf):
    rows = _vectors(spark, sf)
    return rd(ft.knn_predict(rows, rows, "e", "vec_id", "label", 5, p=1, task="regression", exclude_self=True))


KNN_K = 5


@query("knn_neighbors", KNN.replace("b.label, {dist} AS d", "b.vec_id AS neighbor, {dist} AS d").format(dist=L2) + " SELECT vec_id, neighbor, rn AS place, round(d, 6) AS dist FROM n")
def knn_neighbors(spark, sf):
    """The neighbours themselves, in order."""
    rows = _vectors(spark, sf)
    found = nb.PivotSearch(rows, "e", "vec_id", "label", KNN_K, exclude_self=True).neighbors(rows)
    place = F.row_number().over(W.partitionBy("qkey").orderBy("dist", "tkey"))
    return rd(found.select(F.col("qkey").alias("vec_id"), F.col("tkey").alias("neighbor"), place.cast("long").alias("place"), "dist"))


@query("knn_visits")
def knn_visits(spark, sf):
    """What exact search compares: per query the train vectors met, next to all of them."""
    rows = _vectors(spark, sf)
    cells = nb.PivotSearch(rows, "e", "vec_id", "label", KNN_K, exclude_self=True).visits(rows)
    met = (F.col("n_home") + F.col("n_far")) * F.col("n_train")
    share = F.sum(met) / (F.sum("n_train") * rows.count())
    return rd(cells.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_train").alias("n_train"), F.sum(met).alias("n_compared"), share.alias("share")))


@query("knn_recall")
def knn_recall(spark, sf):
    """Neighbours that the approximate search finds, of all exact ones."""
    rows = _vectors(spark, sf)
    exact = nb.PivotSearch(rows, "e", "vec_id", "label", KNN_K, exclude_self=True).neighbors(rows)
    return rd(nb.recall_of(nb.nearest_approximate(rows, rows, "e", "vec_id", "label", KNN_K, exclude_self=True, bucket_rows=128), exact))


# ------------------------------------------------------------------ search and cross-validation

GRID = {"max_depth": [2, 4], "min_samples_leaf": [1, "20"], "_cv_": 3}


@query("param_grid")
def param_grid(spark, sf):
    """Every combination with the mean target of the rows it would be fitted on."""
    combos = cv.param_grid({"a": [1, 2, 3], "b": ["none", "0.5", "true"]}, cap=5)
    table = spark.createDataFrame([(i, {k: str(v) for k, v in c.items()}) for i, c in enumerate(combos)], "combination int, params map<string,string>")
    facts = _rows(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("label"), 6).alias("mean_label"))
    from studyframe.functions.columns import join_small

    return join_small(table, facts, []).select("combination", F.to_json("params").alias("params"), "n_rows", "mean_label")


@query("grid_search_cv")
def grid_search_cv(spark, sf):
    c = cv.Candidate("regression", "DT", FEATURES)
    best, table = cv.grid_search_cv(_rows(spark, sf, False), c, cv.param_grid(GRID), "fold", 3)
    return rd(table.withColumn("params", F.to_json("params")))


@query("crossvalidator_regression")
def crossvalidator_regression(spark, sf):
    """The search of grid_search_cv by Spark's own tuning class."""
    c = cv.Candidate("regression", "DT", FEATURES)
    _, table, _ = cv.cross_validate(_rows(spark, sf, False), c, cv.param_grid(GRID), "fold", 3)
    return rd(table.withColumn("params", F.to_json("params")))


@query("crossvalidator_balanced")
def crossvalidator_balanced(spark, sf):
    """Classes, judged by balanced accuracy."""
    c = cv.Candidate("classification", "DT", FEATURES, n_classes=3)
    _, table, _ = cv.cross_validate(_class_rows(spark, sf), c, cv.param_grid({"max_depth": [2, 4]}), "fold", 3, "balanced_accuracy")
    return rd(table.withColumn("params", F.to_json("params")))


@query("nested_cv")
def nested_cv(spark, sf):
    c = cv.Candidate("regression", "DT", FEATURES)
    inner = lambda rows, seed: rows.withColumn("inner_fold", (draw32(F.lit(seed), "grp") % 2).cast("int"))
    folds, _ = nested.nested_cv(_rows(spark, sf), c, cv.param_grid({"max_depth": [2, 4]}), "fold", 3, inner, 2, group="grp")
    return rd(folds)


def _nested_linear(spark, sf, held_out):
    """Two repeats of three outer folds of whole groups, a linear model of two features; held_out: its predictions will be read."""
    c = cv.Candidate("regression", "MLR", SMALL)
    rows = _rows(spark, sf).withColumn("again", (draw32(F.lit(6), "grp") % 3).cast("int"))
    if held_out:
        rows = kept(rows.select("row_id", "grp", *SMALL, "label", "fold", "again"))
    return c, *nested.nested_cv(rows, c, [{}], ["fold", "again"], 3, None, 2, group="grp")


#: Least squares in closed form: slopes from the covariances of the rows outside a fold.
_NESTED = f"""WITH {F1},
x AS (SELECT row_id, grp, quantity AS a, retail AS b, y * 0.2 + quantity * 1.5 + retail * 0.01 - size * 0.3 AS y FROM f1),
t AS (SELECT x.*, r.r AS outer_repeat, CAST('0x' || substr(md5((5 + r.r) || '|' || grp), 1, 8) AS BIGINT) % 3 AS own FROM x, (VALUES (0), (1)) r(r)),
s AS (SELECT t.*, f.f AS fold, own = f.f AS held FROM t, (VALUES (0), (1), (2)) f(f)),
m AS (SELECT outer_repeat, fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb
      FROM s WHERE NOT held GROUP BY ALL),
p AS (SELECT s.*, my + (ay * vb - yb * ab) / (va * vb - ab * ab) * (a - ma) + (yb * va - ay * ab) / (va * vb - ab * ab) * (b - mb) - y AS e FROM s JOIN m USING (outer_repeat, fold))
"""


@query("nested_cv_linear", steady_sql(_NESTED + """, k AS (SELECT outer_repeat, fold, held, count(*) AS n, count(DISTINCT grp) AS g, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
    avg(e) AS bias, avg(y) AS mean, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM p GROUP BY ALL)
SELECT o.outer_repeat, o.fold AS outer_fold, o.n AS n_outer_validation, i.n AS n_inner_train, round(o.r2, 6) AS outer_r2, round(i.r2, 6) AS train_r2, round(i.r2 - o.r2, 6) AS train_outer_gap,
    round(o.mae, 6) AS outer_mae, round(o.rmse, 6) AS outer_rmse, round(o.bias, 6) AS outer_bias, round(o.mean, 6) AS outer_target_mean, round(o.sd, 6) AS outer_target_std,
    round(o.lo, 6) AS outer_target_min, round(o.hi, 6) AS outer_target_max, round(i.mean, 6) AS inner_target_mean, round(i.sd, 6) AS inner_target_std,
    i.g AS n_train_groups, o.g AS n_validation_groups, 0::BIGINT AS group_overlap_count, '{}' AS best_params
FROM k o JOIN k i ON o.outer_repeat = i.outer_repeat AND o.fold = i.fold AND o.held AND NOT i.held"""))
def nested_cv_linear(spark, sf):
    return steady(_nested_linear(spark, sf, False)[1])


@query("nested_group_rows", steady_sql(_NESTED + """SELECT outer_repeat, fold, grp, count(*) AS n_samples, round(avg(y), 6) AS target_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(y) ELSE 0 END, 6) AS target_std,
    round(min(y), 6) AS target_min, round(max(y), 6) AS target_max, round(avg(y + e), 6) AS prediction_mean, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias,
    round(CASE WHEN count(*) >= 2 THEN 1 - sum(e * e) / (var_pop(y) * count(*)) END, 6) AS r2 FROM p WHERE held GROUP BY ALL"""))
def nested_group_rows(spark, sf):
    c, _, predictions = _nested_linear(spark, sf, True)
    return steady(nested.group_rows(predictions, c, "grp"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    c = cv.Candidate("regression", "MLR", FEATURES)
    rows = kept(_rows(spark, sf))  # read by the fit, the base score and the copies
    model = cv.fit(rows.where("fold <> 0"), c)
    return rd(cv.permutation_importance(model, rows.where("fold = 0"), FEATURES, c, n_repeats=30))


@query("learning_curve")
def learning_curve(spark, sf):
    c = cv.Candidate("regression", "MLR", SMALL)
    rows = _rows(spark, sf)
    fractions = [0.3, 1.0]
    subsets = sp.learning_subsets(rows, "fold", "grp", fractions, folds=3)
    return rd(cv.learning_curve(rows, c, {}, subsets, "fold", "grp", 3, fractions))


@query("select_then_test")
def select_then_test(spark, sf):
    """CV choice between two models of two feature sets, then the holdout scores of the chosen."""
    from studyframe.plans.flows import train_and_select
    from studyframe.spec import StudySpec

    spec = StudySpec(targets={"label": {"fs1": ["quantity"], "fs2": ["quantity", "retail", "size"]}}, group_column="grp", cv_splits=2)
    # The split, the folds, every fit and the holdout read the rows: they are built once.
    rows = sp.split_grouped(kept(_rows(spark, sf).drop("fold")), "grp", 0.2)
    _, held, _ = train_and_select({"fs1": rows, "fs2": rows}, spec, "label", ["MLR", "RIDGE"], "label")
    return rd(held)


@query("score_batch")
def score_batch(spark, sf):
    c = cv.Candidate("regression", "MLR", SMALL)
    rows = _rows(spark, sf)
    scored = cv.score_batch(cv.fit(rows.where("fold <> 0"), c), rows, SMALL, ["grp"])
    return rd(scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction")))

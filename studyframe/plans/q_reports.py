"""Queries: sources and sinks, report tables, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions.columns import round_doubles as rd
from studyframe.operators import cv, rank as r, reports as rp, selection as sel, sensitivity as s
from studyframe.operators.diagnose import gaps
from studyframe.operators.split import split_grouped
from studyframe.plans import q_quality, q_rank
from studyframe.plans.fixtures import CLB, F1, F2, FEATURES, KEYS, LB, class_leaderboard, fold_scores, leaderboard, predictions, samples
from studyframe.plans.registry import query
from studyframe.session import scratch_path
from studyframe.sources import delimited, reports as src, stores
from studyframe.sources.tables import read_table
from studyframe.streaming.quality import stream_quality as quality_of
from studyframe.streaming.runner import run_available
from studyframe.streaming.score import stream_score as scores_of

# ------------------------------------------------------------------ sources and sinks


@query("read_table", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY ALL")
def read_tables(spark, sf):
    return read_table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("read_delimited", "SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 4) AS balance FROM supplier GROUP BY ALL")
def read_delimited(spark, sf):
    """Suppliers written as tab-separated text and read back."""
    path = scratch_path(spark, "suppliers") + ".tsv"
    read_table(spark, sf, "supplier").write.option("header", True).option("sep", "\t").csv(path)
    back = delimited.read_delimited(spark, path)
    return back.groupBy(F.col("s_nationkey").cast("int").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("s_acctbal").cast("double")), 4).alias("balance"))


def _written_folds(spark, sf):
    """Fold scores of all models and targets as report files of a study folder, one per feature set."""
    root = scratch_path(spark, "study")
    scores = fold_scores(predictions(spark, sf), agreement=False)
    picked = scores.groupBy("feature_set", "fold").agg(F.avg("r2").alias("outer_r2"), F.avg("rmse").alias("outer_rmse")).persist()
    for fs in ("A", "N", "R"):
        part = picked.where(F.col("feature_set") == fs).select("fold", "outer_r2", *(["outer_rmse"] if fs == "A" else []))
        # One small report file per model, named as the study names it.
        target = f"{root}/regression/nested_cv/priceF/fs_{fs}"
        part.coalesce(1).write.option("header", True).csv(f"{target}/MLR_nested_cv_folds.csv")
    return root


_FOLD_REPORTS = f"""WITH {F2}, sc AS (SELECT target, feature_set, model, CASE WHEN part = 'cv' THEN fold ELSE -1 END AS fold, count(*) AS n,
  1 - sum((y_true-y_pred)^2)/(var_pop(y_true)*count(*)) AS r2, sqrt(avg((y_true-y_pred)^2)) AS rmse FROM f2 GROUP BY target, feature_set, model, part, 4),
me AS (SELECT feature_set, fold, avg(CASE WHEN n >= 2 THEN r2 END) AS r2, avg(CASE WHEN n >= 2 THEN rmse END) AS rmse FROM sc GROUP BY ALL)"""


@query("collect_reports", _FOLD_REPORTS + """ SELECT 'MLR' AS model, fold::INTEGER AS fold, round(r2, 6) AS outer_r2, CASE WHEN feature_set = 'A' THEN round(rmse, 6) END AS outer_rmse FROM me""")
def collect_reports(spark, sf):
    """Report files of a study, whatever their columns, as one table (files are part files of each report)."""
    root = _written_folds(spark, sf)
    rows = src.collect_reports(spark, f"{root}/regression/nested_cv", "*.csv")
    return rd(rows.select(F.regexp_replace("Feature_Set", "_nested_cv_folds.csv$", "").alias("model"), F.col("fold").cast("int").alias("fold"),
                          F.col("outer_r2").cast("double").alias("outer_r2"), F.col("outer_rmse").cast("double").alias("outer_rmse")))


@query("collect_importances", f"""WITH {q_quality.IMP}, me AS (SELECT feature_set, feature, avg(mean_importance) AS m FROM im GROUP BY ALL)
SELECT 'regression' AS task, 'GL' AS family, 'AC' AS target, 'FS' || CASE feature_set WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS feature_set, feature, round(m, 6) AS mean_importance,
  round(CASE WHEN max(abs(m)) OVER w <= 1 THEN 100 * m ELSE m END, 6) AS importance_pct,
  round(CASE WHEN sum(greatest(m, 0)) OVER w > 0 THEN 100 * greatest(m, 0) / sum(greatest(m, 0)) OVER w ELSE 100 * abs(m) / sum(abs(m)) OVER w END, 6) AS relative_contribution_pct,
  dense_rank() OVER (PARTITION BY feature_set ORDER BY m DESC) AS importance_rank FROM me WINDOW w AS (PARTITION BY feature_set)""")
def collect_importances(spark, sf):
    root = scratch_path(spark, "study")
    imp = q_quality.importances(spark, sf).groupBy("feature_set", "feature").agg(F.avg("mean_importance").alias("Mean Importance")).persist()
    for i, fs in enumerate(("A", "N", "R"), 1):
        imp.where(F.col("feature_set") == fs).select("feature", "Mean Importance").coalesce(1).write.option("header", True).csv(f"{root}/AC/fs{i}/mlr_permutation_sensitivity.csv")
    out = src.collect_importances(spark, root, "regression", "GL", "*.csv")
    return rd(out.select("task", "family", "target", "feature_set", "feature", "mean_importance", "importance_pct", "relative_contribution_pct", F.col("importance_rank_within_model").alias("importance_rank")))


@query("analysis_inventory", """SELECT 'Regression nested CV' AS analysis, 'regression/nested_cv' AS location, count(DISTINCT l_returnflag) AS files_found, 'Available' AS status FROM lineitem
UNION ALL SELECT 'Regression permutation', 'regression/permutation_sensitivity', 0, 'Not performed / not available'""")
def analysis_inventory(spark, sf):
    return src.analysis_inventory(spark, _written_folds(spark, sf), [("Regression nested CV", "regression/nested_cv", "*.csv"), ("Regression permutation", "regression/permutation_sensitivity", "*.csv")])


@query("write_split", f"""WITH {F1}, gs AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws('|', 42, 'holdout', grp))) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM f1)),
sg AS (SELECT f1.*, rn <= ceil(0.2::DOUBLE * n) AS test FROM f1 JOIN gs USING (grp))
SELECT 'y' AS target, 'fs1' AS feature_set, 'quantity|retail' AS features, count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test, count(*) AS n_read FROM sg""")
def write_split(spark, sf):
    """A split written twice (the second run replaces the first), its manifest and the rows read back."""
    root = scratch_path(spark, "split")
    rows = split_grouped(samples(spark, sf, identity=True), "grp", 0.2)
    for _ in range(2):
        stores.write_split(rows, root, "y", "fs1", ["quantity", "retail"], "y", group="grp")
    n = stores.read_split(spark, root, "y", "fs1").count()
    return stores.read_manifest(spark, root).select("target", "feature_set", "features", "n_train", "n_test", F.lit(n).cast("bigint").alias("n_read"))


@query("save_model")
def save_model(spark, sf):
    """A fitted pipeline stored, loaded and applied: both give the same predictions."""
    c = cv.Candidate("regression", "MLR", ["quantity", "retail"], label="y", preprocessing={"scaling": "robust", "power_transform": "yeo-johnson"})
    rows = samples(spark, sf)
    model = cv.fit(rows, c)
    root = scratch_path(spark, "model")
    stores.save_model(model, {"features": list(c.features), "target": "y", "policy": "cv_only"}, root, spark)
    loaded, meta = stores.load_model(root, spark)
    old = cv.score_batch(model, rows, meta["features"]).agg(F.round(F.avg("prediction"), 6).alias("mean_fitted"))
    new = cv.score_batch(loaded, rows, meta["features"]).agg(F.round(F.avg("prediction"), 6).alias("mean_loaded"), F.count(F.lit(1)).alias("n"))
    from studyframe.functions.columns import join_small

    return join_small(new, old, [])


@query("write_report", f"WITH {LB} SELECT target, feature_set, count(*) AS models, round(max(cv_r2_mean), 6) AS best FROM lb GROUP BY ALL")
def write_report(spark, sf):
    root = scratch_path(spark, "report")
    lb = leaderboard(spark, sf)
    stores.write_report(lb, f"{root}/csv", "csv")
    stores.write_report(delimited.read_delimited(spark, f"{root}/csv"), f"{root}/json", "json")
    back = spark.read.schema("target string, feature_set string, cv_r2_mean string").json(f"{root}/json")
    return rd(back.groupBy("target", "feature_set").agg(F.count(F.lit(1)).alias("models"), F.max(F.col("cv_r2_mean").cast("double")).alias("best")))


@query("fingerprint")
def fingerprint(spark, sf):
    out = None
    for name in ("lineitem", "part", "supplier"):
        part = stores.fingerprint(read_table(spark, sf, name)).select(F.lit(name).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("fingerprint_files")
def fingerprint_files(spark, sf):
    return stores.file_fingerprint(spark, f"{sf}/supplier.parquet").select("length", "sha256")


# ------------------------------------------------------------------ report tables


@query("model_summary", f"""WITH {LB}, {CLB}, u AS (SELECT 'regression' AS task, target, feature_set, model, 'R2' AS selection_metric, cv_r2_mean AS cv_score, cv_r2_std AS cv_sd, r2_test AS test_score, r2_train - cv_r2_mean AS generalization_gap FROM lb
UNION ALL SELECT 'classification', target, feature_set, model, 'Macro-F1', cv_macro_f1, cv_macro_f1_std, test_macro_f1, train_macro_f1 - cv_macro_f1 FROM clb)
SELECT task, target, feature_set, model, selection_metric, cv_score, cv_sd, test_score, round(generalization_gap, 6) + 0.0::DOUBLE AS generalization_gap FROM u
QUALIFY row_number() OVER (PARTITION BY task, target, feature_set ORDER BY coalesce(cv_score, test_score) DESC NULLS LAST, model) = 1""")
def model_summary(spark, sf):
    return rd(rp.model_summary(gaps(leaderboard(spark, sf)), gaps(class_leaderboard(spark, sf), "classification")))


@query("research_summary")
def research_summary(spark, sf):
    """Model, nested-CV, learning, importance and provenance sections as one long table."""
    from studyframe.operators import aggregates as a

    sections = {
        "models": rp.model_summary(gaps(leaderboard(spark, sf)), gaps(class_leaderboard(spark, sf), "classification")),
        "nested": a.nested_summary(fold_scores(predictions(spark, sf).where("part = 'cv'"), agreement=False), "r2", "rmse", KEYS),
        "learning": a.learning_by_feature_set(a.learning_summary(q_quality.curves(spark, sf))),
        "importance": a.importance_summary(q_quality.importances(spark, sf)),
        "provenance": stores.fingerprint(read_table(spark, sf, "lineitem")),
    }
    return rd(rp.research_summary(sections))


FINAL = f"{q_rank.REG_MC}, {q_rank.summary_sql('rx', 'mc_', True, 'mc')}, {q_rank.ROBUST}, {q_rank.RECOM}"
_SHOWN = ["equal_rank", "performance_focused_rank", "stability_focused_rank"]


@query("final_ranking", f"""{FINAL}, {q_rank.scenario_sql(s.THREE_SCENARIOS, s.REG_CRITERIA)},
sw AS (SELECT target, feature_set, model, {', '.join(f"max(CASE WHEN scenario = '{n[:-5]}' THEN rank END) AS {n}" for n in _SHOWN)} FROM sn GROUP BY ALL),
t1 AS (SELECT *, {q_rank._score([(q_rank._avg_rank(c, up), w) for c, up, w in r.TEST['reg']])} AS ts, {q_rank._score([(q_rank._avg_rank(c, up), w) for c, up, w in r.GENERALIZATION['reg']])} AS gs FROM rc)
SELECT target, feature_set, model, recommended_rank, selection_rank, {q_rank._min_rank('ts')} AS test_performance_rank, {q_rank._min_rank('gs')} AS generalization_rank, robustness_rank, {', '.join(_SHOWN)}, mc_verdict
FROM t1 JOIN sw USING (target, feature_set, model)""")
def final_ranking(spark, sf):
    out = rp.final_ranking(leaderboard(spark, sf))
    return out.select(*KEYS, "recommended_rank", "selection_rank", "test_performance_rank", "generalization_rank", "robustness_rank", *_SHOWN, "mc_verdict")


_FIVE = [f"{n}_rank" for n in s.FIVE_SCENARIOS]


@query("final_ranking_class", f"""WITH {CLB}, {q_rank.CGAP}, {q_rank.selection_sql('cls_val')}, {q_rank.scenario_sql(s.FIVE_SCENARIOS, s.CLS_VAL_CRITERIA)},
sw AS (SELECT target, feature_set, model, {', '.join(f"max(CASE WHEN scenario = '{n[:-5]}' THEN rank END) AS {n}" for n in _FIVE)} FROM sn GROUP BY ALL),
t1 AS (SELECT *, round(0.50::DOUBLE * {q_rank._avg_rank('test_macro_f1', False)} + 0.30::DOUBLE * {q_rank._avg_rank('test_balanced_accuracy', False)} + 0.20::DOUBLE * {q_rank._avg_rank('test_mcc', False)}, 9) AS ts,
 round(0.45::DOUBLE * {q_rank._avg_rank('abs_train_cv_gap')} + 0.35::DOUBLE * {q_rank._avg_rank('cv_macro_f1_std')} + 0.20::DOUBLE * {q_rank._avg_rank('abs_cv_val_gap')}, 9) AS gs FROM sel)
SELECT target, feature_set, model, selection_rank, {q_rank._min_rank('ts')} AS test_performance_rank, {q_rank._min_rank('gs')} AS generalization_rank, {', '.join(_FIVE)}
FROM t1 JOIN sw USING (target, feature_set, model)""")
def final_ranking_class(spark, sf):
    """Ranks of classifiers; weights written out in the SQL."""
    out = rp.final_ranking(class_leaderboard(spark, sf), task="classification", simulations=50)
    return out.select(*KEYS, "selection_rank", "test_performance_rank", "generalization_rank", *_FIVE)


@query("failures", f"""WITH {F2}, e AS (SELECT DISTINCT target, feature_set, model FROM f2), c AS (SELECT DISTINCT target, feature_set, model FROM f2 WHERE part = 'test' AND y_pred > 104)
SELECT target, feature_set, model, CASE WHEN feature_set = 'R' THEN 'no file' ELSE 'not scored' END AS reason FROM e ANTI JOIN c USING (target, feature_set, model)""")
def failures(spark, sf):
    rows = predictions(spark, sf)
    reasons = rows.where("feature_set = 'R'").select(*KEYS).distinct().withColumn("reason", F.lit("no file"))
    return rp.failures(rows, rows.where("part = 'test' AND y_pred > 104"), reasons)


@query("paper_table", f"""WITH {CLB} SELECT row_number() OVER (PARTITION BY target ORDER BY val_macro_f1 DESC NULLS LAST, cv_macro_f1 DESC NULLS LAST, cv_macro_f1_std NULLS LAST, abs(train_macro_f1 - cv_macro_f1) NULLS LAST, model, feature_set) AS overall_rank,
target, model, feature_set, format('{{:.2f}} ± {{:.2f}}', cv_macro_f1, cv_macro_f1_std) AS cv_cell, format('{{:.2f}}', train_macro_f1) AS train_cell, format('{{:.2f}}', val_macro_f1) AS val_cell, format('{{:.2f}}', test_macro_f1) AS test_cell,
cv_macro_f1, cv_macro_f1_std, val_macro_f1, test_macro_f1 FROM clb""")
def paper_table(spark, sf):
    return rp.paper_table(class_leaderboard(spark, sf), 2)


# ------------------------------------------------------------------ streams


def _stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}*.parquet")


RULES = {"negative": "value < 0", "above_400": "value > 400", "no_type": "event_type IS NULL"}


@query("stream_quality", """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), w AS (SELECT date_trunc('hour', ts) AS ws, event_type, count(*) AS n, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value > 400) AS above_400,
 count(*) FILTER (event_type IS NULL) AS no_type FROM events GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, event_type, n, negative, above_400, no_type FROM w, m WHERE ws + INTERVAL 1 HOUR <= mark""")
def stream_quality(spark, sf):
    """Violations per hour and event type of the arriving events; windows that are still open are not reported."""
    root = scratch_path(spark, "stream")
    out = run_available(quality_of(_stream(spark, sf, "events"), RULES, "ts", "1 hour", "10 minutes", "event_type"), f"{root}/out", f"{root}/state")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", *RULES)


@query("stream_score", f"""WITH {F1}, a AS (SELECT avg(y) AS my, avg(quantity) AS mq, avg(tax) AS mt, var_pop(quantity) AS vq, var_pop(tax) AS vt, covar_pop(y, quantity) AS cq, covar_pop(y, tax) AS ct, covar_pop(quantity, tax) AS c FROM f1),
b AS (SELECT *, (cq*vt - ct*c)/(vq*vt - c*c) AS b1, (ct*vq - cq*c)/(vq*vt - c*c) AS b2 FROM a)
SELECT l_returnflag AS flag, count(*) AS n, round(avg(my + b1*(l_quantity - mq) + b2*(l_tax - mt)), 6) AS mean_prediction FROM lineitem, b GROUP BY flag""")
def stream_score(spark, sf):
    """Arriving line items scored by a stored least-squares model."""
    root = scratch_path(spark, "stream")
    names = ["quantity", "tax"]
    c = cv.Candidate("regression", "MLR", names, label="y")
    stores.save_model(cv.fit(samples(spark, sf), c), {"features": names, "target": "y"}, f"{root}/model", spark)
    model, meta = stores.load_model(f"{root}/model", spark)
    rows = _stream(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))
    scored = run_available(scores_of(rows, model, meta["features"], ["flag"], (40.0, 60.0)), f"{root}/out", f"{root}/state")
    return rd(scored.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction")))

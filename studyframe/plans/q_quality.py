"""Queries: quality profile, descriptions, group and fold summaries, importances, learning curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions.columns import round_doubles as rd, steady
from studyframe.operators import aggregates as a, quality as q, ranking, selection as sel, schema as sc
from studyframe.plans.fixtures import CLB, F1, F2, F3, FEATURES, KEYS, LABELS, LB, class_metric_sql, class_predictions, fold_scores, leaderboard, predictions, samples
from studyframe.plans.registry import query, steady_sql
from studyframe.sources.tables import read_table

NUM = [*FEATURES, "discount_n", "y"]


def _per_column(template: str, cols=NUM) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


@query("missing_rate", f"WITH {F1} " + _per_column("SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM f1"))
def missing_rate(spark, sf):
    return rd(q.missing_rate(samples(spark, sf), NUM))


@query("duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem)) AS duplicate_rows FROM lineitem")
def duplicate_rows(spark, sf):
    return q.duplicate_rows(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


CHK = """ck AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_quantity - 2 AS margin, l_discount * 1000 AS discount_pct, l_tax AS tax_rate FROM lineitem),
vi AS (SELECT id, unnest([CASE WHEN margin < 0 THEN 'margin_nonnegative' END, CASE WHEN discount_pct < 0 THEN 'discount_pct_nonnegative' END, CASE WHEN tax_rate < 0 THEN 'tax_rate_nonnegative' END,
  CASE WHEN discount_pct < 0 OR discount_pct > 100 THEN 'discount_pct_in_0_100' END, CASE WHEN tax_rate < 0 OR tax_rate > 100 THEN 'tax_rate_in_0_100' END]) AS rule FROM ck),
ru AS (SELECT * FROM (VALUES ('margin_nonnegative', 'margin must be >= 0'), ('discount_pct_nonnegative', 'discount_pct must be >= 0'), ('tax_rate_nonnegative', 'tax_rate must be >= 0'),
  ('discount_pct_in_0_100', 'discount_pct must be within [0, 100]'), ('tax_rate_in_0_100', 'tax_rate must be within [0, 100]')) v(rule, condition)),
fi AS (SELECT rule, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS examples FROM (SELECT * FROM vi WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule ORDER BY id) <= 5) GROUP BY rule),
cn AS (SELECT rule, count(*) AS n FROM vi WHERE rule IS NOT NULL GROUP BY rule),
rs AS (SELECT ru.rule, condition, coalesce(n, 0) = 0 AS passed, coalesce(n, 0) AS n_violations, coalesce(examples, '') AS examples FROM ru LEFT JOIN cn ON ru.rule = cn.rule LEFT JOIN fi ON ru.rule = fi.rule)"""


def _checks(spark, sf):
    table = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") - 2).alias("margin"),
        (F.col("l_discount") * 1000).alias("discount_pct"), F.col("l_tax").alias("tax_rate"),
    )
    return table, q.constraint_checks(table, ["margin", "discount_pct", "tax_rate"], "id")


@query("constraint_checks", f"WITH {CHK} SELECT * FROM rs")
def constraint_checks(spark, sf):
    return _checks(spark, sf)[1]


@query("quality_status", f"""WITH {CHK}, {F1}, m AS ({_per_column("SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM f1")})
SELECT CASE WHEN max(r) >= 0.25 THEN 'FAIL' WHEN max(r) >= 0.05 OR (SELECT sum(n_violations) FROM rs) > 0 THEN 'WARN' ELSE 'PASS' END AS status,
 round(max(r), 6) AS worst_missing_rate, (SELECT sum(n_violations) FROM rs)::BIGINT AS n_violations FROM m""")
def quality_status(spark, sf):
    return rd(q.quality_status(q.missing_rate(samples(spark, sf), NUM), _checks(spark, sf)[1]))


_DESC = """round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS std, round(min({c}), 8) AS min, round(quantile_cont({c}, 0.25), 8) AS p25,
 round(quantile_cont({c}, 0.5), 8) AS p50, round(quantile_cont({c}, 0.75), 8) AS p75, round(max({c}), 8) AS max"""


@query("describe_table", steady_sql(f"WITH {F1} " + _per_column("SELECT '{c}' AS \"column\", count({c}) AS \"count\", " + _DESC + " FROM f1")))
def describe_table(spark, sf):
    return steady(q.describe_table(samples(spark, sf), NUM), 8)


@query("group_describe", steady_sql(f"WITH {F1}, b AS (SELECT *, unnest([label, 'full']) AS split FROM f1) " + _per_column("SELECT split, '{c}' AS \"column\", count({c}) AS \"count\", " + _DESC + " FROM b GROUP BY split", ["quantity", "discount_n", "y"])))
def group_describe(spark, sf):
    return steady(q.group_describe(samples(spark, sf).withColumnRenamed("label", "split"), ["quantity", "discount_n", "y"], "split"), 8)


@query("class_counts", f"WITH {F3} SELECT split, y_true AS label, count(*) AS n FROM (SELECT y_true, unnest([part, 'full']) AS split FROM f3) GROUP BY ALL")
def class_counts(spark, sf):
    return q.class_counts(class_predictions(spark, sf), "y_true", "part")


@query("histogram", f"""WITH {F1}, st AS (SELECT min(y) AS lo, max(y) AS hi, avg(y) AS mu, stddev_samp(y) AS sd FROM f1),
h AS (SELECT label, least(floor((y - lo) * 30.0::DOUBLE / (hi - lo)), 29)::INTEGER AS bin, count(*) AS n FROM f1, st GROUP BY ALL)
SELECT label, bin, round(lo + bin * ((hi - lo) / 30), 6) AS bin_start, n, round(n / (sum(n) OVER (PARTITION BY label) * ((hi - lo) / 30)), 6) AS density,
 round(exp(-1.0::DOUBLE * ((((lo + (bin + 0.5) * ((hi - lo) / 30)) - mu) / sd)^2) / 2) / (sd * sqrt(2 * pi())), 6) AS normal_density FROM h, st""")
def histogram(spark, sf):
    return rd(q.histogram(samples(spark, sf), "y", 30, ["label"]))


@query("histogram_auto")
def histogram_auto(spark, sf):
    return rd(q.histogram(samples(spark, sf), "retail"))


# ------------------------------------------------------------------ groups and folds


@query("group_diagnostics_reg", steady_sql(f"""WITH {F2} SELECT target, fold, grp, count(*) AS n_samples, round(avg(y_true), 6) AS target_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(y_true) ELSE 0 END, 6) AS target_std,
 round(min(y_true), 6) AS target_min, round(max(y_true), 6) AS target_max, round(avg(y_pred), 6) AS prediction_mean, round(avg(abs(y_pred-y_true)), 6) AS mae,
 round(sqrt(avg((y_pred-y_true)^2)), 6) AS rmse, round(avg(y_pred-y_true), 6) AS bias, string_agg(DISTINCT feature_set, ' | ' ORDER BY feature_set) AS feature_set,
 round(CASE WHEN count(*) >= 2 THEN 1 - sum((y_pred-y_true)^2) / (var_pop(y_true)*count(*)) END, 6) AS r2 FROM f2 WHERE part = 'cv' GROUP BY target, fold, grp"""))
def group_diagnostics_reg(spark, sf):
    out = a.group_diagnostics_reg(predictions(spark, sf).where("part = 'cv'"), "fold", "grp", ["feature_set"], ["target"])
    return steady(out)


@query("group_diagnostics_class", f"""WITH {F3}, cv AS (SELECT * FROM f3 WHERE part = 'cv'), s AS (SELECT * FROM {class_metric_sql('cv', 'target, fold, grp')}),
n AS (SELECT target, fold, grp, {', '.join(f"count(*) FILTER (y_true = {c}) AS actual_class_{c}_n, count(*) FILTER (y_pred = {c}) AS predicted_class_{c}_n" for c in LABELS)} FROM cv GROUP BY ALL)
SELECT target, fold, grp, s.n AS n_samples, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy,
 {', '.join(f"actual_class_{c}_n, predicted_class_{c}_n" for c in LABELS)} FROM s JOIN n USING (target, fold, grp)""")
def group_diagnostics_class(spark, sf):
    return rd(a.group_diagnostics_class(class_predictions(spark, sf).where("part = 'cv'"), "fold", "grp", LABELS, ["target"]))


@query("fold_summary", steady_sql(f"""WITH {F2}, cv AS (SELECT * FROM f2 WHERE part = 'cv'), fo AS (SELECT DISTINCT target, model, fold FROM cv),
i AS (SELECT fo.target, fo.model, fo.fold, count(*) AS n_inner_train, avg(y_true) AS m, stddev_samp(y_true) AS sd, count(DISTINCT grp) AS n_train_groups
  FROM fo JOIN cv ON fo.target = cv.target AND fo.model = cv.model AND fo.fold <> cv.fold GROUP BY ALL),
o AS (SELECT target, model, fold, count(*) AS n, count(DISTINCT grp) AS g, 1 - sum((y_pred-y_true)^2)/(var_pop(y_true)*count(*)) AS r2, avg(abs(y_pred-y_true)) AS mae, sqrt(avg((y_pred-y_true)^2)) AS rmse,
  avg(y_pred-y_true) AS bias, avg(y_true) AS m, stddev_samp(y_true) AS sd, min(y_true) AS lo, max(y_true) AS hi FROM cv GROUP BY ALL),
ov AS (SELECT a.target, a.model, a.fold, count(DISTINCT a.grp) AS k FROM cv a JOIN (SELECT DISTINCT target, model, fold, grp FROM cv) b ON a.target = b.target AND a.model = b.model AND a.grp = b.grp AND a.fold <> b.fold GROUP BY ALL)
SELECT target, model, fold, n_inner_train, n AS n_outer_validation, round(r2, 6) AS outer_r2, round(mae, 6) AS outer_mae, round(rmse, 6) AS outer_rmse, round(bias, 6) AS outer_bias,
 round(o.m, 6) AS outer_target_mean, round(o.sd, 6) AS outer_target_std, round(lo, 6) AS outer_target_min, round(hi, 6) AS outer_target_max, round(i.m, 6) AS inner_target_mean, round(i.sd, 6) AS inner_target_std,
 g AS n_validation_groups, n_train_groups, coalesce(k, 0) AS group_overlap_count FROM o JOIN i USING (target, model, fold) LEFT JOIN ov USING (target, model, fold)"""))
def fold_summary(spark, sf):
    return steady(a.fold_summary(predictions(spark, sf).where("part = 'cv'"), ["target", "model"], "fold", "grp"))


@query("nested_summary", f"WITH {LB} SELECT target, feature_set, model, count(*) AS folds, round(avg(r2), 6) AS mean_score, round(stddev_samp(r2), 6) AS sd_score, round(avg(sqrt(mse)), 6) AS secondary_mean FROM sc WHERE part = 'cv' GROUP BY ALL")
def nested_summary(spark, sf):
    return rd(a.nested_summary(fold_scores(predictions(spark, sf).where("part = 'cv'"), agreement=False), "r2", "rmse", KEYS))


@query("cv_distribution", f"""WITH {LB}, l AS (SELECT target, feature_set, model, unnest(['r2', 'rmse', 'mae']) AS metric, unnest([r2, sqrt(mse), mae]) AS v FROM sc WHERE part = 'cv')
SELECT target, feature_set, model, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
 round(avg(v) - 1.96*stddev_pop(v)/sqrt(count(v)), 6) AS ci_lower, round(avg(v) + 1.96*stddev_pop(v)/sqrt(count(v)), 6) AS ci_upper, round(2*1.96*stddev_pop(v)/sqrt(count(v)), 6) AS ci_width FROM l GROUP BY ALL""")
def cv_distribution(spark, sf):
    return rd(a.cv_distribution(fold_scores(predictions(spark, sf).where("part = 'cv'"), agreement=False), ["r2", "rmse", "mae"], KEYS))


# ------------------------------------------------------------------ importances

IMP = F1 + """, im AS (""" + " UNION ALL ".join(
    f"SELECT 'regression' AS task, 'GL' AS family, status AS target, label AS feature_set, brand AS model, '{c}' AS feature, ROUND(corr({c}, y), 6) AS mean_importance FROM f1 GROUP BY status, label, brand" for c in FEATURES
) + ")"


def importances(spark, sf):
    """Signed correlation of every feature with the target, per model: a stand-in for importances."""
    groups = samples(spark, sf).groupBy(F.col("status").alias("target"), F.col("label").alias("feature_set"), F.col("brand").alias("model"))
    wide = groups.agg(*[F.round(F.corr(c, "y"), 6).alias(c) for c in FEATURES])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_importance")) for c in FEATURES])
    return wide.select(F.lit("regression").alias("task"), F.lit("GL").alias("family"), "target", "feature_set", "model", F.inline(pairs))


@query("importance_summary", f"""WITH {IMP}, g AS (SELECT task, family, target, feature_set, feature, count(DISTINCT model) AS number_of_models, count(mean_importance) AS number_of_records, avg(mean_importance) AS m,
 median(mean_importance) AS md, stddev_samp(mean_importance) AS sd, min(mean_importance) AS lo, max(mean_importance) AS hi FROM im GROUP BY ALL)
SELECT task, family, target, feature_set, feature, number_of_models, number_of_records, round(m, 6) AS mean_importance, round(md, 6) AS median_importance, round(sd, 6) AS importance_std_across_models,
 round(lo, 6) AS minimum_importance, round(hi, 6) AS maximum_importance,
 round(CASE WHEN sum(greatest(m, 0)) OVER w > 0 THEN greatest(m, 0) / sum(greatest(m, 0)) OVER w * 100 ELSE abs(m) / sum(abs(m)) OVER w * 100 END, 6) AS relative_contribution_pct,
 dense_rank() OVER (PARTITION BY task, family, target, feature_set ORDER BY m DESC) AS importance_rank FROM g WINDOW w AS (PARTITION BY task, family, target, feature_set)""")
def importance_summary(spark, sf):
    return rd(a.importance_summary(importances(spark, sf)))


@query("relative_contribution", steady_sql(f"""WITH {IMP} SELECT target, feature_set, model, feature, mean_importance, round(CASE WHEN sum(greatest(mean_importance, 0)) OVER w > 0 THEN greatest(mean_importance, 0) / sum(greatest(mean_importance, 0)) OVER w * 100
 WHEN sum(abs(mean_importance)) OVER w > 0 THEN abs(mean_importance) / sum(abs(mean_importance)) OVER w * 100 END, 6) + 0.0::DOUBLE AS relative_contribution_pct FROM im WINDOW w AS (PARTITION BY target, feature_set, model)"""))
def relative_contribution(spark, sf):
    out = a.relative_contribution(importances(spark, sf), KEYS)
    return steady(out.select(*KEYS, "feature", "mean_importance", "relative_contribution_pct"))


@query("abs_contribution", steady_sql(f"""WITH {IMP} SELECT target, feature_set, model, feature, abs(mean_importance) AS absolute_importance, round(CASE WHEN sum(abs(mean_importance)) OVER w > 0 THEN abs(mean_importance) / sum(abs(mean_importance)) OVER w * 100 ELSE 0 END, 6) AS relative_contribution_percent
FROM im WINDOW w AS (PARTITION BY target, feature_set, model)"""))
def abs_contribution(spark, sf):
    out = a.abs_contribution(importances(spark, sf), KEYS)
    return steady(out.select(*KEYS, "feature", "absolute_importance", "relative_contribution_percent"))


@query("window_share", steady_sql(f"WITH {IMP} SELECT target, feature_set, model, feature, round(abs(mean_importance) / sum(abs(mean_importance)) OVER (PARTITION BY target, feature_set, model) * 100, 6) AS share FROM im"))
def window_share(spark, sf):
    return steady(importances(spark, sf).select(*KEYS, "feature", ranking.window_share(F.abs("mean_importance"), KEYS).alias("share")))


@query("rank_dense", f"WITH {IMP} SELECT target, feature_set, model, feature, dense_rank() OVER (PARTITION BY target, feature_set, model ORDER BY round(mean_importance, 2) DESC) AS place FROM im")
def rank_dense(spark, sf):
    return importances(spark, sf).select(*KEYS, "feature", ranking.rank_dense(F.round("mean_importance", 2), False, KEYS).alias("place"))


@query("top_features", f"WITH {IMP} SELECT target, feature_set, model, feature, mean_importance, row_number() OVER (PARTITION BY target, feature_set, model ORDER BY abs(mean_importance) DESC NULLS LAST, feature) AS place FROM im QUALIFY place <= 3")
def top_features(spark, sf):
    return sel.top_features(importances(spark, sf), 3).select(*KEYS, "feature", "mean_importance", "place")


@query("normalize_importances", f"""WITH {IMP} SELECT target, feature_set, model, feature, mean_importance, round(CASE WHEN max(abs(mean_importance)) OVER (PARTITION BY target, feature_set, model) <= 1 THEN mean_importance * 100 ELSE mean_importance END, 6) + 0.0::DOUBLE AS importance_pct FROM im""")
def normalize_importances(spark, sf):
    raw = importances(spark, sf).withColumnRenamed("mean_importance", "Permutation Importance").withColumnRenamed("feature", "Variable")
    out = sc.normalize_importances(raw, KEYS)
    return rd(out.select(*KEYS, "feature", "mean_importance", "importance_pct"))


@query("row_order", f"WITH {LB} SELECT target, feature_set, model, row_number() OVER (PARTITION BY target ORDER BY cv_r2_mean DESC NULLS LAST, cv_r2_std NULLS LAST, r2_test DESC NULLS LAST, model, feature_set) AS overall_rank FROM lb")
def row_order(spark, sf):
    order = [("cv_r2_mean", False), ("cv_r2_std", True), ("r2_test", False), ("model", True), ("feature_set", True)]
    return ranking.row_order(leaderboard(spark, sf), order, ["target"]).select(*KEYS, "overall_rank")


# ------------------------------------------------------------------ learning curves

CURVE = LB + f""", fr AS (SELECT target, feature_set, model, CASE WHEN part = 'train' THEN 'train' ELSE 'cv' END AS part, fold, count(*) AS n, 1 - sum((y_true-y_pred)^2) / (var_pop(y_true) * count(*)) AS r2
  FROM f2 WHERE part <> 'test' GROUP BY ALL),
cu AS (SELECT target, feature_set, model, step, sum(CASE WHEN part = 'train' THEN n END)::BIGINT AS train_size, avg(CASE WHEN part = 'train' THEN r2 END) AS train_mean,
  coalesce(stddev_samp(CASE WHEN part = 'train' THEN r2 END), 0) AS train_sd, avg(CASE WHEN part = 'cv' THEN r2 END) AS cv_mean, coalesce(stddev_samp(CASE WHEN part = 'cv' THEN r2 END), 0) AS cv_sd
  FROM fr JOIN range(1, 6) s(step) ON fold < step GROUP BY target, feature_set, model, step)"""


def curves(spark, sf):
    """Scores over growing sets of folds: the curve table of every model."""
    from studyframe.operators.metrics import regression_metrics

    scores = regression_metrics(predictions(spark, sf).where("part <> 'test'"), [*KEYS, "part", "fold"], agreement=False)
    scores = scores.withColumn("step", F.explode(F.sequence(F.col("fold") + 1, F.lit(5))))
    of = lambda part: F.when(F.col("part") == part, F.col("r2"))
    return scores.groupBy(*KEYS, "step").agg(
        F.sum(F.when(F.col("part") == "train", F.col("n"))).alias("train_size"), F.avg(of("train")).alias("train_mean"),
        F.coalesce(F.stddev_samp(of("train")), F.lit(0.0)).alias("train_sd"), F.avg(of("cv")).alias("cv_mean"),
        F.coalesce(F.stddev_samp(of("cv")), F.lit(0.0)).alias("cv_sd"),
    )


LEARN = CURVE + """, lg AS (SELECT *, lag(cv_mean) OVER (PARTITION BY target, feature_set, model ORDER BY train_size) AS before FROM cu),
ls AS (SELECT target, feature_set, model, min(train_size) AS initial_train_size, max(train_size) AS final_train_size, arg_min(train_mean, train_size) AS initial_train, arg_max(train_mean, train_size) AS final_train,
  arg_min(cv_mean, train_size) AS initial_cv, arg_max(cv_mean, train_size) AS final_cv, arg_max(cv_mean, train_size) - arg_min(cv_mean, train_size) AS cv_gain,
  coalesce(arg_max(cv_mean - before, train_size), 0) AS recent_cv_gain, arg_max(train_mean - cv_mean, train_size) AS final_train_cv_gap, max(abs(train_mean - cv_mean)) AS max_abs_train_cv_gap,
  arg_min(train_sd, train_size) AS initial_train_sd, arg_max(train_sd, train_size) AS final_train_sd, arg_max(train_sd, train_size) - arg_min(train_sd, train_size) AS train_sd_change,
  arg_min(cv_sd, train_size) AS initial_cv_sd, arg_max(cv_sd, train_size) AS final_cv_sd, arg_max(cv_sd, train_size) - arg_min(cv_sd, train_size) AS cv_sd_change FROM lg GROUP BY ALL),
lv AS (SELECT *, CASE WHEN cv_gain >= 0.02 THEN 'improving' WHEN cv_gain <= -0.02 THEN 'declining' ELSE 'near plateau' END AS validation_trend,
  CASE WHEN abs(final_train_cv_gap) <= 0.05 THEN 'small' WHEN abs(final_train_cv_gap) <= 0.10 THEN 'moderate' ELSE 'large' END AS final_gap_level, cv_gain >= 0.05 AND recent_cv_gain >= -0.01 AS more_data_likely_helpful FROM ls)"""
_LD = ["initial_train", "final_train", "initial_cv", "final_cv", "cv_gain", "recent_cv_gain", "final_train_cv_gap", "max_abs_train_cv_gap", "initial_train_sd", "final_train_sd", "train_sd_change", "initial_cv_sd", "final_cv_sd", "cv_sd_change"]


@query("learning_summary", f"WITH {LEARN} SELECT target, feature_set, model, initial_train_size, final_train_size, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in _LD)}, validation_trend, final_gap_level, more_data_likely_helpful FROM lv")
def learning_summary(spark, sf):
    return rd(a.learning_summary(curves(spark, sf)))


@query("learning_by_feature_set", f"""WITH {LEARN} , w AS (SELECT target, feature_set, count(*) AS models, avg(cv_gain) AS mean_cv_gain, median(final_cv) AS median_final_cv, median(abs(final_train_cv_gap)) AS median_abs_final_gap, avg(final_cv_sd) AS mean_final_cv_sd,
 count(*) FILTER (more_data_likely_helpful) AS models_likely_helped_by_more_data, count(*) FILTER (validation_trend = 'improving') AS improving_models, count(*) FILTER (final_gap_level = 'small') AS small_gap_models, count(*) FILTER (cv_sd_change < 0) AS lower_sd_models FROM lv GROUP BY ALL)
SELECT target, feature_set, models, round(mean_cv_gain, 6) AS mean_cv_gain, round(median_final_cv, 6) AS median_final_cv, round(median_abs_final_gap, 6) AS median_abs_final_gap, round(mean_final_cv_sd, 6) AS mean_final_cv_sd, models_likely_helped_by_more_data, improving_models, small_gap_models, lower_sd_models,
 CASE WHEN improving_models >= greatest(1, models // 2) THEN 'generally improving' WHEN median_abs_final_gap > 0.10 THEN 'limited gain, large gap' ELSE 'stable, near plateau' END AS interpretation FROM w""")
def learning_by_feature_set(spark, sf):
    return rd(a.learning_by_feature_set(a.learning_summary(curves(spark, sf))))


@query("first_last_lag", f"""WITH {LEARN} SELECT target, feature_set, model, round(initial_cv, 6) AS first_value, round(final_cv, 6) AS last_value, round(cv_gain, 6) + 0.0::DOUBLE AS total_gain, round(recent_cv_gain, 6) + 0.0::DOUBLE AS recent_gain FROM lv""")
def first_last_lag(spark, sf):
    return rd(ranking.first_last_lag(curves(spark, sf), "cv_mean", "train_size", KEYS))


@query("hyperparameter_marginals", f"""WITH {LB}, p AS (SELECT target, unnest(['features', 'depth']) AS parameter, unnest([feature_set, 'd' || (CAST(substr(model, 2) AS INTEGER) % 5)]) AS parameter_value, r2_train, cv_r2_mean, cv_r2_std FROM lb),
m AS (SELECT target, parameter, parameter_value, avg(r2_train) AS tr, avg(cv_r2_std) AS ts, avg(cv_r2_mean) AS cv, avg(cv_r2_std) AS cs FROM p GROUP BY ALL)
SELECT target, parameter, parameter_value, round(tr, 6) AS train_score, round(ts, 6) AS train_sd, round(cv, 6) AS cv_score, round(cs, 6) AS cv_sd, round(tr - cv, 6) + 0.0::DOUBLE AS generalization_gap,
 row_number() OVER (PARTITION BY target, parameter ORDER BY cv DESC NULLS LAST, parameter_value) = 1 AS best_marginal FROM m""")
def hyperparameter_marginals(spark, sf):
    lb = leaderboard(spark, sf)
    depth = F.concat(F.lit("d"), (F.substring("model", 2, 9).cast("int") % 5).cast("string"))
    results = lb.select("target", F.create_map(F.lit("features"), F.col("feature_set"), F.lit("depth"), depth).alias("params"), F.col("r2_train").alias("mean_train"),
                        F.col("cv_r2_std").alias("std_train"), F.col("cv_r2_mean").alias("mean_test"), F.col("cv_r2_std").alias("std_test"))
    return rd(a.hyperparameter_marginals(results, ["target"]))


@query("performance_distribution", f"""WITH {LB}, l AS (SELECT target, unnest(['r2_test', 'p20_test', 'mae_test', 'rmse_test']) AS metric, unnest([r2_test, p20_test, mae_test, rmse_test]) AS v FROM lb)
SELECT target, metric, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
 CASE metric WHEN 'r2_test' THEN CASE WHEN max(v) >= 0.8 THEN 'EXCELLENT' WHEN max(v) >= 0.6 THEN 'GOOD' WHEN max(v) >= 0.4 THEN 'MODERATE' ELSE 'POOR' END
 WHEN 'p20_test' THEN CASE WHEN max(v) >= 90 THEN 'EXCELLENT' WHEN max(v) >= 80 THEN 'GOOD' WHEN max(v) >= 70 THEN 'ACCEPTABLE' ELSE 'POOR' END END AS grade,
 CASE WHEN count(v) >= 10 THEN 'ADEQUATE' WHEN count(v) >= 5 THEN 'LIMITED' ELSE 'LOW' END AS power FROM l GROUP BY target, metric""")
def performance_distribution(spark, sf):
    return rd(a.performance_distribution(leaderboard(spark, sf), ["r2_test", "p20_test", "mae_test", "rmse_test"], ["target"]))

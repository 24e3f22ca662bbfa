"""Summaries of folds, groups, importances, learning curves and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.functions.columns import join_small, joined_sorted, kept
from studyframe.operators.metrics import _pairs, _r2, classification_metrics, confusion_long


def group_diagnostics_reg(
    pred: DataFrame, fold: str, group: str, meta: Sequence[str] = (), keys: Sequence[str] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """Scores and target statistics of each held-out group; ``meta`` columns are listed as joined texts."""
    e = F.col(p) - F.col(y)
    n = F.count(F.lit(1))
    names = [*keys, fold, group]
    out = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*names).agg(
        n.alias("n_samples"),
        F.avg(y).alias("target_mean"),
        F.when(n > 1, F.stddev_samp(y)).otherwise(0.0).alias("target_std"),
        F.min(y).alias("target_min"),
        F.max(y).alias("target_max"),
        F.avg(p).alias("prediction_mean"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_var"),
        *[joined_sorted(F.col(c).cast("string")).alias(c) for c in meta],
    )
    r2 = F.when(F.col("n_samples") >= 2, _r2(F.col("_sse"), F.col("_var") * F.col("n_samples")))
    return out.withColumn("r2", r2).drop("_sse", "_var")


def group_diagnostics_class(
    pred: DataFrame, fold: str, group: str, labels: Sequence[int], keys: Sequence[str] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """Scores of each held-out group and its actual and predicted class counts."""
    names = [*keys, fold, group]
    cells = confusion_long(pred, labels, names, y, p)
    n_of = lambda side, c: F.sum(F.when(F.col(side) == c, F.col("n")).otherwise(0)).cast("bigint")
    counts = cells.groupBy(*names).agg(
        *[n_of("true_label", c).alias(f"actual_class_{c}_n") for c in labels],
        *[n_of("pred_label", c).alias(f"predicted_class_{c}_n") for c in labels],
    )
    scores = classification_metrics(cells, names).select(*names, F.col("n").alias("n_samples"), "macro_f1", "balanced_accuracy", "accuracy")
    return scores.join(counts, names)


def fold_summary(pred: DataFrame, keys: Sequence[str], fold: str = "fold", group: str | None = None, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per outer fold: sizes, held-out scores, target statistics inside and outside, group counts.

    The statistics of the rows outside a fold are the merged counts, means and squared deviations of all folds
    with the fold's own taken out, so rows are read once and large means cost no digits.
    """
    keys = list(keys)
    names = [*keys, fold]
    e = F.col(p) - F.col(y)
    per = pred.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n_outer_validation"),
        F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("outer_mae"), F.avg(e).alias("outer_bias"),
        F.var_pop(y).alias("_var"), F.avg(y).alias("outer_target_mean"), F.stddev_samp(y).alias("_sd"),
        F.min(y).alias("outer_target_min"), F.max(y).alias("outer_target_max"),
    )
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    n = F.col("n_outer_validation")
    mean = F.col("outer_target_mean")
    shift = F.min(mean).over(w)
    per = per.withColumn("_shift", shift)
    off = mean - F.col("_shift")
    per = per.withColumns({"_an": F.sum(n).over(w), "_as": F.sum(n * off).over(w), "_aq": F.sum(n * F.col("_var") + n * off * off).over(w)})
    inner_n = F.col("_an") - n
    inner_off = (F.col("_as") - n * off) / F.nullif(inner_n, F.lit(0))
    inner_mean = F.col("_shift") + inner_off
    inner_sq = F.col("_aq") - n * F.col("_var") - n * off * off
    inner_var = (inner_sq - inner_n * inner_off * inner_off) / F.nullif(inner_n - 1, F.lit(0))
    out = per.select(
        *names,
        inner_n.alias("n_inner_train"),
        "n_outer_validation",
        F.when(n >= 2, _r2(F.col("_sse"), F.col("_var") * n)).alias("outer_r2"),
        "outer_mae",
        F.sqrt(F.col("_sse") / n).alias("outer_rmse"),
        "outer_bias",
        "outer_target_mean",
        F.coalesce("_sd", F.lit(0.0)).alias("outer_target_std"),
        "outer_target_min",
        "outer_target_max",
        inner_mean.alias("inner_target_mean"),
        F.coalesce(F.sqrt(F.greatest(inner_var, F.lit(0.0))), F.lit(0.0)).alias("inner_target_std"),
    )
    if group is None:
        return out
    seen = kept(pred.groupBy(*names, group).agg(F.count(F.lit(1)).alias("_c")))
    folds_of = seen.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_f"), F.min(fold).alias("_only"))
    total = folds_of.groupBy(*keys).agg(F.count(F.lit(1)).alias("_groups"))
    own = folds_of.where(F.col("_f") == 1).groupBy(*keys, F.col("_only").alias(fold)).agg(F.count(F.lit(1)).alias("_own"))
    inside = seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n_validation_groups"))
    counted = join_small(join_small(inside, own, names, "left"), total, keys)
    own_n = F.coalesce("_own", F.lit(0))
    counted = counted.select(
        *names, "n_validation_groups", (F.col("_groups") - own_n).cast("bigint").alias("n_train_groups"),
        (F.col("n_validation_groups") - own_n).cast("bigint").alias("group_overlap_count"),
    )
    return join_small(out, counted, names, "left")


def nested_summary(folds: DataFrame, score: str, secondary: str, keys: Sequence[str]) -> DataFrame:
    """Mean and sample sd of the fold score, mean of the secondary score."""
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("sd_score"),
        F.avg(secondary).alias("secondary_mean"),
    )


def cv_distribution(fold_scores: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean, population sd, median, IQR and normal interval of fold scores, one line per metric."""
    long = fold_scores.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*keys, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), q.alias("_q")
    )
    half = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double"))).otherwise(0.0)
    return out.select(
        *keys, "metric", "n", "mean", "sd", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
        (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"), (2 * half).alias("ci_width"),
    )


# ------------------------------------------------------------------ importances


def contribution(value: Column, part: Sequence[str]) -> Column:
    """Positive share in percent; without positive values the share of absolutes; NULL if all are zero."""
    w = W.partitionBy(*part)
    positive = F.when(value > 0, value).otherwise(F.when(value.isNotNull(), 0.0))
    up, size = F.sum(positive).over(w), F.sum(F.abs(value)).over(w)
    return F.when(up > 0, positive / up * 100.0).when(size > 0, F.abs(value) / size * 100.0)


def relative_contribution(imp: DataFrame, part: Sequence[str], value: str = "mean_importance") -> DataFrame:
    return imp.withColumn("relative_contribution_pct", contribution(F.col(value), part))


def abs_contribution(imp: DataFrame, part: Sequence[str], value: str = "mean_importance") -> DataFrame:
    """|value| as percent of the sum of absolutes in the group; 0 when that sum is 0."""
    total = F.sum(F.abs(value)).over(W.partitionBy(*part))
    return imp.withColumn("absolute_importance", F.abs(value)).withColumn(
        "relative_contribution_percent", F.when(total > 0, F.abs(value) / total * 100.0).otherwise(0.0)
    )


def importance_summary(imp: DataFrame, group: Sequence[str] = ("task", "family", "target", "feature_set"), value: str = "mean_importance") -> DataFrame:
    """Importance of each feature over all models, its share and its dense rank."""
    out = imp.groupBy(*group, "feature").agg(
        F.count_distinct("model").alias("number_of_models"),
        F.count(value).alias("number_of_records"),
        F.avg(value).alias("mean_importance"),
        F.percentile(value, 0.5).alias("median_importance"),
        F.stddev_samp(value).alias("importance_std_across_models"),
        F.min(value).alias("minimum_importance"),
        F.max(value).alias("maximum_importance"),
    )
    out = relative_contribution(out, group)
    rank = F.dense_rank().over(W.partitionBy(*group).orderBy(F.col("mean_importance").desc_nulls_last()))
    return out.withColumn("importance_rank", F.when(F.col("mean_importance").isNotNull(), rank.cast("bigint")))


# ------------------------------------------------------------------ learning curves and searches

MORE_DATA_GAIN = {"regression": 0.05, "classification": 0.03}


def learning_summary(curves: DataFrame, task: str = "regression", keys: Sequence[str] = ("target", "feature_set", "model")) -> DataFrame:
    """First and last point of each model's curve, gains, gaps and the reading of both.

    ``curves``: keys, ``train_size, train_mean, train_sd, cv_mean, cv_sd``.
    """
    w = W.partitionBy(*keys).orderBy("train_size")
    point = F.struct("train_size", "train_mean", "train_sd", "cv_mean", "cv_sd", F.lag("cv_mean").over(w).alias("before"))
    out = curves.select(*keys, point.alias("_pt"), F.abs(F.col("train_mean") - F.col("cv_mean")).alias("_gap")).groupBy(*keys).agg(
        F.min_by("_pt", "_pt.train_size").alias("a"), F.max_by("_pt", "_pt.train_size").alias("z"), F.max("_gap").alias("max_abs_train_cv_gap")
    )
    gain = F.col("z.cv_mean") - F.col("a.cv_mean")
    recent = F.coalesce(F.col("z.cv_mean") - F.col("z.before"), F.lit(0.0))
    gap = F.col("z.train_mean") - F.col("z.cv_mean")
    return out.select(
        *keys,
        F.col("a.train_size").alias("initial_train_size"), F.col("z.train_size").alias("final_train_size"),
        F.col("a.train_mean").alias("initial_train"), F.col("z.train_mean").alias("final_train"),
        F.col("a.cv_mean").alias("initial_cv"), F.col("z.cv_mean").alias("final_cv"),
        gain.alias("cv_gain"), recent.alias("recent_cv_gain"), gap.alias("final_train_cv_gap"), "max_abs_train_cv_gap",
        F.col("a.train_sd").alias("initial_train_sd"), F.col("z.train_sd").alias("final_train_sd"),
        (F.col("z.train_sd") - F.col("a.train_sd")).alias("train_sd_change"),
        F.col("a.cv_sd").alias("initial_cv_sd"), F.col("z.cv_sd").alias("final_cv_sd"),
        (F.col("z.cv_sd") - F.col("a.cv_sd")).alias("cv_sd_change"),
        F.when(gain >= 0.02, "improving").when(gain <= -0.02, "declining").otherwise("near plateau").alias("validation_trend"),
        F.when(F.abs(gap) <= 0.05, "small").when(F.abs(gap) <= 0.10, "moderate").otherwise("large").alias("final_gap_level"),
        ((gain >= MORE_DATA_GAIN[task]) & (recent >= -0.01)).alias("more_data_likely_helpful"),
    )


def learning_by_feature_set(summary: DataFrame, keys: Sequence[str] = ("target", "feature_set")) -> DataFrame:
    """Counts, gains and verdict over the models of a feature set."""
    out = summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("models"),
        F.avg("cv_gain").alias("mean_cv_gain"),
        F.percentile("final_cv", 0.5).alias("median_final_cv"),
        F.percentile(F.abs("final_train_cv_gap"), 0.5).alias("median_abs_final_gap"),
        F.avg("final_cv_sd").alias("mean_final_cv_sd"),
        F.count_if("more_data_likely_helpful").alias("models_likely_helped_by_more_data"),
        F.count_if(F.col("validation_trend") == "improving").alias("improving_models"),
        F.count_if(F.col("final_gap_level") == "small").alias("small_gap_models"),
        F.count_if(F.col("cv_sd_change") < 0).alias("lower_sd_models"),
    )
    verdict = (
        F.when(F.col("improving_models") >= F.greatest(F.lit(1), F.floor(F.col("models") / 2)), "generally improving")
        .when(F.col("median_abs_final_gap") > 0.10, "limited gain, large gap")
        .otherwise("stable, near plateau")
    )
    return out.withColumn("interpretation", verdict)


def hyperparameter_marginals(cv_results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean scores per value of each parameter, over all values of the others.

    ``cv_results``: keys, ``params`` (map of texts), ``mean_train, std_train, mean_test, std_test``.
    """
    rows = cv_results.select(*keys, "mean_train", "std_train", "mean_test", "std_test", F.explode("params").alias("parameter", "parameter_value"))
    out = rows.groupBy(*keys, "parameter", "parameter_value").agg(
        F.avg("mean_train").alias("train_score"), F.avg("std_train").alias("train_sd"),
        F.avg("mean_test").alias("cv_score"), F.avg("std_test").alias("cv_sd"),
    )
    out = out.withColumn("generalization_gap", F.col("train_score") - F.col("cv_score"))
    best = F.row_number().over(W.partitionBy(*keys, "parameter").orderBy(F.col("cv_score").desc_nulls_last(), "parameter_value")) == 1
    return out.withColumn("best_marginal", best)


# ------------------------------------------------------------------ distribution of scores over models

# Lower limits and words of the verbal grades.
GRADES = {
    "r2_test": ((0.8, "EXCELLENT"), (0.6, "GOOD"), (0.4, "MODERATE"), (None, "POOR")),
    "p20_test": ((90.0, "EXCELLENT"), (80.0, "GOOD"), (70.0, "ACCEPTABLE"), (None, "POOR")),
    "rank_stability": ((0.9, "HIGH"), (0.7, "MODERATE"), (None, "LOW")),
    "models": ((10.0, "ADEQUATE"), (5.0, "LIMITED"), (None, "LOW")),
}


def grade(metric: str, value: Column) -> Column:
    out = F.lit(None).cast("string")
    for limit, word in reversed(GRADES.get(metric, ())):
        out = F.lit(word) if limit is None else F.when(value >= limit, word).otherwise(out)
    return out


def performance_distribution(lb: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Spread of each score over the models, a grade of the best (or mean) value, and of the model count."""
    long = lb.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*keys, "metric").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), q.alias("_q"),
    )
    graded = F.lit(None).cast("string")
    for m in metrics:
        if m in GRADES:
            graded = F.when(F.col("metric") == m, grade(m, F.col("mean") if m == "rank_stability" else F.col("max"))).otherwise(graded)
    return out.select(
        *keys, "metric", "n", "min", "max", "mean", "sd", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
        graded.alias("grade"), grade("models", F.col("n").cast("double")).alias("power"),
    )

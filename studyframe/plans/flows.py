"""The stages of a study as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from studyframe.operators import aggregates, cv, diagnose, joins, labels, nested, quality, rank, reports, schema, selection, split as sp
from studyframe.spec import StudySpec

KEYS = ["target", "feature_set", "model"]
# Per task: the score, the leaderboard's columns, verdict, selection weights, and the order of the choice.
STUDY = {
    "regression": {
        "metric": "r2", "columns": ("r2_train", "cv_r2_mean", "cv_r2_std"), "verdict": "reg_train", "weights": "reg",
        "order": (("cv_r2_mean", False), ("cv_r2_std", True), ("abs_train_cv_gap", True)),
    },
    "classification": {
        "metric": "macro_f1", "columns": ("train_macro_f1", "cv_macro_f1", "cv_macro_f1_std", "cv_balanced_accuracy", "cv_accuracy"), "verdict": "cls_train", "weights": "cls_train",
        "order": (("cv_macro_f1", False), ("cv_macro_f1_std", True), ("abs_train_cv_gap", True)),
    },
}
BEST = [("selection_rank", True), ("cv_r2_mean", False), ("cv_r2_std", True), ("model", True)]


def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, gaps, verdict and CV-only rank of all models; the winner of each feature set."""
    from studyframe.plans.fixtures import leaderboard

    table = diagnose.diagnose(diagnose.gaps(leaderboard(spark, sf_dir)), "reg_eval")
    ranked = rank.rank_selection(table, "reg")
    return selection.best_per_feature_set(ranked, BEST).select(
        *KEYS, "selection_rank", "cv_r2_mean", "cv_r2_std", "r2_train", "r2_test", "train_cv_gap", "generalization_diagnosis"
    )


def profile(df: DataFrame, cols: Sequence[str] | None = None, key: str = "row_id") -> dict[str, DataFrame]:
    """Data-quality stage: missing values, duplicates, checks, status and description."""
    cols = list(cols or [c for c in schema.detect_numeric(df) if c != key])
    missing = quality.missing_rate(df, cols)
    checks = quality.constraint_checks(df, cols, key)
    return {
        "missing": missing, "duplicates": quality.duplicate_rows(df, cols), "checks": checks, "status": quality.quality_status(missing, checks),
        "description": quality.describe_table(df, cols),
    }


def prepare(
    df: DataFrame, spec: StudySpec, target: str, feature_set: str, key: str = "row_id", stratify: str | None = "quantile", bins: int = 5, classes: Mapping[str, float] | None = None
) -> DataFrame:
    """Checked, complete rows of one study pair with a leakage-safe ``split`` column."""
    schema.leakage_guard(spec)
    usable = schema.resolve_feature_sets(spec, df.columns, "strict")
    features = [f for t, s, f, _ in usable if t == target and s == feature_set]
    if not features:
        raise ValueError(f"{target}/{feature_set} is not usable")
    y = schema.resolve_columns([target], df.columns)[target]
    rows = schema.complete_cases(df, [y, *features])
    label = None
    if spec.grouped:
        rows = schema.validate_groups(rows, spec.group_column, [key])
        out = sp.split_grouped(rows, spec.group_column, spec.test_ratio, spec.seed)
        if joins.group_overlap(out, spec.group_column).limit(1).count():
            raise ValueError("a group is in both parts of the split")
    elif stratify == "quantile":
        label = "stratum"
        rows = labels.quantile_labels(rows, y, bins, spec.test_ratio, out=label)
        out = sp.split_stratified(rows, key, label, spec.test_ratio, spec.seed)
    elif stratify == "class":
        label = "stratum"
        bounds = labels.resolve_boundaries(rows, y, classes or spec.class_boundaries.get(target), "auto").first()
        rows = labels.class_from_thresholds(rows, y, bounds["lower"], bounds["upper"], label)
        out = sp.split_stratified(rows, key, label, spec.test_ratio, spec.seed)
    else:
        out = sp.split_random(rows, key, spec.test_ratio, spec.seed)
    sp.validate_split(out, (1 - spec.test_ratio, spec.test_ratio), label)
    return out


def folds(df: DataFrame, spec: StudySpec, key: str, k: int, seed: int, out: str = "fold", label: str | None = None) -> DataFrame:
    """Whole groups when the study is grouped and has enough of them, else rows; with a label, of an even class mix."""
    if label is not None:
        parts = sp.stratified_group_kfold(df, spec.group_column, label, k, seed, key) if spec.grouped else sp.stratified_kfold(df, key, label, k, seed=seed).drop("repeat")
        return parts.withColumnRenamed("fold", out)
    if spec.grouped:
        return sp.group_kfold(df, spec.group_column, k, seed=seed, key=key).withColumnRenamed("fold", out)
    return sp.kfold(df, key, k, seed).withColumnRenamed("fold", out)


def train_and_select(
    prepared: Mapping[str, DataFrame], spec: StudySpec, target: str, models: Sequence[str], y: str, key: str = "row_id", task: str = "regression",
    preprocessing: Mapping[str, object] | None = None, n_classes: int | None = None,
) -> tuple[DataFrame, DataFrame, dict[str, PipelineModel]]:
    """Nested CV of every (feature set, model), choice by CV scores, then one look at the holdout.

    ``prepared`` maps feature sets to split tables. Returns leaderboard, holdout scores, fitted models. A
    classification study has folds of an even class mix, and verdicts, weights and columns of its own.
    """
    names = STUDY[task]
    metric, stratify = names["metric"], y if task == "classification" else None
    if stratify and n_classes is None:
        n_classes = max(int(t.agg(F.max(y)).first()[0]) + 1 for t in prepared.values())
    lines, fitted, candidates = [], {}, {}
    tests = {}
    for name, table in prepared.items():
        features = list(spec.targets[target][name])
        train, tests[name] = table.where("split = 'train'"), table.where("split = 'test'")
        for model in models:
            c = cv.Candidate(task, model, features, y, dict(preprocessing or {}), n_classes, spec.seed)
            k = spec.folds_for(model)
            grid = cv.param_grid(spec.grids.get(model), task, spec.seed)
            outer, repeats = train, [f"fold_{r}" for r in range(spec.outer_repeats)]
            for r, column in enumerate(repeats):
                outer = folds(outer, spec, key, k, spec.seed + 1000 * r, column, stratify)
            inner = lambda rows, seed: folds(rows, spec, key, k, seed, "inner_fold", stratify)
            if stratify:  # small classes allow fewer folds
                k = int(outer.agg(F.max("fold_0")).first()[0]) + 1
            scores, _ = nested.nested_cv(outer, c, grid, repeats, k, inner, k, key, spec.group_column if spec.grouped else None, metric)
            best = dict(grid[0])
            if len(grid) > 1:
                best, _ = cv.grid_search_cv(outer, c, grid, "fold_0", k, metric)
            file = f"{model}_{name}_{target}"
            fitted[file], candidates[file] = cv.fit(train, c, best), c
            summary = scores.agg(
                F.avg(f"train_{metric}").alias("t"), F.avg(f"outer_{metric}").alias("m"), F.stddev_samp(f"outer_{metric}").alias("s")
            ).first()
            more = ()
            if stratify:
                more = tuple(scores.agg(F.avg("outer_balanced_accuracy"), F.avg("outer_accuracy")).first())
            lines.append((target, name, model, file, summary["t"], summary["m"], summary["s"], *more))
    spark = next(iter(prepared.values())).sparkSession
    columns = ["target string", "feature_set string", "model string", "file string", *[f"{c} double" for c in names["columns"]]]
    lb = spark.createDataFrame(lines, ", ".join(columns))
    ranked = rank.rank_selection(diagnose.diagnose(diagnose.gaps(lb, task), names["verdict"]), names["weights"])
    held = None
    for name, table in tests.items():
        part = ranked.where(F.col("feature_set") == name)
        scored = cv.select_then_test(part, fitted, table, candidates, names["order"]).withColumn("feature_set", F.lit(name))
        held = scored if held is None else held.unionByName(scored)
    return ranked, held, fitted

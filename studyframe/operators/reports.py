"""Report tables: summaries, final ranking, failures, paper table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from studyframe.functions.columns import join_small, mean_sd_cell
from studyframe.operators import rank as r, sensitivity as s
from studyframe.operators.diagnose import diagnose, gaps

# Names under which the parts of a model summary are looked up, best first.
SUMMARY_COLUMNS = {
    "regression": {
        "metric": "R2",
        "cv_score": ("cv_r2_mean", "nested_cv_r2_mean", "outer_cv_r2", "mean_outer_r2"),
        "cv_sd": ("cv_r2_std", "cv_r2_sd", "nested_cv_r2_std", "outer_cv_r2_std"),
        "test_score": ("r2_test", "test_r2", "Test_R2"),
        "generalization_gap": ("train_cv_gap", "cv_test_gap"),
    },
    "classification": {
        "metric": "Macro-F1",
        "cv_score": ("cv_macro_f1", "cv_macro_f1_mean", "nested_cv_macro_f1", "outer_cv_macro_f1"),
        "cv_sd": ("cv_macro_f1_std", "cv_macro_f1_sd", "nested_cv_macro_f1_std"),
        "test_score": ("test_macro_f1", "macro_f1_test", "Test_Macro_F1"),
        "generalization_gap": ("train_cv_gap", "cv_test_gap", "val_test_gap"),
    },
}


def _first(lb: DataFrame, names: Sequence[str]) -> Column:
    found = next((n for n in names if n in lb.columns), None)
    return F.col(found).cast("double") if found else F.lit(None).cast("double")


def _summary(lb: DataFrame, task: str) -> DataFrame:
    spec = SUMMARY_COLUMNS[task]
    text = lambda names: F.col(next(n for n in names if n in lb.columns)).cast("string") if any(n in lb.columns for n in names) else F.lit("unspecified")
    out = lb.select(
        F.lit(task).alias("task"), text(("target", "Target")).alias("target"), text(("feature_set", "fs", "Feature_Set")).alias("feature_set"),
        text(("model", "Model")).alias("model"), F.lit(spec["metric"]).alias("selection_metric"),
        *[_first(lb, spec[c]).alias(c) for c in ("cv_score", "cv_sd", "test_score", "generalization_gap")],
    )
    order = F.coalesce("cv_score", "test_score").desc_nulls_last()
    place = F.row_number().over(W.partitionBy("target", "feature_set").orderBy(order, "model"))
    return out.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def model_summary(lb_reg: DataFrame | None, lb_cls: DataFrame | None) -> DataFrame:
    """The best model of each task, target and feature set."""
    parts = [_summary(lb, task) for lb, task in ((lb_reg, "regression"), (lb_cls, "classification")) if lb is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def research_summary(sections: Mapping[str, DataFrame], key_columns: Sequence[str] = ("task", "target", "feature_set", "model", "feature", "analysis", "metric")) -> DataFrame:
    """All sections as one long table ``section, key, metric, value, text``."""
    out = None
    for name, frame in sections.items():
        keys = [c for c in key_columns if c in frame.columns]
        lines = []
        for f in frame.schema.fields:
            if f.name in keys:
                continue
            number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
            lines.append(
                F.struct(
                    F.lit(f.name).alias("metric"), (F.col(f.name).cast("double") if number else F.lit(None).cast("double")).alias("value"),
                    (F.lit(None).cast("string") if number else F.col(f.name).cast("string")).alias("text"),
                )
            )
        part = frame.select(F.lit(name).alias("section"), F.concat_ws("/", *keys).alias("key"), F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    return out


def final_ranking(
    lb: DataFrame, scenarios: Mapping[str, Sequence[float]] | None = None, simulations: int = 1000, seed: int = 42, part: Sequence[str] = ("target",),
    key: Sequence[str] = ("feature_set", "model"), task: str = "regression", validation: bool = True,
) -> DataFrame:
    """Leaderboard with gaps, verdict, all rank families, scenario and Monte-Carlo columns.

    Classifiers are ranked with their validation scores; without ``validation`` by cross-validation alone.
    """
    names = [*part, *key]
    if task == "regression":
        verdict, weights, test, general, criteria, usual = "reg_report", "reg", "reg", "reg", s.REG_CRITERIA, s.THREE_SCENARIOS
    elif validation:
        verdict, weights, test, general, criteria, usual = "cls_report", "cls_val", "cls", "cls", s.CLS_VAL_CRITERIA, s.FIVE_SCENARIOS
    else:
        verdict, weights, test, general, criteria, usual = "cls_report", "cls_cv", "cls", "cls_no_val", s.CLS_CRITERIA, s.THREE_SCENARIOS
    scenarios = scenarios or usual
    out = r.rank_selection(diagnose(gaps(lb, task), verdict), weights, part)
    if task == "regression":
        out = r.score_0_1(out, part=part)
    out = r.rank_generalization(r.rank_test(out, test, part), general, part)
    out = r.rank_stability(out, criteria)
    wide = s.scenario_ranks(out, scenarios, criteria, part, key).groupBy(*names).agg(
        *[F.max(F.when(F.col("scenario") == n, F.col("rank"))).alias(f"{n}_rank") for n in scenarios]
    )
    summary = s.scenario_sensitivity(out, scenarios, criteria, part, key)
    out = join_small(join_small(out, wide, names, "left"), summary, names, "left")
    limits = {"perf_idx": (0, 1), "max_single": 0.5} if criteria is s.CLS_VAL_CRITERIA else {}
    out = s.monte_carlo(out, criteria, simulations, seed, part=part, key=key, **limits)
    first = [*names, "recommended_rank", "selection_rank", "test_performance_rank", "generalization_rank", "robustness_rank"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def failures(expected: DataFrame, scored: DataFrame, reasons: DataFrame | None = None, keys: Sequence[str] = ("target", "feature_set", "model")) -> DataFrame:
    """Expected models without scores, with the reason if one is known."""
    missing = expected.select(*keys).distinct().join(scored.select(*keys).distinct(), list(keys), "left_anti")
    if reasons is None:
        return missing.withColumn("reason", F.lit("not scored"))
    return join_small(missing, reasons.select(*keys, "reason"), list(keys), "left").withColumn("reason", F.coalesce("reason", F.lit("not scored")))


def paper_table(lb: DataFrame, digits: int = 3) -> DataFrame:
    """Classifier table with ``mean ± sd`` cells, overall rank and the plain numbers beside them."""
    order = [F.col("val_macro_f1").desc_nulls_last(), F.col("cv_macro_f1").desc_nulls_last(), F.col("cv_macro_f1_std").asc_nulls_last(), F.col("_gap").asc_nulls_last()]
    rows = lb.withColumn("_gap", F.abs(F.col("train_macro_f1") - F.col("cv_macro_f1")))
    tie = [F.col("model"), F.col("feature_set")]
    place = F.row_number().over(W.partitionBy("target").orderBy(*order, *tie)).cast("bigint")
    cell = lambda c: mean_sd_cell(F.col(c), F.lit(None).cast("double"), digits)
    return rows.select(
        place.alias("overall_rank"), "target", "model", "feature_set", mean_sd_cell(F.col("cv_macro_f1"), F.col("cv_macro_f1_std"), digits).alias("cv_cell"),
        cell("train_macro_f1").alias("train_cell"), cell("val_macro_f1").alias("val_cell"), cell("test_macro_f1").alias("test_cell"), "cv_macro_f1", "cv_macro_f1_std",
        "val_macro_f1", "test_macro_f1",
    )

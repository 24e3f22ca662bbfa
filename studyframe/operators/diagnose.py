"""Generalization gaps and the rule-based verdict on each model of a leaderboard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Profile:
    """Thresholds and wording of one verdict."""

    train: str
    cv: str
    sd: str
    low_train: float
    low_cv: float
    gap: float
    unstable: float
    stable_gap: float
    stable_cv: float
    shift: float | None = None
    shift_against: str | None = None
    shift_label: str = ""
    low_other: tuple[str, float] | None = None
    neutral: bool = False


# Thresholds of the published verdicts.
PROFILES = {
    "reg_train": Profile("r2_train", "cv_r2_mean", "cv_r2_std", 0.40, 0.40, 0.20, 0.20, 0.10, 0.40, neutral=True),
    "reg_eval": Profile("r2_train", "cv_r2_mean", "cv_r2_std", 0.40, 0.40, 0.20, 0.20, 0.10, 0.40, 0.20, "r2_test", "Holdout-sensitive"),
    "reg_report": Profile("r2_train", "cv_r2_mean", "cv_r2_std", 0.40, 0.40, 0.20, 0.20, 0.10, 0.40, 0.20, "r2_test", "CV-test shift"),
    "cls_train": Profile("train_macro_f1", "cv_macro_f1", "cv_macro_f1_std", 0.55, 0.50, 0.10, 0.15, 0.05, 0.50, neutral=True),
    "cls_eval": Profile(
        "train_macro_f1", "cv_macro_f1", "cv_macro_f1_std", 0.55, 0.50, 0.15, 0.15, 0.08, 0.50, 0.15, "val_macro_f1",
        "Split-sensitive", ("val_macro_f1", 0.50),
    ),
    "cls_report": Profile(
        "train_macro_f1", "cv_macro_f1", "cv_macro_f1_std", 0.55, 0.50, 0.15, 0.15, 0.08, 0.50, 0.15, "test_macro_f1", "CV-test shift"
    ),
}

# Wording of the verdicts, in the order they are tried.
PLAIN_LABELS = (
    "Possible underfitting",
    "Overfitting with high CV instability",
    "Possible overfitting",
    "High CV instability",
    "Stable generalization",
    "Moderate generalization",
)
NEUTRAL_LABELS = (
    "Low train and grouped-CV performance",
    "Large train-CV generalization gap with high between-group variability",
    "Large train-CV generalization gap",
    "High between-group CV variability",
    "Stable grouped generalization",
    "Moderate grouped generalization",
)


def gaps(lb: DataFrame, task: str = "regression") -> DataFrame:
    """Differences between train, CV, validation and test scores, and their absolute values."""
    if task == "regression":
        train, cv, val, test = "r2_train", "cv_r2_mean", None, "r2_test"
    else:
        train, cv, val, test = "train_macro_f1", "cv_macro_f1", "val_macro_f1", "test_macro_f1"
    col = lambda name: F.col(name) if name and name in lb.columns else F.lit(None).cast("double")
    out = lb.withColumn("train_cv_gap", col(train) - col(cv)).withColumn("cv_test_gap", col(cv) - col(test))
    names = ["train_cv_gap", "cv_test_gap"]
    if val:
        out = out.withColumn("train_val_gap", col(train) - col(val))
        out = out.withColumn("cv_val_gap", col(cv) - col(val)).withColumn("val_test_gap", col(val) - col(test))
        names += ["train_val_gap", "cv_val_gap", "val_test_gap"]
    return out.withColumns({f"abs_{n}": F.abs(n) for n in names})


def _no(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def diagnose(lb: DataFrame, profile: str) -> DataFrame:
    """Flags and one verdict per model; the first rule that holds decides."""
    p = PROFILES[profile]
    have = lambda name: F.col(name) if name in lb.columns else F.lit(None).cast("double")
    train, cv, sd = have(p.train), have(p.cv), have(p.sd)
    gap = train - cv
    low = _no((train < p.low_train) & (cv < p.low_cv))
    if p.low_other:
        low = low & _no(have(p.low_other[0]) < p.low_other[1])
    large = _no(gap >= p.gap)
    unstable = _no(sd >= p.unstable)
    steady = ~unstable if p.cv.startswith("cv_r2") else _no(sd < p.unstable)
    stable = _no((F.abs(gap) <= p.stable_gap) & (cv >= p.stable_cv)) & steady
    shift = _no(F.abs(cv - have(p.shift_against)) >= p.shift) if p.shift is not None else F.lit(False)
    words = NEUTRAL_LABELS if p.neutral else PLAIN_LABELS
    verdict = (
        F.when(low, words[0])
        .when(large & unstable, words[1])
        .when(large, words[2])
        .when(unstable, words[3])
        .when(shift, p.shift_label)
        .when(stable, words[4])
        .otherwise(words[5])
    )
    return lb.withColumns(
        {
            "possible_underfitting": low,
            "possible_overfitting": large,
            "high_cv_instability": unstable,
            "split_shift": shift,
            "stable_generalization": stable,
            "generalization_diagnosis": verdict,
        }
    )


def diagnose_multi(lb: DataFrame) -> DataFrame:
    """All warnings that apply to a classifier, joined by ``; ``."""
    train, cv, sd, val = (F.col(c) for c in ("train_macro_f1", "cv_macro_f1", "cv_macro_f1_std", "val_macro_f1"))
    found = F.concat_ws(
        "; ",
        F.when(train - cv >= 0.10, "possible overfitting"),
        F.when((train < 0.55) & (cv < 0.50), "possible underfitting"),
        F.when(sd >= 0.15, "high CV instability"),
        F.when(F.abs(cv - val) >= 0.15, "split sensitivity"),
    )
    return lb.withColumn("screening", F.when(found == "", "acceptable generalization").otherwise(found))


def over_underfitting(lb: DataFrame, profile: str, part: list[str] | None = None) -> DataFrame:
    """How many models of each feature set carry each flag."""
    flags = ["possible_underfitting", "possible_overfitting", "high_cv_instability", "split_shift", "stable_generalization"]
    out = diagnose(lb, profile).groupBy(*(part or ["target", "feature_set"]))
    return out.agg(F.count(F.lit(1)).alias("models"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])

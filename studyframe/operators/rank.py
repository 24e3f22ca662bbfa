"""Ranks over a leaderboard: selection, test, generalization, stability, pairwise families."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from studyframe.operators.ranking import _part, rank_average, rank_min

# Fixed values: (criterion rank, source column, ascending, weight) of every selection profile.
SELECTION = {
    "reg": (
        ("rank_cv_r2", "cv_r2_mean", False, 0.60),
        ("rank_cv_stability", "cv_r2_std", True, 0.20),
        ("rank_train_cv_gap", "abs_train_cv_gap", True, 0.20),
    ),
    "cls_cv": (
        ("rank_cv_macro_f1", "cv_macro_f1", False, 0.60),
        ("rank_cv_stability", "cv_macro_f1_std", True, 0.20),
        ("rank_train_cv_gap", "abs_train_cv_gap", True, 0.20),
    ),
    "cls_cv_mcc": (
        ("rank_cv_macro_f1", "cv_macro_f1", False, 0.45),
        ("rank_cv_mcc", "cv_mcc", False, 0.20),
        ("rank_cv_stability", "cv_macro_f1_std", True, 0.15),
        ("rank_train_cv_gap", "abs_train_cv_gap", True, 0.20),
    ),
    "cls_val": (
        ("rank_cv_macro_f1", "cv_macro_f1", False, 0.40),
        ("rank_val_macro_f1", "val_macro_f1", False, 0.25),
        ("rank_cv_stability", "cv_macro_f1_std", True, 0.15),
        ("rank_train_cv_gap", "abs_train_cv_gap", True, 0.15),
        ("rank_val_balanced_error", "val_balanced_error", True, 0.05),
    ),
    "cls_train": (
        ("rank_cv_macro_f1", "cv_macro_f1", False, 0.40),
        ("rank_cv_balanced_accuracy", "cv_balanced_accuracy", False, 0.20),
        ("rank_cv_accuracy", "cv_accuracy", False, 0.10),
        ("rank_cv_stability", "cv_macro_f1_std", True, 0.15),
        ("rank_train_cv_gap", "abs_train_cv_gap", True, 0.15),
    ),
}
# Descriptive test ranks and generalization ranks.
TEST = {
    "reg": (("r2_test", False, 0.50), ("rmse_test", True, 0.30), ("mae_test", True, 0.20)),
    "cls": (("test_macro_f1", False, 0.50), ("test_balanced_accuracy", False, 0.30), ("test_mcc", False, 0.20)),
    "cls_train": (("test_macro_f1", False, 0.70), ("test_balanced_accuracy", False, 0.30)),
}
GENERALIZATION = {
    "reg": (("abs_train_cv_gap", True, 0.60), ("cv_r2_std", True, 0.40)),
    "cls": (("abs_train_cv_gap", True, 0.45), ("cv_macro_f1_std", True, 0.35), ("abs_cv_val_gap", True, 0.20)),
    "cls_no_val": (("abs_train_cv_gap", True, 0.60), ("cv_macro_f1_std", True, 0.40)),
}
HIGHER = ("r2_test", "p20_test", "ioa_test", "ios_test")
LOWER = ("mae_test", "rmse_test", "mse_test")
# Models compared at once inside one task.
BLOCK = 4_000


def _weighted(terms: Sequence[tuple], tie_mode: str):
    total = None
    for weight, column in terms:
        term = F.lit(float(weight)) * column
        total = term if total is None else total + term
    return total if tie_mode == "raw" else F.round(total, 9)


def _fill(lb: DataFrame, names: Sequence[str]) -> DataFrame:
    return lb.withColumns({n: F.lit(None).cast("double") for n in names if n not in lb.columns}) if names else lb


def rank_selection(lb: DataFrame, profile: str = "reg", part: Sequence[str] = ("target",), tie_mode: str = "round9") -> DataFrame:
    """Weighted sum of criterion ranks and its min-rank. Test scores take no part."""
    criteria = SELECTION[profile]
    method = rank_average
    lb = _fill(lb, [source for _, source, _, _ in criteria])
    lb = lb.withColumns({name: method(source, up, part) for name, source, up, _ in criteria})
    lb = lb.withColumn("selection_rank_score", _weighted([(w, F.col(name)) for name, _, _, w in criteria], tie_mode))
    return lb.withColumn("selection_rank", rank_min("selection_rank_score", True, part))


def rank_selection_min(lb: DataFrame, part: Sequence[str] = ("target",)) -> DataFrame:
    """Regression variant in which tied criteria share the smallest rank."""
    criteria = SELECTION["reg"]
    lb = lb.withColumns({name: rank_min(source, up, part) for name, source, up, _ in criteria})
    lb = lb.withColumn("selection_rank_score", _weighted([(w, F.col(name)) for name, _, _, w in criteria], "round9"))
    return lb.withColumn("selection_rank", rank_min("selection_rank_score", True, part))


def rank_test(lb: DataFrame, profile: str = "reg", part: Sequence[str] = ("target",), tie_mode: str = "round9") -> DataFrame:
    """Descriptive test rank; NULL for all models when none has a test score."""
    terms = TEST[profile]
    main = terms[0][0]
    lb = _fill(lb, [name for name, _, _ in terms])
    known = F.count(main).over(_part(part)) > 0
    score = _weighted([(w, rank_average(name, up, part)) for name, up, w in terms], tie_mode)
    lb = lb.withColumn("test_rank_score", F.when(known, score))
    return lb.withColumn("test_performance_rank", rank_min("test_rank_score", True, part))


def rank_generalization(lb: DataFrame, profile: str = "reg", part: Sequence[str] = ("target",), tie_mode: str = "round9") -> DataFrame:
    terms = GENERALIZATION[profile]
    lb = _fill(lb, [name for name, _, _ in terms])
    lb = lb.withColumn(
        "generalization_rank_score", _weighted([(w, rank_average(name, up, part)) for name, up, w in terms], tie_mode)
    )
    return lb.withColumn("generalization_rank", rank_min("generalization_rank_score", True, part))


def rank_stability(lb: DataFrame, rank_cols: Sequence[str], out: str = "rank_stability") -> DataFrame:
    """1 / (1 + population sd / mean) of a model's own criterion ranks; 1 when they agree."""
    ranks = F.filter(F.array(*[F.col(c).cast("double") for c in rank_cols]), lambda v: v.isNotNull())
    n = F.size("_ranks")
    mean = F.aggregate("_ranks", F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate("_ranks", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))) / n
    sd = F.sqrt(squares)
    value = F.when(sd == 0, 1.0).otherwise(1.0 / (1.0 + sd / F.col("_mean")))
    return lb.withColumn("_ranks", ranks).withColumn("_mean", mean).withColumn(out, value).drop("_ranks", "_mean")


def score_0_1(lb: DataFrame, score: str = "selection_rank_score", part: Sequence[str] = ("target",), out: str = "statistical_score") -> DataFrame:
    """Selection score turned to 0..1, best = 1; 1 when all are equal."""
    low, high = F.min(score).over(_part(part)), F.max(score).over(_part(part))
    return lb.withColumn(out, F.when(low == high, 1.0).otherwise(1.0 - (F.col(score) - low) / (high - low)))


# ------------------------------------------------------------------ comparisons of model pairs


def _block_count(lb: DataFrame, part: Sequence[str]) -> int:
    row = lb.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return max(1, math.ceil((row["n"] or 0) / BLOCK))


def pair_counts(
    lb: DataFrame, higher: Sequence[str], lower: Sequence[str], part: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """For each model: how many others dominate it, how many it beats on most metrics, wins, losses.

    Pairs are never written out. Each part is cut into blocks of at most ``BLOCK`` models; a task
    compares one block with another in memory and returns one line per model, which are then added up.
    """
    part, key = list(part), list(key)
    metrics = [*higher, *lower]
    table = lb.select(*part, *key, *[F.col(m).cast("double") for m in metrics])
    blocks = _block_count(table, part)
    mine = F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = table.withColumn("_a", mine).withColumn("_b", others)
    # ``toDF`` gives the second side its own column identities.
    right = table.withColumn("_b", mine).withColumn("_a", others)
    right = right.toDF(*right.columns)
    sign = np.array([1.0] * len(higher) + [-1.0] * len(lower))
    schema = T.StructType(
        [table.schema[c] for c in (*part, *key)]
        + [T.StructField(c, T.LongType()) for c in ("_dominators", "_majority", "_wins", "_losses")]
    )

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, z = a[metrics].to_numpy(dtype=float) * sign, b[metrics].to_numpy(dtype=float) * sign
        wins = np.zeros((len(a), len(b)), dtype=np.int16)
        losses = np.zeros_like(wins)
        weak = np.ones((len(a), len(b)), dtype=bool)
        for m in range(len(metrics)):
            one, two = x[:, m][:, None], z[:, m][None, :]
            wins += one > two
            losses += one < two
            weak &= two >= one
        out = a[[*part, *key]].copy()
        out["_dominators"] = (weak & (losses > 0)).sum(axis=1)
        out["_majority"] = (wins * 2 > len(metrics)).sum(axis=1)
        out["_wins"] = wins.sum(axis=1, dtype=np.int64)
        out["_losses"] = losses.sum(axis=1, dtype=np.int64)
        return out

    group = [*part, "_a", "_b"]
    partial = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(compare, schema)
    return partial.groupBy(*part, *key).agg(
        F.sum("_dominators").alias("dominators"),
        F.sum("_majority").alias("majority_wins"),
        F.sum("_wins").alias("wins"),
        F.sum("_losses").alias("losses"),
    )


def pareto_rank(lb, higher=HIGHER, lower=LOWER, part=("target",), key=("feature_set", "model"), counts: DataFrame | None = None) -> DataFrame:
    """Rank of 1 / (1 + number of models that are nowhere worse and somewhere better)."""
    counts = pair_counts(lb, higher, lower, part, key) if counts is None else counts
    out = counts.withColumn("pareto_score", 1.0 / (1 + F.col("dominators")))
    out = out.withColumn("pareto_rank", rank_min("dominators", True, part))
    return out.select(*part, *key, "dominators", "pareto_score", "pareto_rank")


def dominance_rank(lb, higher=HIGHER, lower=LOWER, part=("target",), key=("feature_set", "model"), counts: DataFrame | None = None) -> DataFrame:
    """Rank by the number of models beaten on more than half of the metrics."""
    counts = pair_counts(lb, higher, lower, part, key) if counts is None else counts
    out = counts.withColumn("dominance_rank", rank_min("majority_wins", False, part))
    return out.select(*part, *key, "majority_wins", "dominance_rank")


def dirichlet_rank(lb, higher=HIGHER, lower=LOWER, part=("target",), key=("feature_set", "model"), counts: DataFrame | None = None) -> DataFrame:
    """Rank by the expected share under a Dirichlet whose weights move with wins minus losses."""
    counts = pair_counts(lb, higher, lower, part, key) if counts is None else counts
    metrics = len(higher) + len(lower)
    alpha = F.greatest(F.lit(0.1), 1.0 + (F.col("wins") - F.col("losses")) / F.lit(float(metrics)))
    out = counts.withColumn("alpha", alpha)
    out = out.withColumn("dirichlet_score", F.col("alpha") / F.sum("alpha").over(_part(part)))
    out = out.withColumn("dirichlet_rank", rank_min("alpha", False, part))
    return out.select(*part, *key, "alpha", "dirichlet_score", "dirichlet_rank")


def rank_ensemble(lb: DataFrame, higher=HIGHER, lower=LOWER, part=("target",), key=("feature_set", "model"), score: str = "statistical_score") -> DataFrame:
    """Mean of the score, Pareto, dominance and Dirichlet ranks, 10 % trimmed at both ends, ranked."""
    counts = pair_counts(lb, higher, lower, part, key)
    names = [*part, *key]
    four = ["score_rank", "pareto_rank", "dominance_rank", "dirichlet_rank"]
    out = lb.select(*names, rank_min(score, False, part).alias("score_rank"))
    for frame in (pareto_rank(lb, higher, lower, part, key, counts), dominance_rank(lb, higher, lower, part, key, counts),
                  dirichlet_rank(lb, higher, lower, part, key, counts)):
        out = out.join(frame.select(*names, frame.columns[-1]), names)
    trim = int(0.1 * len(four))
    kept = F.slice(F.array_sort(F.array(*[F.col(c).cast("double") for c in four])), trim + 1, len(four) - 2 * trim)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.lit(float(len(four) - 2 * trim))
    out = out.withColumn("ensemble_score", mean)
    return rank_stability(out.withColumn("ensemble_rank", rank_min("ensemble_score", True, part)), four)

"""Column resolution, coercion, row filters and canonical report columns."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from studyframe.functions.columns import as_double, field_type, name_key
from studyframe.spec import StudySpec


def column_facts(df: DataFrame, facts: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One aggregation over many columns, returned as one line per column."""
    names = list(facts)
    row = df.agg(
        *[F.struct(F.lit(n).alias("column"), *[e.alias(k) for k, e in facts[n].items()]).alias(f"_{i}") for i, n in enumerate(names)]
    )
    return row.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(names))])))


def _num(df: DataFrame, name: str) -> Column:
    return as_double(F.col(f"`{name}`"), field_type(df, name))


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as doubles; text that is no number, NaN and the infinities become NULL."""
    return df.withColumns({c: _num(df, c) for c in cols})


def numeric_ratio(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null values that are numbers: ``column, n_nonnull, n_numeric, ratio``."""
    cols = list(cols or df.columns)
    out = column_facts(
        df, {c: {"n_nonnull": F.count(F.col(f"`{c}`")), "n_numeric": F.count(_num(df, c))} for c in cols}
    )
    return out.withColumn("ratio", F.when(F.col("n_nonnull") > 0, F.col("n_numeric") / F.col("n_nonnull")).otherwise(0.0))


def check_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    """Error when a column holds no number at all, warning when more than half cannot be read."""
    for row in numeric_ratio(df, cols).collect():
        if row["n_nonnull"] and row["n_numeric"] == 0:
            raise ValueError(f"column {row['column']} holds no numeric value")
        if row["n_nonnull"] and row["ratio"] < 0.5:
            warnings.warn(f"more than half of {row['column']} cannot be read as numbers")


def detect_numeric(df: DataFrame, min_ratio: float = 0.90) -> list[str]:
    """Numeric columns, and text columns of which at least ``min_ratio`` can be read as numbers."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if text:
        numeric |= {r["column"] for r in numeric_ratio(df, text).where(F.col("ratio") >= min_ratio).collect()}
    return [c for c in df.columns if c in numeric]


def resolve_columns(wanted: Sequence[str], available: Sequence[str]) -> dict[str, str | None]:
    """Match names: case-insensitive first, then ignoring everything but letters and digits.

    A name that fits several columns is left unresolved with a warning.
    """
    found: dict[str, str | None] = {}
    for name in wanted:
        hits = [c for c in available if c.strip().casefold() == name.strip().casefold()]
        if not hits:
            hits = [c for c in available if name_key(c) == name_key(name)]
        if len(hits) > 1 and name in hits:
            hits = [name]
        if len(hits) > 1:
            warnings.warn(f"{name} fits several columns: {hits}")
        found[name] = hits[0] if len(hits) == 1 else None
    return found


def resolve_feature_sets(spec: StudySpec, columns: Sequence[str], policy: str = "strict") -> list[tuple[str, str, str, int]]:
    """Usable (target, feature_set, feature, ordinal) rows.

    ``strict`` drops a set with any missing column; ``lenient`` keeps the columns that exist.
    """
    usable = []
    for target, sets in spec.targets.items():
        if resolve_columns([target], columns)[target] is None:
            warnings.warn(f"target {target} is not in the table")
            continue
        for name, features in sets.items():
            match = resolve_columns(features, columns)
            have = [match[f] for f in features if match[f] is not None]
            missing = [f for f in features if match[f] is None]
            if missing and policy == "strict":
                warnings.warn(f"{target}/{name} is left out, missing: {missing}")
                continue
            usable += [(target, name, f, i) for i, f in enumerate(dict.fromkeys(have))]
    if not usable:
        raise ValueError("no usable feature set")
    return usable


def leakage_guard(spec: StudySpec) -> None:
    """Error when a target is one of its own features."""
    bad = [f"{t}/{s}" for t, sets in spec.targets.items() for s, fs in sets.items() if name_key(t) in {name_key(f) for f in fs}]
    if bad:
        raise ValueError(f"target used as its own feature: {bad}")


def derive_difference(df: DataFrame, name: str, minuend: str, subtrahend: str) -> DataFrame:
    """Add ``name = minuend - subtrahend`` unless the column exists or an input is absent."""
    if name in df.columns or minuend not in df.columns or subtrahend not in df.columns:
        return df
    return df.withColumn(name, _num(df, minuend) - _num(df, subtrahend))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Infinities become NULL, then rows without any value are dropped."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return to_double(df, floats).na.drop("all")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a number in every one of ``cols``."""
    return to_double(df, cols).na.drop(subset=list(cols))


def bad_group(column: Column) -> Column:
    text = F.lower(F.trim(column.cast("string")))
    return column.isNull() | text.isin("", "nan", "none", "null")


def invalid_groups(df: DataFrame, group_col: str, keys: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """The first rows (by ``keys``) whose group is blank or a word for missing."""
    bad = df.where(bad_group(F.col(group_col))).select(*keys, group_col)
    return bad.orderBy(*keys).limit(limit) if keys else bad.limit(limit)


def validate_groups(df: DataFrame, group_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Trimmed group keys; error that lists up to 20 rows without a usable group."""
    bad = invalid_groups(df, group_col, keys).collect()
    if bad:
        raise ValueError(f"{len(bad)} or more rows without a group in {group_col}: {[tuple(r) for r in bad]}")
    return df.withColumn(group_col, F.trim(F.col(group_col).cast("string")))


# ------------------------------------------------------------------ leaderboards and importances


def drop_alias_models(lb: DataFrame) -> DataFrame:
    """Leave out the copies named "best" of models that are listed under their own name."""
    keep = F.lit(True)
    for name in ("model", "feature_set"):
        if name in lb.columns:
            keep = keep & ~F.coalesce(F.lower(F.col(name)).contains("best"), F.lit(False))
    if "file" in lb.columns:
        base = F.lower(F.element_at(F.split("file", "[/\\\\]"), -1))
        keep = keep & ~F.coalesce(base.startswith("best"), F.lit(False))
    return lb.where(keep)


# Canonical leaderboard columns and the other names they go by.
ALIASES = {
    "regression": {
        "r2_train": ["r2_train", "train_r2"],
        "cv_r2_mean": ["cv_r2_mean", "nested_cv_r2_mean", "outer_cv_r2", "mean_outer_r2"],
        "cv_r2_std": ["cv_r2_std", "cv_r2_sd", "nested_cv_r2_std", "outer_cv_r2_std"],
        "r2_test": ["r2_test", "test_r2", "Test_R2"],
        "mae_test": ["mae_test", "test_mae"],
        "rmse_test": ["rmse_test", "test_rmse"],
    },
    "classification": {
        "train_macro_f1": ["train_macro_f1", "macro_f1_train"],
        "cv_macro_f1": ["cv_macro_f1", "cv_train_macro_f1", "cv_macro_f1_mean"],
        "cv_macro_f1_std": ["cv_macro_f1_std", "cv_train_macro_f1_std", "cv_macro_f1_sd"],
        "val_macro_f1": ["val_macro_f1", "macro_f1_val"],
        "test_macro_f1": ["test_macro_f1", "macro_f1_test"],
        "train_balanced_accuracy": ["train_balanced_accuracy", "balanced_accuracy_train"],
        "val_balanced_accuracy": ["val_balanced_accuracy", "balanced_accuracy_val"],
        "test_balanced_accuracy": ["test_balanced_accuracy", "balanced_accuracy_test"],
        "train_accuracy": ["train_accuracy", "accuracy_train"],
        "val_accuracy": ["val_accuracy", "accuracy_val"],
        "test_accuracy": ["test_accuracy", "accuracy_test"],
        "train_mcc": ["train_mcc", "mcc_train"],
        "val_mcc": ["val_mcc", "mcc_val"],
        "test_mcc": ["test_mcc", "mcc_test"],
        "val_log_loss": ["val_log_loss", "log_loss_val"],
        "test_log_loss": ["test_log_loss", "log_loss_test"],
    },
}


def normalize_leaderboard(lb: DataFrame, task: str) -> DataFrame:
    """Canonical score columns as doubles (NULL when absent), ``feature_set`` and a default target."""
    if "feature_set" not in lb.columns and "fs" in lb.columns:
        lb = lb.withColumn("feature_set", F.col("fs"))
    if "model" not in lb.columns or "feature_set" not in lb.columns:
        raise ValueError("a leaderboard needs the columns model and feature_set (or fs)")
    if "target" not in lb.columns:
        lb = lb.withColumn("target", F.lit("unspecified_target"))
    new = {}
    for name, aliases in ALIASES[task].items():
        present = next((a for a in aliases if a in lb.columns), None)
        new[name] = _num(lb, present) if present else F.lit(None).cast("double")
    out = lb.withColumns(new)
    if task == "classification":
        out = out.withColumn("val_balanced_error", 1.0 - F.col("val_balanced_accuracy"))
        out = out.withColumn("test_balanced_error", 1.0 - F.col("test_balanced_accuracy"))
    return out


# Names under which the columns of an importance table may be stored, best first.
IMPORTANCE_COLUMNS = {
    "feature": ["feature", "features", "feature_name", "variable", "predictor", "input_feature", "column"],
    "mean_importance": [
        "mean_importance", "importance_mean", "mean_permutation_importance", "permutation_importance_mean", "mean_importance_score",
        "permutation_importance", "importance", "sensitivity", "mean_decrease", "score", "mean_score",
    ],
    "importance_std": [
        "importance_std", "std", "sd", "importance_sd", "importance_stddev", "std_importance", "permutation_importance_std", "standard_deviation",
    ],
    "relative_contribution_pct": [
        "relative_contribution_pct", "relative_importance", "relative_contribution", "relative_contribution_percent",
        "relative_contribution_percentage", "relative_importance_percent", "contribution_pct", "contribution_percent",
    ],
}


def normalize_importances(df: DataFrame, source: Sequence[str] = ("file",)) -> DataFrame:
    """snake_case names and the columns of IMPORTANCE_COLUMNS, whatever each source file calls them.

    ``importance_pct`` scales a file of fractions to percent, as does ``relative_contribution_pct`` where a file
    has it; elsewhere that is the share of the positive importances of the file, or of the absolute ones if none
    is positive. ``importance_rank_within_model`` is dense, the largest first; rows without a number have none.
    """
    import re

    from studyframe.operators.aggregates import contribution

    def snake(name: str) -> str:
        return re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip()).lower()).strip("_")

    out = df.toDF(*[snake(c) for c in df.columns])
    source = [snake(c) for c in source]
    have = {name: [a for a in aliases if a in out.columns and a not in source] for name, aliases in IMPORTANCE_COLUMNS.items()}
    if not have["mean_importance"]:
        raise ValueError("no importance column")
    if not have["feature"]:
        raise ValueError("no feature column")
    # Files differ, and a row has a value under the names of its own file only.
    number = lambda name: F.coalesce(*[_num(out, a) for a in have[name]], F.lit(None).cast("double"))
    out = out.withColumns({"feature": F.coalesce(*[F.col(a) for a in have["feature"]]), **{c: number(c) for c in IMPORTANCE_COLUMNS if c != "feature"}})
    file, value, share = W.partitionBy(*source), F.col("mean_importance"), F.col("relative_contribution_pct")
    percent = lambda c: F.when(F.max(F.abs(c)).over(file) <= 1.0, c * 100.0).otherwise(c)
    rank = F.dense_rank().over(file.orderBy(value.desc_nulls_last()))
    return out.withColumns(
        {
            "importance_pct": percent(value),
            "relative_contribution_pct": F.when(F.max(share).over(file).isNull(), contribution(value, source)).otherwise(percent(share)),
            "importance_rank_within_model": F.when(value.isNotNull(), rank).cast("long"),
        }
    )


def flatten_results(df: DataFrame, parts: Sequence[str] = ("validation", "test"), prefixes: Sequence[str] = ("val_", "test_")) -> DataFrame:
    """Struct columns of scores turned into prefixed flat columns."""
    flat: list[Column] = [F.col(f"`{c}`") for c in df.columns if c not in parts]
    for part, prefix in zip(parts, prefixes):
        if part in df.columns:
            flat += [F.col(f"{part}.{name}").alias(prefix + name) for name in df.schema[part].dataType.names]
    return df.select(*flat)

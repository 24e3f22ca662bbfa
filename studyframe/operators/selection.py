"""Top-k, best-of and set operations on report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.operators.schema import drop_alias_models


def _order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]


def top_correlations(corr: DataFrame, target: str, k: int | None = None) -> DataFrame:
    """Correlations with the target, strongest first, from a long (a, b, r) matrix."""
    rows = corr.where((F.col("a") == target) & (F.col("b") != target)).select(F.col("b").alias("feature"), "r", F.abs("r").alias("abs_r"))
    rows = rows.orderBy(F.col("abs_r").desc_nulls_last(), "feature")
    return rows.limit(k) if k else rows


def top_features(imp: DataFrame, k: int = 5, part: Sequence[str] = ("target", "feature_set", "model"), value: str = "mean_importance") -> DataFrame:
    """The k features of the largest absolute importance per model."""
    w = W.partitionBy(*part).orderBy(F.abs(value).desc_nulls_last(), F.col("feature"))
    return imp.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def best_per_feature_set(
    lb: DataFrame, order: Sequence[tuple[str, bool]], keys: Sequence[str] = ("target", "feature_set")
) -> DataFrame:
    """First model per key in the given order of (column, ascending)."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*_order(order)))
    return lb.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def best_overall(lb: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    return lb.orderBy(*_order(order)).limit(1)


def pick_model(lb: DataFrame, artifacts: DataFrame, rank: str = "selection_rank", named: Sequence[str] = ("best_overall", "best")) -> DataFrame:
    """File to score with: a named best model if it is stored, else the best ranked stored model.

    ``artifacts`` has a ``file`` column; one row ``file, rank`` is returned.
    """
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    preferred = artifacts.select("file", F.array_position(F.array(*[F.lit(n) for n in named]), stem).alias("_p"))
    preferred = preferred.where(F.col("_p") > 0).select("file", F.lit(None).cast("bigint").alias("rank"), F.col("_p").alias("_order"))
    stored = drop_alias_models(lb).join(artifacts.select("file").distinct(), "file", "left_semi")
    ranked = stored.select("file", F.col(rank).cast("bigint").alias("rank"), (F.col(rank) + len(named)).cast("bigint").alias("_order"))
    return preferred.unionByName(ranked).orderBy("_order", "file").limit(1).drop("_order")


def natural_order(column: Column | str) -> list[Column]:
    """Sort keys that put fs2 before fs10."""
    column = F.col(column) if isinstance(column, str) else column
    digits = F.regexp_extract(column, r"([0-9]+)$", 1)
    return [F.lower(F.regexp_replace(column, r"[0-9]+$", "")), F.when(digits != "", digits.cast("bigint")).asc_nulls_first(), column]


def natural_sort(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(*natural_order(col))


def union_reports(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables; columns that a table lacks are filled with NULL."""
    out = dfs[0]
    for other in dfs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def distinct_selected(df: DataFrame, keys: Sequence[str] = ("file", "scope")) -> DataFrame:
    return df.dropDuplicates(list(keys))


def feature_union(spec_df: DataFrame) -> DataFrame:
    """All feature names once, in the order of their first appearance."""
    firsts = spec_df.groupBy("feature").agg(F.min(F.struct("target", "feature_set", "ordinal")).alias("_first"))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_first", "feature"))
    return firsts.select("feature", place.cast("bigint").alias("position"))


def upsert_manifest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all rows of ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)

"""Attaching tables to one another, and checks on split membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from studyframe.functions.columns import join_small


def attach_metadata(df: DataFrame, meta: DataFrame, key: str | Sequence[str] = "row_id") -> DataFrame:
    """One metadata row per key beside each row; error when the metadata repeats a key."""
    keys = [key] if isinstance(key, str) else list(key)
    repeated = meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"metadata repeats a key: {repeated[0]}")
    return df.join(meta, keys, "left")


def attach_rank(results: DataFrame, ranking: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks of the leaderboard beside result rows."""
    return join_small(results, ranking, list(keys), "left")


def attach_split(df: DataFrame, split: DataFrame, key: str | Sequence[str], by_group: bool = False) -> DataFrame:
    """Split or fold labels beside rows: by row identity, or by group when groups are few."""
    keys = [key] if isinstance(key, str) else list(key)
    return join_small(df, split, keys, "inner") if by_group else df.join(split, keys, "inner")


def group_overlap(split: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """Groups found in more than one part; must be empty."""
    parts = split.groupBy(group_col).agg(F.min(split_col).alias("_a"), F.max(split_col).alias("_b"))
    return parts.where(F.col("_a") != F.col("_b")).select(F.col(group_col).alias("group"))


def split_coverage(all_rows: DataFrame, split: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that are in no part, in several parts, or not in the table; must be empty."""
    both = all_rows.select(key, F.lit(1).alias("_t"), F.lit(0).alias("_s")).unionByName(
        split.select(key, F.lit(0).alias("_t"), F.lit(1).alias("_s"))
    )
    seen = both.groupBy(key).agg(F.sum("_t").alias("_t"), F.sum("_s").alias("_s"))
    problem = F.when(F.col("_t") == 0, "unknown row").when(F.col("_s") == 0, "in no part").when(F.col("_s") > 1, "in several parts")
    return seen.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(key, "problem")


def intersect_groups(a: DataFrame, b: DataFrame, group_col: str) -> DataFrame:
    return a.select(group_col).intersect(b.select(group_col))

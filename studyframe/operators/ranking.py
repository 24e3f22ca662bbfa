"""Rank expressions for result tables (one row per model) and ordered helpers.

These are window expressions: use them on tables whose partitions are bounded by the number of models
in a study. Row-level ranks of unbounded data go through ``functions.running`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _part(part: Sequence[str]):
    return W.partitionBy(*part) if part else W.partitionBy(F.lit(0))


def _ordered(value: Column, ascending: bool) -> Column:
    return value.asc_nulls_last() if ascending else value.desc_nulls_last()


def rank_average(value: Column | str, ascending: bool = True, part: Sequence[str] = ()) -> Column:
    """Average rank of ties; missing values share the last ranks."""
    value = _col(value)
    first = F.rank().over(_part(part).orderBy(_ordered(value, ascending)))
    ties = F.count(F.lit(1)).over(W.partitionBy(*(list(part) or [F.lit(0)]), value))
    return first + (ties - 1) / F.lit(2.0)


def rank_min(value: Column | str, ascending: bool = True, part: Sequence[str] = ()) -> Column:
    """Competition rank; missing values get no rank."""
    value = _col(value)
    first = F.rank().over(_part(part).orderBy(_ordered(value, ascending)))
    return F.when(value.isNotNull(), first.cast("bigint"))


def rank_dense(value: Column | str, ascending: bool = False, part: Sequence[str] = ()) -> Column:
    value = _col(value)
    place = F.dense_rank().over(_part(part).orderBy(_ordered(value, ascending)))
    return F.when(value.isNotNull(), place.cast("bigint"))


def row_order(df: DataFrame, order: Sequence[tuple[str, bool]], part: Sequence[str] = (), out: str = "overall_rank") -> DataFrame:
    """Strict 1..n order; ``order`` lists (column, ascending) and missing values come last."""
    keys = [_ordered(F.col(name), up) for name, up in order]
    return df.withColumn(out, F.row_number().over(_part(part).orderBy(*keys)).cast("bigint"))


def first_last_lag(df: DataFrame, value: str, order: str, part: Sequence[str]) -> DataFrame:
    """One row per group: first and last value in order, total gain and gain of the last step."""
    w = _part(part).orderBy(F.col(order))
    steps = df.select(*part, order, value, F.lag(value).over(w).alias("_previous"))
    last = F.max_by(F.struct(F.col(value).alias("v"), F.col("_previous").alias("p")), order)
    out = steps.groupBy(*part).agg(F.min_by(value, order).alias("first_value"), last.alias("_last"))
    return out.select(
        *part,
        "first_value",
        F.col("_last.v").alias("last_value"),
        (F.col("_last.v") - F.col("first_value")).alias("total_gain"),
        F.coalesce(F.col("_last.v") - F.col("_last.p"), F.lit(0.0)).alias("recent_gain"),
    )


def rank_matrix(scores: DataFrame, part: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Rank of every model inside each simulation (1 = smallest score)."""
    w = W.partitionBy(*part, "simulation").orderBy(F.col(score).asc_nulls_last())
    return scores.withColumn("rank", F.rank().over(w).cast("bigint"))


def window_share(value: Column | str, part: Sequence[str]) -> Column:
    value = _col(value)
    return value / F.sum(value).over(_part(part)) * F.lit(100.0)

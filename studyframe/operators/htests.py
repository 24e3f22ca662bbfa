"""Rank tests between groups. All ranks come from distinct values with their counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from studyframe.functions.running import distinct_totals, exact_quantiles, running_totals
from studyframe.functions.special import chi2_sf, mwu_exact_p
from studyframe.operators.quality import _long
from studyframe.operators.schema import _num

# Small sample up to which the exact distribution of U is used (without ties).
EXACT_SIDE = 8
EXACT_OTHER = 1_000


@F.pandas_udf(T.DoubleType())
def _mwu_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    import math

    out = []
    for stat, a, b, t, value in zip(u, n1, n2, ties, z):
        if a and b and t == 0 and min(a, b) <= EXACT_SIDE and max(a, b) <= EXACT_OTHER:
            out.append(mwu_exact_p(float(stat), int(a), int(b)))
        elif value is None or value != value:
            out.append(float("nan"))
        else:
            out.append(min(1.0, math.erfc(value / math.sqrt(2.0))))
    return pd.Series(out, dtype=float)


def _plus(names: Sequence[str]) -> Column:
    total = F.lit(0).cast("bigint")
    for name in names:
        total = total + F.col(name)
    return total


def _u_table(totals: DataFrame, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """U of the first group from running totals with ``cnt`` and ``first`` counts."""
    d = lambda c: F.col(c).cast("double")
    rank_sum = d("first") * (d("before_cnt") + (d("cnt") + 1) / 2.0)
    sums = totals.groupBy(*keys).agg(
        F.sum(rank_sum).alias("_r"), F.sum("first").alias("n1"), F.sum("cnt").alias("_n"), F.sum(d("cnt") * d("cnt") * d("cnt") - d("cnt")).alias("ties")
    )
    sums = sums.withColumn("n2", F.col("_n") - F.col("n1")).where((F.col("n1") > 0) & (F.col("n2") > 0))
    n1, n2, n = d("n1"), d("n2"), d("_n")
    u = F.col("_r") - n1 * (n1 + 1) / 2.0
    mean = n1 * n2 / 2.0
    plain = F.sqrt(n1 * n2 * (n + 1) / 12.0)
    tied = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = sums.withColumns({"U": u, "Z": F.when(plain > 0, (u - mean) / plain)})
    corrected = F.when(tied > 0, (F.greatest(F.col("U"), n1 * n2 - F.col("U")) - mean - 0.5) / tied)
    ties = F.col("ties") if exact else F.lit(1.0)
    return out.withColumn("p", _mwu_p("U", "n1", "n2", ties, corrected)).withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def mann_whitney_median(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Each feature compared between rows with target <= median and the rest.

    U belongs to the lower group; Z has neither tie nor continuity correction, p has both.
    """
    rows = df.select(_num(df, target).alias("_y"), *[_num(df, f).alias(f) for f in features]).na.drop("any")
    median = exact_quantiles(rows.select("_y"), [], "_y", [0.5]).first()["quantiles"][0]
    long = _long(rows.withColumn("_low", (F.col("_y") <= median).cast("bigint")), features, ["_low"])
    totals = running_totals(long, ["column"], "value", {"cnt": F.lit(1).cast("bigint"), "first": F.col("_low")})
    out = _u_table(totals, ["column"])
    return out.select(F.col("column").alias("feature"), "U", "Z", "p", F.col("n1").alias("n_low"), F.col("n2").alias("n_high"))


def _class_totals(df: DataFrame, label: str, features: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Distinct (column, value) with the rows of each class (``c<class>``), kept: tests of the same rows share them."""
    long = _long(df.where(F.col(label).isin(list(classes))), features, [label])
    return distinct_totals(long, ["column"], "value", {f"c{c}": (F.col(label) == c).cast("bigint") for c in classes})


def kruskal_wallis(df: DataFrame, label: str, features: Sequence[str], classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Tie-corrected H over the classes with its p-value; not run when a class is empty."""
    classes = list(classes)
    each = [f"c{c}" for c in classes]
    counts = _class_totals(df, label, features, classes).withColumn("cnt", _plus(each))
    totals = running_totals(None, ["column"], "value", {c: F.col(c) for c in ("cnt", *each)}, distinct=counts)
    d = lambda c: F.col(c).cast("double")
    rank = d("before_cnt") + (d("cnt") + 1) / 2.0
    agg = totals.groupBy("column").agg(
        F.sum("cnt").alias("n"), F.sum(d("cnt") * d("cnt") * d("cnt") - d("cnt")).alias("_ties"),
        *[F.sum(f"c{c}").alias(f"n_class_{c}") for c in classes], *[F.sum(d(f"c{c}") * rank).alias(f"_r{c}") for c in classes],
    )
    n = d("n")
    full = F.lit(True)
    between = F.lit(0.0)
    for c in classes:
        full = full & (F.col(f"n_class_{c}") > 0)
        between = between + F.col(f"_r{c}") * F.col(f"_r{c}") / d(f"n_class_{c}")
    correction = 1 - F.col("_ties") / (n * n * n - n)
    h = F.when(full & (correction > 0), (12.0 / (n * (n + 1)) * between - 3 * (n + 1)) / correction)
    out = agg.withColumn("kruskal_h", h)
    if len(classes) == 3:
        out = out.withColumn("p_value", F.exp(-F.col("kruskal_h") / 2.0))
    else:
        tail = F.pandas_udf(lambda s: s.map(lambda v: chi2_sf(v, len(classes) - 1), na_action="ignore").astype(float), T.DoubleType())
        out = out.withColumn("p_value", tail("kruskal_h"))
    note = F.when(~full, "not run: a class is empty").when(F.col("kruskal_h").isNull(), "not run: all values are equal").otherwise("omnibus test")
    return out.select(
        F.col("column").alias("feature"), "kruskal_h", "p_value", F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant_0_05"),
        *[f"n_class_{c}" for c in classes], note.alias("note"),
    )


def pairwise_mwu(
    df: DataFrame, label: str, features: Sequence[str], kw: DataFrame, alpha: float = 0.05, classes: Sequence[int] = (0, 1, 2)
) -> DataFrame:
    """Pairwise U tests of the features whose omnibus test is significant, with Holm-adjusted p-values.

    One ordering of the distinct values serves all pairs; where the omnibus test had the same rows and features, its counts do.
    """
    wanted = [r["feature"] for r in kw.where(F.col("p_value") < alpha).select("feature").collect()]
    classes = list(classes)
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    counts = _class_totals(df, label, features, classes).where(F.col("column").isin(wanted) if wanted else F.lit(False))
    ordered = running_totals(None, ["column"], "value", {f"c{c}": F.col(f"c{c}") for c in classes}, distinct=counts)
    of = lambda a, b: F.struct(
        F.lit(a).alias("group_1"), F.lit(b).alias("group_2"), (F.col(f"c{a}") + F.col(f"c{b}")).alias("cnt"), F.col(f"c{a}").alias("first"),
        (F.col(f"before_c{a}") + F.col(f"before_c{b}")).alias("before_cnt"),
    )
    totals = ordered.select("column", F.inline(F.array(*[of(a, b) for a, b in pairs]))).where("cnt > 0")
    out = _u_table(totals, ["column", "group_1", "group_2"]).select(
        F.col("column").alias("feature"), "group_1", "group_2", F.col("n1").alias("n_group_1"), F.col("n2").alias("n_group_2"), "U", F.col("p").alias("p_raw")
    )
    out = holm_adjust(out, "p_raw", ["feature"])
    return out.withColumn("significant_holm", F.col("p_holm") < alpha)


def holm_adjust(df: DataFrame, p: str, part: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Step-down Holm adjustment within each family of p-values."""
    family = W.partitionBy(*part)
    order = family.orderBy(F.col(p))
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn(
        out, F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_step")


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) if b > 0 else 1.0 for a, b in zip(x, dof)], dtype=float)


def split_similarity(split: DataFrame, label: str, split_col: str = "split", train: str = "train", test: str = "test", use_counts: bool = False) -> DataFrame:
    """Chi-square of the train class shares against the test class shares, with a warning flag (p <= 0.1).

    The published study feeds shares (which sum to 1), so its warning almost never fires;
    ``use_counts`` compares train counts with the counts that the test shares imply.
    """
    counts = split.where(F.col(split_col).isin(train, test)).groupBy(label).agg(
        F.count_if(F.col(split_col) == train).cast("double").alias("_a"), F.count_if(F.col(split_col) == test).cast("double").alias("_b")
    )
    all_rows = W.partitionBy(F.lit(0))
    a, b = F.col("_a") + 1e-10, F.col("_b") + 1e-10
    shares = counts.select((a / F.sum(a).over(all_rows)).alias("_s"), (b / F.sum(b).over(all_rows)).alias("_t"), F.sum("_a").over(all_rows).alias("_n"))
    scale = F.col("_n") if use_counts else F.lit(1.0)
    out = shares.agg(F.sum(scale * (F.col("_s") - F.col("_t")) * (F.col("_s") - F.col("_t")) / F.col("_t")).alias("chi2"), F.count(F.lit(1)).alias("classes"))
    out = out.withColumn("p", _chi2_tail("chi2", F.col("classes") - 1))
    return out.withColumn("differs", (F.col("p") <= 0.1) & (F.col("classes") > 1))

"""Data-quality profile of a sample table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.functions.columns import join_small
from studyframe.functions.running import exact_quantiles
from studyframe.operators.schema import _num, column_facts

PERCENT_WORDS = ("rate", "ratio", "percent", "percentage", "pct", "%")


def missing_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of missing values per column after coercion to numbers."""
    return column_facts(df, {c: {"missing_rate": F.avg(F.when(_num(df, c).isNull(), 1.0).otherwise(0.0))} for c in cols})


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of rows beyond the first of each distinct combination."""
    groups = df.groupBy(*[_num(df, c).alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n") - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def rules_for(cols: Sequence[str]) -> list[tuple[str, str, str]]:
    """(rule name, readable condition, column) of the generic checks."""
    rules = [(f"{c}_nonnegative", f"{c} must be >= 0", c) for c in cols]
    rules += [(f"{c}_in_0_100", f"{c} must be within [0, 100]", c) for c in cols if any(w in c.lower() for w in PERCENT_WORDS)]
    return rules


def violation(df: DataFrame, rule: str, column: str) -> Column:
    value = _num(df, column)
    broken = (value < 0) | (value > 100) if rule.endswith("_in_0_100") else value < 0
    return F.coalesce(broken, F.lit(False))


def constraint_checks(df: DataFrame, cols: Sequence[str], key: str, examples: int = 5) -> DataFrame:
    """Rules, number of violations and the first few offending keys.

    One scan finds the broken rules of each row; only offending rows go on, and the ordered pick of
    examples is limited inside every task before anything is shuffled.
    """
    rules = rules_for(cols)
    broken = F.filter(F.array(*[F.when(violation(df, name, c), F.lit(name)) for name, _, c in rules]), lambda v: v.isNotNull())
    offences = df.select(F.col(key).alias("_key"), F.explode(broken).alias("rule"))
    counts = offences.groupBy("rule").agg(F.count(F.lit(1)).alias("n_violations"))
    place = F.row_number().over(W.partitionBy("rule").orderBy("_key"))
    first = offences.withColumn("_place", place).where(F.col("_place") <= examples)
    first = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list(F.col("_key").cast("string"))), ",").alias("examples"))
    listed = df.sparkSession.createDataFrame([(n, c) for n, c, _ in rules], "rule string, condition string")
    out = join_small(join_small(listed, counts, ["rule"], "left"), first, ["rule"], "left")
    n = F.coalesce("n_violations", F.lit(0)).cast("bigint")
    return out.select("rule", "condition", (n == 0).alias("passed"), n.alias("n_violations"), F.coalesce("examples", F.lit("")).alias("examples"))


def quality_status(missing: DataFrame, checks: DataFrame, fail: float = 0.25, warn: float = 0.05) -> DataFrame:
    """FAIL, WARN or PASS."""
    worst = missing.agg(F.max("missing_rate").alias("worst"), F.lit(1).alias("_one"))
    broken = checks.agg(F.coalesce(F.sum("n_violations"), F.lit(0)).alias("broken"), F.lit(1).alias("_one"))
    status = (
        F.when(F.col("worst") >= fail, "FAIL").when((F.col("worst") >= warn) | (F.col("broken") > 0), "WARN").otherwise("PASS")
    )
    return worst.join(broken, "_one").select(status.alias("status"), F.col("worst").alias("worst_missing_rate"), F.col("broken").cast("bigint").alias("n_violations"))


# ------------------------------------------------------------------ descriptions

_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _stats(value: Column) -> dict[str, Column]:
    return {"count": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _num(df, c).alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def _with_quartiles(facts: DataFrame, rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    quartiles = exact_quantiles(rows, keys, "value", [0.25, 0.5, 0.75], limit=limit).drop("n")
    out = join_small(facts, quartiles, keys, "left", width=3)
    named = {p: F.get("quantiles", F.lit(i)) for i, p in enumerate(("p25", "p50", "p75"))}
    return out.select(*keys, *(named[s].alias(s) if s in named else s for s in _STATS))


def describe_table(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """count, mean, sd, min, quartiles and max of every column; a column without values has count 0 and NULLs."""
    facts = column_facts(df, {c: _stats(_num(df, c)) for c in cols})
    return _with_quartiles(facts, _long(df, cols), ["column"], limit)


def group_describe(df: DataFrame, cols: Sequence[str], by: str, total: str | None = "full", limit: int | None = None) -> DataFrame:
    """The same per value of ``by``, of the columns that have values there; ``total`` names an extra row over all rows."""
    shown = F.array(F.col(by).cast("string"), F.lit(total)) if total else F.array(F.col(by).cast("string"))
    rows = _long(df, cols, [by]).select(F.explode(shown).alias(by), "column", "value")
    facts = rows.groupBy(by, "column").agg(*(x.alias(name) for name, x in _stats(F.col("value")).items()))
    return _with_quartiles(facts, rows, [by, "column"], limit)


def class_counts(df: DataFrame, label: str, split: str, total: str = "full") -> DataFrame:
    """Rows per class in each part of the split and in all rows; the total reuses the part counts."""
    parts = df.groupBy(F.col(split).alias("split"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    both = parts.select(F.explode(F.array(F.col("split"), F.lit(total))).alias("split"), "label", "n")
    return both.groupBy("split", "label").agg(F.sum("n").cast("bigint").alias("n"))


def histogram_bins(n: int, low: float, high: float, iqr: float) -> int:
    """Number of equal bins: the finer of the Sturges and Freedman-Diaconis widths."""
    spread = high - low
    if n < 1 or spread <= 0:
        return 1
    sturges = spread / (math.log2(n) + 1.0)
    diaconis = 2.0 * iqr / n ** (1.0 / 3.0)
    return max(1, math.ceil(spread / (min(sturges, diaconis) if diaconis > 0 else sturges)))


def histogram(df: DataFrame, col: str, bins: int | str = "auto", by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins over the whole range, density, and the fitted normal density at bin centres."""
    value = _num(df, col)
    rows = df.select(*by, value.alias("_v")).where(F.col("_v").isNotNull())
    facts = rows.agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd")).first()
    if not facts["n"]:
        raise ValueError(f"no values in {col}")
    if bins == "auto":
        q = exact_quantiles(rows.select("_v"), [], "_v", [0.25, 0.75]).first()["quantiles"]
        bins = histogram_bins(facts["n"], facts["lo"], facts["hi"], q[1] - q[0])
    low, high = facts["lo"], facts["hi"]
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col("_v") - low) * float(bins) / (high - low)), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    centre = F.lit(low) + (F.col("bin") + 0.5) * width
    out = out.withColumn("bin_start", F.lit(low) + F.col("bin") * width).withColumn("density", F.col("n") / (F.sum("n").over(part) * width))
    if facts["sd"]:
        z = (centre - facts["mean"]) / facts["sd"]
        normal = F.exp(-z * z / 2.0) / (facts["sd"] * math.sqrt(2.0 * math.pi))
    else:
        normal = F.lit(None).cast("double")
    return out.withColumn("normal_density", normal).select(*by, "bin", "bin_start", "n", "density", "normal_density")

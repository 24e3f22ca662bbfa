"""Correlations, moments, normality and collinearity of sample tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from studyframe.functions.columns import SMALL_ROWS, join_small, kept
from studyframe.functions.normal import norm_ppf
from studyframe.functions.running import distinct_totals, running_totals
from studyframe.functions.special import ad_term_udf, f_sf, normal_score_sum, score_sum_udf, shapiro_from_sums
from studyframe.operators.quality import _long
from studyframe.operators.schema import _num, column_facts

# Pairs of columns handled by one aggregation.
PAIRS_PER_JOB = 300


def _matrix(pairs: DataFrame, cols: Sequence[str], diagonal: DataFrame) -> DataFrame:
    mirrored = pairs.select(
        F.inline(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r"))))
    )
    return mirrored.unionByName(diagonal.select(F.col("column").alias("a"), F.col("column").alias("b"), "r"))


def _varied(value: Column) -> Column:
    """Whether the values differ; a variance merged from several parts may be a little above zero for equal ones."""
    return F.min(value) < F.max(value)


def _sd(value: Column) -> Column:
    return F.when(_varied(value), F.stddev_samp(value)).when(F.count(value) > 1, 0.0)


def _pair_corr(df: DataFrame, pairs: Sequence[tuple[str, str]], of) -> DataFrame:
    out = None
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        block = pairs[start : start + PAIRS_PER_JOB]
        row = df.agg(*[F.when(_varied(of(a)) & _varied(of(b)), F.corr(of(a), of(b))).alias(f"_{i}") for i, (a, b) in enumerate(block)])
        lines = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(block)]
        part = row.select(F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    return out


def _diagonal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return column_facts(df, {c: {"r": F.when(_varied(_num(df, c)), 1.0)} for c in cols})


def corr_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix as (a, b, r); each pair uses the rows in which both are present. One scan."""
    values = df.select(*[_num(df, c).alias(c) for c in cols])
    pairs = _pair_corr(values, list(combinations(cols, 2)), lambda c: F.col(f"`{c}`"))
    return _matrix(pairs, cols, _diagonal(values, cols))


def _rankings(cols: Sequence[str], whole: Sequence[bool]) -> tuple[dict[str, tuple[int, int | None]], dict[tuple[str, str], tuple[str, str]]]:
    """The rankings that the pairs of columns need (name -> column it ranks, column whose gaps it leaves out), and those of each pair."""
    ranked: dict[str, tuple[int, int | None]] = {f"r{i}": (i, None) for i in range(len(cols))}
    of = {}
    for (i, a), (j, b) in combinations(enumerate(cols), 2):
        sides = []
        for own, other in ((i, j), (j, i)):
            # A column is ranked anew only where the other one has gaps; else its own ranking serves.
            name = f"r{own}" if whole[other] else f"r{own}_{other}"
            ranked.setdefault(name, (own, other))
            sides.append(name)
        of[a, b] = (sides[0], sides[1])
    return ranked, of


def _ranks_by_row(rows: DataFrame, ranked: dict[str, tuple[int, int | None]], ranks: DataFrame, facts: dict[int, dict], small_rows: int) -> DataFrame:
    """Rows with one column per ranking: the row's rank less the mean rank.

    Columns with few distinct values, ``small_rows`` together, are looked up by broadcast. Each of the others meets the
    ranks of its values, in all rankings at once, in one join: but for values of more than a thousandth of the rows,
    which are at most a thousand and broadcast too.
    """
    names = [c for c in rows.columns if c != "_w"]
    out, held = rows, 0
    for i in sorted(facts, key=lambda i: (facts[i]["d"], i)):
        held += facts[i]["d"]
        own = [n for n, (column, _) in ranked.items() if column == i]
        side = ranks.where(F.col("column") == i)
        value = F.col(f"_{i}")
        if held <= small_rows:
            out = out.join(F.broadcast(side.select(F.col("value").alias("_k"), *own)), value == F.col("_k"), "left").drop("_k")
            continue
        hot = F.col("cnt") * 1000 > facts[i]["n_cnt"]
        near = side.where(hot).select(F.col("value").alias("_k"), *[F.col(n).alias(f"_h_{n}") for n in own])
        out = out.join(F.broadcast(near), value == F.col("_k"), "left")
        # Rows that need no partner any more are dealt out by a hash of all their values and find none.
        away = F.when(value.isNotNull() & F.col("_k").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*names), F.lit(1 << 30))).cast("int")
        rest = side.where(~hot).select(F.col("value").alias("_v"), F.lit(0).alias("_at"), *own)
        out = out.withColumn("_away", away).drop("_k").join(rest, (value == F.col("_v")) & (F.col("_away") == F.col("_at")), "left")
        out = out.withColumns({n: F.coalesce(n, f"_h_{n}") for n in own}).drop("_v", "_at", "_away", *[f"_h_{n}" for n in own])
    centred = []
    for name, (i, other) in ranked.items():
        if i not in facts:
            centred.append(F.lit(None).cast("double").alias(name))
            continue
        rank = F.col(name) - F.lit(((facts[i][f"n_{_count(other)}"] or 0) + 1) / 2.0)
        centred.append((rank if other is None else F.when(F.col(f"_{other}").isNotNull(), rank)).alias(name))
    return out.select("_w", *centred)


def _count(other: int | None) -> str:
    return "cnt" if other is None else f"c{other}"


def corr_spearman(df: DataFrame, cols: Sequence[str], small_rows: int = SMALL_ROWS) -> DataFrame:
    """Spearman matrix with average ranks; a pair with missing values is ranked on its common rows.

    The rows are read once: equal ones are counted and kept. All rankings of a column come from one ordering of its
    distinct values, which carries a count per column with gaps.
    """
    names = [f"_{i}" for i in range(len(cols))]
    values = df.select(*[_num(df, c).alias(n) for n, c in zip(names, cols)])
    rows = kept(values.groupBy(*names).agg(F.count(F.lit(1)).alias("_w")))
    missing = rows.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    ranked, of = _rankings(cols, [missing[n] == 0 for n in names])
    gaps = sorted({other for _, other in ranked.values() if other is not None})
    amounts = {"cnt": F.col("_w")} | {f"c{j}": F.col(f"c{j}") for j in gaps}
    lines = F.inline(F.array(*[F.struct(F.lit(i).alias("column"), F.col(n).alias("value")) for i, n in enumerate(names)]))
    long = rows.select("_w", *[F.when(F.col(f"_{j}").isNotNull(), F.col("_w")).otherwise(0).alias(f"c{j}") for j in gaps], lines)
    totals = running_totals(long, ["column"], "value", amounts)
    rank = lambda n: F.when(F.col(n) > 0, F.col(f"before_{n}") + (F.col(n) + 1) / F.lit(2.0))
    ranks = kept(totals.select("column", "value", *amounts, *[rank(n).alias(f"rank_{n}") for n in amounts]))
    sizes = ranks.groupBy("column").agg(F.count(F.lit(1)).alias("d"), *[F.sum(n).alias(f"n_{n}") for n in amounts]).collect()
    named = [F.when(F.col("column") == i, F.col(f"rank_{_count(other)}")).alias(name) for name, (i, other) in ranked.items()]
    wide = _ranks_by_row(rows, ranked, ranks.select("column", "value", "cnt", *named), {r["column"]: r.asDict() for r in sizes}, small_rows)
    out = None
    pairs = list(of)
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        block = pairs[start : start + PAIRS_PER_JOB]
        # Ranks are centred, so products need no means; both rankings of a pair cover the same rows.
        product = lambda a, b: F.sum(F.col("_w") * F.col(a) * F.col(b))
        squares = sorted({name for p in block for name in of[p]})
        row = wide.agg(*[product(n, n).alias(f"s_{n}") for n in squares], *[product(*of[p]).alias(f"c{i}") for i, p in enumerate(block)])
        corr = lambda i, a, b: F.when((F.col(f"s_{a}") > 0) & (F.col(f"s_{b}") > 0), F.col(f"c{i}") / (F.sqrt(f"s_{a}") * F.sqrt(f"s_{b}")))
        lines = [F.struct(F.lit(p[0]).alias("a"), F.lit(p[1]).alias("b"), corr(i, *of[p]).alias("r")) for i, p in enumerate(block)]
        part = row.select(F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    return _matrix(out, cols, _diagonal(rows.select(*[F.col(n).alias(c) for c, n in dict(zip(cols, names)).items()]), cols))


# ------------------------------------------------------------------ moments


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, mean, sd, bias-corrected skewness and excess kurtosis per column, in one aggregation."""
    facts = {}
    for c in cols:
        v = _num(df, c)
        facts[c] = {"n": F.count(v), "mean": F.avg(v), "sd": _sd(v), "g1": F.skewness(v), "g2": F.kurtosis(v)}
    return _corrected(column_facts(df, facts))


def _corrected(m: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    skew = F.when((n >= 3) & (F.col("sd") > 0), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & (F.col("sd") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return m.withColumns({"skew": skew, "exkurt": kurt})


def dagostino_k2(m: DataFrame) -> DataFrame:
    """Omnibus K² of skewness and kurtosis with its p-value from a moments table; NULL below 8 rows."""
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    a = y / F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(a) / F.sqrt(0.5 * F.log(w2))
    b2 = F.col("g2") + 3
    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean_b2) / F.sqrt(var_b2)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big_a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denominator = 1 + x * F.sqrt(2 / (big_a - 4))
    third = F.signum(denominator) * F.pow((1 - 2 / big_a) / F.abs(denominator), F.lit(1.0 / 3.0))
    z2 = (1 - 2 / (9 * big_a) - third) / F.sqrt(2 / (9 * big_a))
    usable = (n >= 8) & (F.col("sd") > 0)
    out = m.withColumn("dagostino_k2", F.when(usable, z1 * z1 + z2 * z2))
    return out.withColumn("dagostino_p", F.exp(-F.col("dagostino_k2") / 2))


# ------------------------------------------------------------------ ordered statistics


def _ordered(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values with their places, centred values and the facts of their group. The rows are read once."""
    keys = list(keys)
    distinct = distinct_totals(long, keys, "value")
    v, c = F.col("value"), F.col("cnt")
    means = distinct.groupBy(*keys).agg(F.sum(c).alias("n"), (F.sum(v * c) / F.sum(c)).alias("mean"), _varied(v).alias("_varied"), F.count(v).alias("_lines"))
    means = kept(means)
    largest = means.agg(F.max("_lines")).first()[0] or 0
    totals = running_totals(None, keys, "value", {"cnt": F.col("cnt")}, distinct=distinct, largest=largest)
    means = means.drop("_lines")
    apart = v - F.col("mean")
    squared = apart * apart
    powers = {"_m2": F.sum(c * squared), "_m3": F.sum(c * squared * apart), "_m4": F.sum(c * squared * squared)}
    facts = join_small(distinct, means, keys).groupBy(*keys, "n", "mean", "_varied").agg(*[p.alias(name) for name, p in powers.items()])
    n, m2, varied = F.col("n").cast("double"), F.col("_m2"), F.col("_varied") & (F.col("_m2") > 0)
    facts = facts.select(
        *keys, "n", "mean", F.when(F.col("_varied"), F.sqrt(m2 / (n - 1))).when(n > 1, 0.0).alias("sd"), F.when(F.col("_varied"), m2 / n).otherwise(0.0).alias("var"),
        F.when(varied, F.sqrt(n) * F.col("_m3") / (m2 * F.sqrt(m2))).alias("g1"), F.when(varied, n * F.col("_m4") / (m2 * m2) - 3).alias("g2"),
    )
    return join_small(totals, facts, keys).withColumn("centred", F.col("value") - F.col("mean"))


def _ad_sum(clip: float = 0.0) -> Column:
    """Sum that makes up A², of lines with their ``_z``."""
    return F.sum(ad_term_udf(clip)("_z", "before_cnt", "cnt", "n"))


def _critical(n: Column) -> Column:
    n = n.cast("double")
    return F.round(0.787 / (1 + 4 / n - 25 / (n * n)), 3)


def anderson_darling_normal(long: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """A² against a normal with the sample mean and sd, the 5 % critical value and the decision."""
    rows = _ordered(long, keys).where(F.col("sd") > 0)
    rows = rows.withColumn("_z", F.when(F.col("sd") > 0, F.col("centred") / F.col("sd")))
    out = rows.groupBy(*keys, "n").agg(_ad_sum().alias("_t"))
    a2 = -F.col("n") - F.col("_t") / F.col("n")
    out = out.select(*keys, "n", a2.alias("anderson_statistic"), _critical(F.col("n")).alias("anderson_critical_5pct"))
    ok = F.col("anderson_statistic") < F.col("anderson_critical_5pct")
    return out.withColumn("anderson_decision_5pct", F.when(ok, "Approximately normal").otherwise("Non-normal"))


def ad_residual(pred: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """A² of the residuals with population sd + 1e-12 and clipped tails; NULL below 5 rows."""
    long = pred.select(*keys, (F.col(y) - F.col(p)).alias("value"))
    rows = _ordered(long, keys)
    rows = rows.withColumn("_z", F.col("centred") / (F.sqrt("var") + 1e-12))
    out = rows.groupBy(*keys, "n").agg(_ad_sum(1e-12).alias("_t"))
    return out.select(*keys, "n", F.when(F.col("n") >= 5, -F.col("n") - F.col("_t") / F.col("n")).alias("ad_stat"))


_WP = T.StructType([T.StructField("w", T.DoubleType()), T.StructField("p", T.DoubleType())])


@F.pandas_udf(_WP)
def _shapiro(n: pd.Series, total: pd.Series, x1: pd.Series, x2: pd.Series, x3: pd.Series, x4: pd.Series, ssq: pd.Series) -> pd.DataFrame:
    found = [shapiro_from_sums(int(a), b, (c, d, e, f), g) for a, b, c, d, e, f, g in zip(n, total, x1, x2, x3, x4, ssq)]
    return pd.DataFrame(found, columns=["w", "p"], dtype=float)


def _shapiro_aggs() -> list[Column]:
    at = lambda rank: F.max(F.when((F.col("before_cnt") < rank) & (rank <= F.col("before_cnt") + F.col("cnt")), F.col("centred")))
    n = F.col("n")
    score = score_sum_udf(0.375, 0.25)(F.col("before_cnt"), F.col("cnt"), n)
    return [
        F.sum(F.col("centred") * score).alias("_ws"), at(F.lit(1)).alias("_x1"), at(F.lit(2)).alias("_x2"), at(n - 1).alias("_x3"), at(n).alias("_x4"),
        F.first(F.col("var") * n).alias("_ssq"),
    ]


def _shapiro_columns(df: DataFrame, alpha: float) -> DataFrame:
    out = df.withColumn("_wp", _shapiro("n", "_ws", "_x1", "_x2", "_x3", "_x4", "_ssq"))
    note = F.when(F.col("n") > 5000, "For n > 5000 the Shapiro-Wilk p-value may be less accurate.")
    p = F.col("_wp.p")
    decision = F.when(p.isNull(), "Not assessed").when(p >= alpha, "Approximately normal").otherwise("Non-normal")
    out = out.withColumns({"shapiro_w": F.col("_wp.w"), "shapiro_p": p, "normality_decision_shapiro": decision, "note": note})
    return out.drop("_wp", "_ws", "_x1", "_x2", "_x3", "_x4", "_ssq")


def shapiro_wilk(long: DataFrame, keys: Sequence[str] = ("column",), alpha: float = 0.05) -> DataFrame:
    """W, p and decision of (keys, value) rows. Each distinct value meets the summed scores of its ranks."""
    out = _ordered(long, keys).groupBy(*keys, "n").agg(*_shapiro_aggs())
    return _shapiro_columns(out, alpha)


def normality_table(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Moments, Shapiro-Wilk, K² and A² of every column, from one ordering of the distinct values."""
    rows = _ordered(_long(df, cols), ["column"])
    rows = rows.withColumn("_z", F.when(F.col("sd") > 0, F.col("centred") / F.col("sd")))
    out = rows.groupBy("column", "n", "mean", "sd", "g1", "g2").agg(_ad_sum().alias("_t"), *_shapiro_aggs())
    out = dagostino_k2(_corrected(_shapiro_columns(out, alpha)))
    out = out.withColumn("anderson_statistic", F.when(F.col("sd") > 0, -F.col("n") - F.col("_t") / F.col("n")))
    out = out.withColumn("anderson_critical_5pct", _critical(F.col("n")))
    a = F.when(F.col("anderson_statistic") < F.col("anderson_critical_5pct"), "Approximately normal").otherwise("Non-normal")
    return out.select(
        "column", "n", "mean", F.col("sd").alias("std"), F.col("skew").alias("skewness"), F.col("exkurt").alias("excess_kurtosis"), "shapiro_w", "shapiro_p",
        "dagostino_k2", "dagostino_p", "anderson_statistic", "anderson_critical_5pct", a.alias("anderson_decision_5pct"), F.lit(alpha).alias("alpha"),
        "normality_decision_shapiro", "note",
    )


def qq_points(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """All points of the normal Q-Q plot, or about k of them, with slope, intercept and r of the line through all points."""
    shift, extra = 0.3175, 0.365
    rows = _ordered(df.select(_num(df, col).alias("value"), F.lit(0).alias("_g")), ["_g"]).drop("_g")
    score = score_sum_udf(shift, extra)(F.col("before_cnt"), F.col("cnt"), F.col("n"))
    sums = rows.agg(
        F.sum(F.col("centred") * score).alias("s"), F.first("n").alias("n"), F.first("mean").alias("mean"), F.first(F.col("var") * F.col("n")).alias("ssq"),
        F.min("centred").alias("lo"), F.max("centred").alias("hi"),
    ).first()
    n = int(sums["n"])
    plain, outer = NormalDist().inv_cdf((n - shift) / (n + extra)), NormalDist().inv_cdf(0.5 ** (1.0 / n))
    cross = sums["s"] + (outer - plain) * (sums["hi"] - sums["lo"])
    square = normal_score_sum(1, n, n, shift, extra, 2) + 2 * (outer * outer - plain * plain)
    step = max(1, n // k) if k else 1
    first = F.ceil((F.col("before_cnt") + 1) / F.lit(step)) * step
    ranks = F.filter(
        F.array_distinct(F.concat(F.when(F.col("before_cnt") == 0, F.array(F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
                 F.when(first <= F.col("before_cnt") + F.col("cnt"), F.sequence(first, F.col("before_cnt") + F.col("cnt"), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
                 F.when(F.col("before_cnt") + F.col("cnt") == n, F.array(F.lit(n).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))),
        lambda r: r.isNotNull(),
    )
    points = rows.select("value", F.explode(ranks).alias("rank"))
    share = F.when(F.col("rank") == n, 0.5 ** (1.0 / n)).when(F.col("rank") == 1, 1 - 0.5 ** (1.0 / n)).otherwise((F.col("rank") - shift) / (n + extra))
    return points.withColumn("_share", share).select(
        "rank", norm_ppf("_share").alias("theoretical"), F.col("value").alias("ordered"), F.lit(cross / square).alias("slope"), F.lit(sums["mean"]).alias("intercept"),
        F.lit(cross / math.sqrt(square * sums["ssq"]) if sums["ssq"] else None).cast("double").alias("r"),
    )


# ------------------------------------------------------------------ linear models from one pass


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance matrix of complete rows, from one aggregation."""
    values = df.select(*[_num(df, c).alias(f"_{i}") for i, c in enumerate(cols)]).na.drop("any")
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = values.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"_{i}").alias(f"m{i}") for i in range(p)], *[F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i, j in pairs]
    ).first()
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else np.nan
    return int(row["n"]), np.array([row[f"m{i}"] for i in range(p)], dtype=float), cov


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factors (diagonal of the inverse correlation matrix); empty for one feature."""
    spark, schema = df.sparkSession, "feature string, vif double"
    if len(features) < 2:
        return spark.createDataFrame([], schema)
    _, _, cov = gram(df, features)
    sd = np.sqrt(np.diag(cov))
    with np.errstate(all="ignore"):
        corr = cov / np.outer(sd, sd)
    try:
        values = np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        values = np.full(len(features), np.inf)
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], schema)


def _least_squares(df: DataFrame, target: str, features: Sequence[str]):
    n, means, cov = gram(df, [target, *features])
    sxx, sxy, syy = cov[1:, 1:] * n, cov[1:, 0] * n, cov[0, 0] * n
    inverse = np.linalg.inv(sxx)
    beta = inverse @ sxy
    explained = float(beta @ sxy)
    return n, means, beta, inverse, explained, syy


def ols_fit(df: DataFrame, target: str, features: Sequence[str], name: str = "") -> DataFrame:
    """In-sample R² of the least-squares fit on complete rows."""
    n, means, beta, _, explained, syy = _least_squares(df, target, features)
    r2 = float(explained / syy) if syy > 0 else None
    intercept = float(means[0] - beta @ means[1:])
    return df.sparkSession.createDataFrame(
        [(target, name, n, len(features), r2, intercept)], "target string, feature_set string, n bigint, n_features int, r2 double, intercept double"
    )


def anova_type2(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Partial sum of squares, F and p of each feature, and the residual row."""
    n, _, beta, inverse, explained, syy = _least_squares(df, target, features)
    dof = n - len(features) - 1
    residual = syy - explained
    lines = []
    for i, f in enumerate(features):
        ss = float(beta[i] ** 2 / inverse[i, i])
        stat = float(ss / (residual / dof)) if dof > 0 and residual > 0 else None
        lines.append((f, ss, 1.0, stat, f_sf(stat, 1, dof) if stat is not None else None))
    lines.append(("Residual", float(residual), float(dof), None, None))
    return df.sparkSession.createDataFrame(lines, "feature string, sum_sq double, df double, f double, p double")


def residual_diagnostics(pred: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred", alpha: float = 0.05) -> DataFrame:
    """Residual (true - predicted) mean, sd, skewness, kurtosis, A² and Shapiro-Wilk (3 to 5000 rows)."""
    long = pred.select(*keys, (F.col(y) - F.col(p)).alias("value"))
    rows = _ordered(long, keys)
    rows = rows.withColumn("_z", F.col("centred") / (F.sqrt("var") + 1e-12))
    out = rows.groupBy(*keys, "n", "mean", "sd", "g1", "g2").agg(_ad_sum(1e-12).alias("_t"), *_shapiro_aggs())
    out = _corrected(_shapiro_columns(out, alpha))
    sized = (F.col("n") >= 3) & (F.col("n") <= 5000)
    return out.select(
        *keys, "n", F.col("mean").alias("residual_bias"), F.col("sd").alias("residual_sd"), F.col("skew").alias("residual_skewness"),
        F.col("exkurt").alias("residual_kurtosis"), F.when(F.col("n") >= 5, -F.col("n") - F.col("_t") / F.col("n")).alias("ad_stat"),
        F.when(sized, F.col("shapiro_w")).alias("shapiro_w"), F.when(sized, F.col("shapiro_p")).alias("shapiro_p"),
    )

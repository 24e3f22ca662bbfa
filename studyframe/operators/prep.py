"""Preprocessing stages. Each is fitted by aggregations and becomes a SQL projection.

The fitted form of every stage is a ``SQLTransformer``, for quantiles with isotonic models beside it: it runs
inside the JVM with the rest of the plan, has no Python at scoring time, and is saved and loaded with the
pipeline like any built-in stage.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from studyframe.functions.normal import inverse_normal_sql
from studyframe.functions.running import exact_quantiles
from studyframe.operators.quality import _long

MAX_CATEGORIES = 10_000


def _q(name: str) -> str:
    return f"`{name}`"


def _lit(value: float | str | None) -> str:
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def _replace(exprs: Mapping[str, str]) -> SQLTransformer:
    """Projection that puts new expressions in the place of columns of the same name."""
    names = ", ".join(_q(c) for c in exprs)
    news = ", ".join(f"{e} AS {_q(c)}" for c, e in exprs.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({names}), {news} FROM __THIS__")


def _append(exprs: Mapping[str, str]) -> SQLTransformer:
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS {_q(c)}" for c, e in exprs.items()) + " FROM __THIS__")


class _SqlStage(Estimator):
    """An estimator over named columns whose model is a SQL projection."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def outputs(self) -> list[str]:
        return self.cols


def _facts(df: DataFrame, cols: Sequence[str], **exprs) -> dict[str, dict[str, float]]:
    row = df.agg(*[e(F.col(_q(c)).cast("double")).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, e in exprs.items()]).first()
    return {c: {k: row[f"{i}_{k}"] for k in exprs} for i, c in enumerate(cols)}


def _quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    found = exact_quantiles(_long(df, cols), ["column"], "value", probs).collect()
    return {r["column"]: list(r["quantiles"]) for r in found}


class MedianImputer(_SqlStage):
    """Missing values become the exact median of the fitted rows."""

    def _fit(self, df: DataFrame) -> SQLTransformer:
        medians = _quantiles(df, self.cols, [0.5])
        return _replace({c: f"coalesce(CAST({_q(c)} AS DOUBLE), {_lit(medians[c][0] if c in medians else None)})" for c in self.cols})


class Scaler(_SqlStage):
    """standard (population sd), minmax, robust (median and IQR) or maxabs."""

    def __init__(self, cols: Sequence[str], kind: str):
        super().__init__(cols)
        self.kind = kind

    def _fit(self, df: DataFrame) -> SQLTransformer:
        if self.kind == "standard":
            found = {c: (f["m"], f["s"]) for c, f in _facts(df, self.cols, m=F.avg, s=F.stddev_pop).items()}
        elif self.kind == "minmax":
            found = {c: (f["lo"], f["hi"] - f["lo"]) for c, f in _facts(df, self.cols, lo=F.min, hi=F.max).items()}
        elif self.kind == "robust":
            found = {c: (q[1], q[2] - q[0]) for c, q in _quantiles(df, self.cols, [0.25, 0.5, 0.75]).items()}
        elif self.kind == "maxabs":
            found = {c: (0.0, f["top"]) for c, f in _facts(df, self.cols, top=lambda v: F.max(F.abs(v))).items()}
        else:
            raise ValueError(f"unknown scaling {self.kind}")
        return _replace({c: f"(CAST({_q(c)} AS DOUBLE) - {_lit(a)}) / {_lit(b if b else 1.0)}" for c, (a, b) in found.items()})


# ------------------------------------------------------------------ power transforms

#: Where the search for an exponent begins; it widens while the best one is at an end.
LAMBDA_RANGE = (-5.0, 5.0)
LAMBDA_WIDEST = 1e6
LAMBDA_POINTS = 11
LAMBDA_ROUNDS = 3


def _yeo_johnson(x: str, lam: str) -> str:
    up = f"CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (power(1 + {x}, {lam}) - 1) / {lam} END"
    down = f"CASE WHEN abs(2 - {lam}) < 1e-12 THEN -ln(1 - {x}) ELSE -(power(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


def _box_cox(x: str, lam: str) -> str:
    return f"CASE WHEN abs({lam}) < 1e-12 THEN ln({x}) ELSE (power({x}, {lam}) - 1) / {lam} END"


class PowerTransform(_SqlStage):
    """Yeo-Johnson or Box-Cox with the most likely exponent, then standardised.

    Each round scores a row of candidate exponents for all columns in one aggregation. A column whose best
    candidate is at an end of its range goes on with a range three times as wide, the others narrow theirs; a
    parabola through the best three candidates of the last round gives the exponent. Box-Cox works on values
    over their geometric mean, which changes neither exponent nor result and keeps large powers finite.
    """

    def __init__(self, cols: Sequence[str], kind: str):
        super().__init__(cols)
        self.kind = kind

    def _fit(self, df: DataFrame) -> SQLTransformer:
        shape = _yeo_johnson if self.kind == "yeo-johnson" else _box_cox
        if self.kind == "box-cox":
            low = _facts(df, self.cols, lo=F.min)
            bad = [c for c in self.cols if low[c]["lo"] is not None and low[c]["lo"] <= 0]
            if bad:
                raise ValueError(f"box-cox needs positive values: {bad}")
        unit = {c: 1.0 for c in self.cols}
        if self.kind == "box-cox":
            unit |= {c: math.exp(f["g"]) for c, f in _facts(df, self.cols, g=lambda v: F.avg(F.log(v))).items() if f["g"] is not None}
        long = _long(df, self.cols)
        long = long.withColumn("value", F.col("value") / F.create_map(*[v for c in self.cols for v in (F.lit(c), F.lit(unit[c]))])[F.col("column")])
        jacobian = F.expr("sum(sign(value) * ln(abs(value) + 1))" if self.kind == "yeo-johnson" else "sum(ln(value))")
        ranges = {c: LAMBDA_RANGE for c in self.cols}
        left_over = {c: LAMBDA_ROUNDS for c in self.cols}
        peaks: dict[str, float] = {}
        while any(left_over.values()):
            tried = {c: [lo + (hi - lo) * i / (LAMBDA_POINTS - 1) for i in range(LAMBDA_POINTS)] for c, (lo, hi) in ranges.items()}
            table = F.create_map(*[v for c in self.cols for v in (F.lit(c), F.array(*[F.lit(x) for x in tried[c]]))])
            rows = long.select("column", "value", F.posexplode(table[F.col("column")]).alias("i", "lam"))
            found = rows.groupBy("column", "i").agg(F.count("value").alias("n"), jacobian.alias("j"), F.expr(f"var_pop({shape('value', 'lam')})").alias("v")).collect()
            fit = {
                (r["column"], r["i"]): -math.inf if r["v"] is None or not r["v"] > 0 else -r["n"] / 2.0 * math.log(r["v"]) + (tried[r["column"]][r["i"]] - 1.0) * r["j"]
                for r in found
            }
            for c in [c for c in self.cols if left_over[c]]:
                values = [fit.get((c, i), -math.inf) for i in range(LAMBDA_POINTS)]
                best = max(range(LAMBDA_POINTS), key=values.__getitem__)
                step = tried[c][1] - tried[c][0]
                lo, hi = tried[c][0], tried[c][-1]
                at_end = best in (0, LAMBDA_POINTS - 1) and math.isfinite(values[best]) and left_over[c] == LAMBDA_ROUNDS
                if at_end and hi - lo < LAMBDA_WIDEST:
                    ranges[c] = (lo - 2 * (hi - lo), hi) if best == 0 else (lo, hi + 2 * (hi - lo))
                    peaks[c] = tried[c][best]
                    continue
                left_over[c] -= 1
                ranges[c] = (tried[c][best] - step, tried[c][best] + step)
                peaks[c] = tried[c][best]
                if 0 < best < LAMBDA_POINTS - 1:
                    left, mid, right = values[best - 1 : best + 2]
                    bend = left - 2 * mid + right
                    if math.isfinite(bend) and bend < 0:
                        peaks[c] += step * (left - right) / (2 * bend)
        self.lambdas = peaks
        x = lambda c: f"(CAST({_q(c)} AS DOUBLE) / {_lit(unit[c])})" if unit[c] != 1.0 else f"CAST({_q(c)} AS DOUBLE)"
        shaped = {c: shape(x(c), _lit(self.lambdas[c])) for c in self.cols}
        row = df.agg(*[F.expr(f"{f}({e})").alias(f"{f}{j}") for j, e in enumerate(shaped.values()) for f in ("avg", "stddev_pop")]).first()
        return _replace({c: f"(({e}) - {_lit(row[f'avg{j}'])}) / {_lit(row[f'stddev_pop{j}'] or 1.0)}" for j, (c, e) in enumerate(shaped.items())})


def _share_points(knots: Sequence[float]) -> list[tuple[float, float]]:
    """Points (value, share) of the piecewise linear map through sorted knots.

    A value that several knots share maps to the middle of their shares, values right beside it to the first and
    the last; the smallest knot is 0 and the largest 1.
    """
    last = max(1, len(knots) - 1)
    ties: dict[float, list[int]] = {}
    for i, v in enumerate(knots):
        ties.setdefault(v + 0.0, []).append(i)
    points = {v: (at[0] + at[-1]) / 2 / last for v, at in ties.items()}
    points[max(points)], points[min(points)] = 1.0, 0.0
    for v, at in ties.items():
        if len(at) > 1:
            if at[0] > 0:
                points.setdefault(math.nextafter(v, -math.inf), at[0] / last)
            if at[-1] < last or len(ties) == 1:
                points.setdefault(math.nextafter(v, math.inf), at[-1] / last)
    return sorted(points.items())


class QuantileTransform(_SqlStage):
    """Values to their place between stored quantiles (uniform), optionally on to normal scores.

    The knots of a column are the boundaries of an isotonic model, which finds a value's stretch by binary search
    and interpolates; the SQL around it does not grow with them. A column without a number stays null.
    """

    def __init__(self, cols: Sequence[str], normal: bool = False, knots: int = 1000, parallelism: int = 8):
        super().__init__(cols)
        self.normal, self.knots, self.parallelism = normal, knots, parallelism

    def _fit(self, df: DataFrame) -> PipelineModel:
        m = max(2, min(self.knots, df.limit(self.knots).count()))
        found = _quantiles(df, self.cols, [i / (m - 1) for i in range(m)])
        raw, share = (lambda i: f"_value_{i}"), (lambda i: f"_share_{i}")

        def curve(i: int):
            points = df.sparkSession.createDataFrame(_share_points(found[self.cols[i]]), "value double, share double").coalesce(1)
            return IsotonicRegression(featuresCol="value", labelCol="share").fit(points).setFeaturesCol(raw(i)).setPredictionCol(share(i))

        have = [i for i, c in enumerate(self.cols) if found.get(c)]
        with ThreadPool(self.parallelism) as pool:
            curves = pool.map(inheritable_thread_target(df.sparkSession)(curve), have)
        place = {i: f"greatest(1e-7D, least(1 - 1e-7D, {share(i)}))" if self.normal else share(i) for i in have}
        if self.normal:  # the place is a column first: the inverse names it many times
            middle = [SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS {_q(f'_place_{i}')}" for i, e in place.items()) + " FROM __THIS__")] if have else []
            exprs = {c: inverse_normal_sql(_q(f"_place_{i}")) if i in have else _lit(None) for i, c in enumerate(self.cols)}
        else:
            middle, exprs = [], {c: place.get(i, _lit(None)) for i, c in enumerate(self.cols)}
        helpers = [name(i) for i in have for name in (raw, share, *([lambda j: f"_place_{j}"] if self.normal else []))]
        gone = ", ".join(map(_q, [*self.cols, *helpers]))
        news = ", ".join(f"{e} AS {_q(c)}" for c, e in exprs.items())
        # Binary search tells -0.0 from 0.0; the sum does not.
        first = [_append({raw(i): f"CAST({_q(self.cols[i])} AS DOUBLE) + 0D" for i in have})] if have else []
        return PipelineModel([*first, *curves, *middle, SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {news} FROM __THIS__")])


# ------------------------------------------------------------------ row-wise and basis expansions


def normalizer(cols: Sequence[str], norm: str) -> SQLTransformer:
    """Rows scaled to unit l1, l2 or largest absolute value; all-zero rows stay."""
    terms = [f"abs({_q(c)})" for c in cols]
    if norm == "l1":
        size = " + ".join(terms)
    elif norm == "l2":
        size = "sqrt(" + " + ".join(f"{_q(c)} * {_q(c)}" for c in cols) + ")"
    elif norm == "max":
        size = f"greatest({', '.join(terms)})" if len(terms) > 1 else terms[0]
    else:
        raise ValueError(f"unknown normalization {norm}")
    return _replace({c: f"{_q(c)} / coalesce(nullif({size}, 0D), 1D)" for c in cols})


def polynomial_terms(cols: Sequence[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> dict[str, str]:
    """Names and SQL of all products up to the degree; single columns keep their names and are not listed."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = {"bias": "1D"} if bias else {}
    for d in range(2, degree + 1):
        for chosen in pick(cols, d):
            terms["*".join(chosen)] = " * ".join(_q(c) for c in chosen)
    return terms


def polynomial(cols: Sequence[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> SQLTransformer | None:
    terms = polynomial_terms(cols, degree, interaction_only, bias)
    return _append(terms) if terms else None


class SplineBasis(_SqlStage):
    """B-spline basis on evenly spaced knots between min and max; constant outside."""

    def __init__(self, cols: Sequence[str], knots: int = 5, degree: int = 3):
        super().__init__(cols)
        self.knots, self.degree = knots, degree

    def outputs(self) -> list[str]:
        return [f"{c}_sp{j}" for c in self.cols for j in range(self.knots + self.degree - 1)]

    def _fit(self, df: DataFrame) -> SQLTransformer:
        found = _facts(df, self.cols, lo=F.min, hi=F.max)
        d = self.degree
        exprs = {}
        for c in self.cols:
            lo, hi = found[c]["lo"], found[c]["hi"]
            step = (hi - lo) / (self.knots - 1) or 1.0
            inside = f"greatest({_lit(lo)}, least({_lit(hi)}, CAST({_q(c)} AS DOUBLE)))"
            for j in range(self.knots + d - 1):
                u = f"(({inside} - {_lit(lo)}) / {_lit(step)} - {_lit(float(j - d))})"
                terms = [f"{_lit((-1.0) ** k * math.comb(d + 1, k) / math.factorial(d))} * power(greatest({u} - {k}, 0D), {d})" for k in range(d + 2)]
                exprs[f"{c}_sp{j}"] = f"CASE WHEN {_q(c)} IS NOT NULL THEN " + " + ".join(terms) + " END"
        return _append(exprs)


class CategoryEncoder(_SqlStage):
    """onehot (unknown text is all zero, first category may be dropped) or ordinal (unknown is -1).

    The categories have to be known when the output columns are named, so they are given or read once.
    """

    def __init__(self, cols: Sequence[str], kind: str, categories: Mapping[str, Sequence[str]], drop_first: bool = False):
        super().__init__(cols)
        self.kind, self.categories, self.drop_first = kind, {c: sorted(v) for c, v in categories.items()}, drop_first

    def outputs(self) -> list[str]:
        if self.kind == "ordinal":
            return [f"{c}_code" for c in self.cols]
        return [f"{c}={v}" for c in self.cols for v in self.categories[c][1 if self.drop_first else 0 :]]

    def _fit(self, df: DataFrame) -> SQLTransformer:
        present = {}
        for c in self.cols:  # as many as were given, however many values the column has
            given = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(self.categories[c])], "v string")
            values = df.select(F.col(_q(c)).cast("string").alias("v")).distinct()
            present[c] = {r[0] for r in given.join(values, "v", "left_semi").collect()}
        exprs = {}
        for c in self.cols:
            seen = [v for v in self.categories[c] if v in present[c]]
            text = f"CAST({_q(c)} AS STRING)"
            if self.kind == "ordinal":
                cases = " ".join(f"WHEN {text} = {_lit(v)} THEN {float(i)}D" for i, v in enumerate(seen))
                exprs[f"{c}_code"] = f"CASE {cases} ELSE -1D END" if seen else "-1D"
            else:
                for v in self.categories[c][1 if self.drop_first else 0 :]:
                    exprs[f"{c}={v}"] = f"CASE WHEN {text} = {_lit(v)} THEN 1D ELSE 0D END" if v in seen else "0D"
        return _append(exprs)


def categories_of(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Distinct texts of each column, refused beyond a fixed number."""
    found = {}
    for c in cols:
        values = [r[0] for r in df.select(F.col(_q(c)).cast("string")).where(F.col(_q(c)).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()]
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
        found[c] = sorted(values)
    return found


def impute_median(cols):
    return MedianImputer(cols)


def scaler(kind: str, cols):
    return None if kind == "none" else Scaler(cols, kind)


def power(kind: str, cols):
    if kind == "none":
        return None
    if kind in ("yeo-johnson", "box-cox"):
        return PowerTransform(cols, kind)
    if kind in ("quantile_uniform", "quantile_normal"):
        return QuantileTransform(cols, kind.endswith("normal"))
    raise ValueError(f"unknown power_transform {kind}")


def spline(cols, knots: int = 5, degree: int = 3):
    return SplineBasis(cols, knots, degree)


def encoder(kind: str, cols, categories, drop_first: bool = False):
    if kind not in ("onehot", "ordinal"):
        raise ValueError(f"unknown categorical_encoding {kind}")
    return CategoryEncoder(cols, kind, categories, drop_first)


def build_preprocessor(
    config: Mapping[str, object], features: Sequence[str], df: DataFrame | None = None, impute: bool = False
) -> tuple[list, list[str]]:
    """Unfitted stages in order, and the names of the columns that feed the model.

    Order: imputation, power transform, scaling, normalization, polynomial, spline; categories last.
    ``df`` is read only to list the categories of categorical columns.
    """
    from pyspark.ml.feature import VectorAssembler

    categorical = [c for c in config.get("categorical_columns", []) or [] if config.get("categorical_encoding")]
    numeric = list(config.get("numeric_columns", []) or [f for f in features if f not in categorical])
    if categorical and not config.get("numeric_columns"):
        raise ValueError("list the numeric columns too: some features are encoded as categories")
    stages: list = [impute_median(numeric)] if impute else []
    stages.append(power(str(config.get("power_transform", "none")).lower(), numeric))
    stages.append(scaler(str(config.get("scaling", "standard")).lower(), numeric))
    norm = str(config.get("normalization", "none")).lower()
    stages.append(None if norm == "none" else normalizer(numeric, norm))
    out = list(numeric)
    if config.get("polynomial_features"):
        how = (int(config.get("poly_degree", 2)), bool(config.get("poly_interaction_only", False)), bool(config.get("poly_include_bias", False)))
        stages.append(polynomial(numeric, *how))
        out += list(polynomial_terms(numeric, *how))
    if config.get("spline_features"):
        basis = spline(out, int(config.get("spline_n_knots", 5)), int(config.get("spline_degree", 3)))
        stages.append(basis)
        out = basis.outputs()
    if categorical:
        coded = encoder(str(config["categorical_encoding"]).lower(), categorical, categories_of(df, categorical), bool(config.get("drop_first", False)))
        stages.append(coded)
        out = out + coded.outputs()
        if not config.get("drop_remainder", True):
            out += [f for f in features if f not in numeric and f not in categorical]
    stages = [s for s in stages if s is not None]
    return [*stages, VectorAssembler(inputCols=out, outputCol="features", handleInvalid="error")], out

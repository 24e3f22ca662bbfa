"""The normal distribution as column expressions (JVM) and as numpy functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

# Coefficients of algorithm AS 241 (inverse normal), highest power first.
AS241 = {
    "centre": (
        (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
        (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
    ),
    "middle": (
        (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
        (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
    ),
    "tail": (
        (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
    ),
}

# Cody's rational approximations of erf (up to 0.46875) and erfc (up to 4, beyond 4), highest power first.
CODY = {
    "erf": (
        (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
        (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
    ),
    "middle": (
        (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
         1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
        (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
         4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
    ),
    "tail": (
        (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
        (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
    ),
}


def _ratio(table: tuple[Sequence[float], Sequence[float]], x):
    """Quotient of two polynomials; ``x`` may be a column, an array or SQL text."""
    above, below = (_horner(part, x) for part in table)
    return f"{above} / {below}" if isinstance(x, str) else above / below


def _horner(coefficients: Sequence[float], x):
    if isinstance(x, str):
        out = f"{coefficients[0]!r}D"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r}D)"
        return out
    out = x * coefficients[0] + coefficients[1]
    for c in coefficients[2:]:
        out = out * x + c
    return out


def norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution, accurate far out; NULL for NULL.

    ``z`` stands in the result many times: pass a plain column, not a long expression.
    """
    a = F.abs(z) / math.sqrt(2.0)
    square = z * z / 2.0
    small = F.lit(1.0) - a * _ratio(CODY["erf"], square)
    middle = F.exp(-square) * _ratio(CODY["middle"], a)
    inverse = F.lit(1.0) / square
    tail = F.exp(-square) / a * (F.lit(1.0 / math.sqrt(math.pi)) - inverse * _ratio(CODY["tail"], inverse))
    half = F.when(a <= 0.46875, small).when(a <= 4.0, middle).when(a <= 27.0, tail).otherwise(F.lit(0.0)) / 2.0
    return F.when(z.isNotNull(), F.when(z < 0, F.lit(1.0) - half).otherwise(half))


def norm_cdf(z: Column) -> Column:
    return norm_sf(-z)


def tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper tail of an array: the values of ``norm_cdf`` and ``norm_sf``; both 0 for NaN."""
    z = np.asarray(z, dtype=float)
    a, square, half = np.abs(z) / math.sqrt(2.0), z * z / 2.0, np.zeros(len(z))
    with np.errstate(all="ignore"):
        at = np.flatnonzero(a <= 0.46875)
        half[at] = 1.0 - a[at] * _ratio(CODY["erf"], square[at])
        at = np.flatnonzero((a > 0.46875) & (a <= 4.0))
        half[at] = np.exp(-square[at]) * _ratio(CODY["middle"], a[at])
        at = np.flatnonzero((a > 4.0) & (a <= 27.0))
        turned = 1.0 / square[at]
        half[at] = np.exp(-square[at]) / a[at] * (1.0 / math.sqrt(math.pi) - turned * _ratio(CODY["tail"], turned))
        half /= 2.0
        return np.where(z > 0, 1.0 - half, half), np.where(z < 0, 1.0 - half, half)


def inverse_normal_sql(p: str) -> str:
    """SQL text of the inverse normal distribution function for 0 < p < 1."""
    q = f"({p} - 0.5D)"
    centre = f"(0.180625D - {q} * {q})"
    tail = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    outer = f"CASE WHEN {tail} <= 5 THEN {_ratio(AS241['middle'], f'({tail} - 1.6D)')} ELSE {_ratio(AS241['tail'], f'({tail} - 5D)')} END"
    return f"CASE WHEN abs({q}) <= 0.425D THEN {q} * {_ratio(AS241['centre'], centre)} ELSE sign({q}) * ({outer}) END"


def norm_ppf(name: str) -> Column:
    """Inverse normal of the named column; NULL outside of (0, 1)."""
    return F.expr(f"CASE WHEN `{name}` > 0D AND `{name}` < 1D THEN {inverse_normal_sql(f'`{name}`')} END")


def inverse(p: np.ndarray) -> np.ndarray:
    """Inverse normal of an array; NaN outside of (0, 1)."""
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    with np.errstate(all="ignore"):
        near = q * _ratio(AS241["centre"], 0.180625 - q * q)
        r = np.sqrt(-np.log(np.where(q < 0, p, 1.0 - p)))
        far = np.where(r <= 5.0, _ratio(AS241["middle"], r - 1.6), _ratio(AS241["tail"], r - 5.0))
        out = np.where(np.abs(q) <= 0.425, near, np.sign(q) * far)
    return np.where((p > 0) & (p < 1), out, np.nan)

"""Distribution functions for small result tables, and sums of normal scores for columns.

The p-values are needed for a handful of rows (one per feature), after Spark has reduced the data.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from studyframe.functions.normal import inverse, tails

# ------------------------------------------------------------------ sums of normal scores

# Ranks summed one by one at each end of a long run of ranks.
RUN_EDGE = 2048


def _score_at(rank: np.ndarray, n: float, shift: float, extra: float) -> np.ndarray:
    return inverse((rank - shift) / (n + extra))


def normal_score_sum(first: int, last: int, n: int, shift: float, extra: float, power: int = 1) -> float:
    """Sum over ranks first..last of z(rank) ** power, z(i) = inverse normal of (i - shift) / (n + extra).

    Long runs (one value that repeats very often, or all ranks) are summed directly at both ends and by
    the midpoint Euler-Maclaurin formula between, whose error is far below double precision there.
    """
    if last - first + 1 <= 4 * RUN_EDGE:
        return float(np.sum(_score_at(np.arange(first, last + 1, dtype=float), n, shift, extra) ** power))
    low, high = first + RUN_EDGE, last - RUN_EDGE
    ends = normal_score_sum(first, low - 1, n, shift, extra, power) + normal_score_sum(high + 1, last, n, shift, extra, power)
    width = 1.0 / (n + extra)
    p0, p1 = (low - shift - 0.5) * width, (high - shift + 0.5) * width
    z0, z1 = NormalDist().inv_cdf(p0), NormalDist().inv_cdf(p1)
    d0, d1 = NormalDist().pdf(z0), NormalDist().pdf(z1)
    if power == 1:
        area, slope = d0 - d1, 1.0 / d1 - 1.0 / d0
    else:
        area, slope = (p1 - z1 * d1) - (p0 - z0 * d0), 2.0 * z1 / d1 - 2.0 * z0 / d0
    return ends + area / width - width / 24.0 * slope


# Ranks that one step of ``run_score_sums`` holds, unless a single run is longer.
STEP_RANKS = 1 << 20


def run_score_sums(before: np.ndarray, cnt: np.ndarray, n: np.ndarray, shift: float, extra: float) -> np.ndarray:
    """Sum of the normal scores of the ranks before+1 .. before+cnt, for many runs of ranks at once."""
    out = np.empty(len(before))
    long = cnt > 4 * RUN_EDGE
    for i in np.flatnonzero(long):
        out[i] = normal_score_sum(int(before[i]) + 1, int(before[i] + cnt[i]), int(n[i]), shift, extra)
    short = np.flatnonzero(~long)
    steps = np.cumsum(cnt[short]) // STEP_RANKS
    for at in np.split(short, np.flatnonzero(np.diff(steps)) + 1) if len(short) else ():
        sizes = cnt[at]
        starts = np.cumsum(sizes) - sizes
        ranks = np.arange(int(sizes.sum())) - np.repeat(starts - before[at], sizes) + 1.0
        out[at] = np.add.reduceat(_score_at(ranks, np.repeat(n[at], sizes).astype(float), shift, extra), starts)
    return out


def score_sum_udf(shift: float, extra: float):
    """Arrow function (before, cnt, n) -> sum of the normal scores of the tied ranks."""

    @F.pandas_udf(T.DoubleType())
    def score_sum(before: pd.Series, cnt: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(run_score_sums(*(s.to_numpy(dtype=np.int64) for s in (before, cnt, n)), shift, extra))

    return score_sum


def ad_term_udf(clip: float = 0.0):
    """Arrow function (z, before, cnt, n) -> the part of the A² sum of the tied ranks; NULL where a tail is 0.

    Ties enter through closed sums of odd numbers. Tails are held ``clip`` away from 0 and 1, if it is given.
    """

    @F.pandas_udf(T.DoubleType())
    def ad_term(z: pd.Series, before: pd.Series, cnt: pd.Series, n: pd.Series) -> pd.Series:
        b, c, n = (s.to_numpy(dtype=float) for s in (before, cnt, n))
        lower, upper = tails(z.to_numpy(dtype=float))
        if clip:
            lower = np.clip(lower, clip, 1.0 - clip)
            upper = 1.0 - lower
        up, down = (b + c) * (b + c) - b * b, (n - b) * (n - b) - (n - b - c) * (n - b - c)
        with np.errstate(all="ignore"):
            term = up * np.log(lower) + down * np.log(upper)
        return pd.Series(np.where((lower > 0) & (upper > 0), term, np.nan))

    return ad_term


def shapiro_from_sums(n: int, score_sum: float, ends: tuple[float, float, float, float], ssq: float) -> tuple[float | None, float | None]:
    """W and p (Royston 1995) from sum(m_i * x_i), the two lowest and two highest values, and the sum of squares.

    The values must be centred.
    """
    if n < 3 or not ssq > 0:
        return None, None
    x1, x2, x3, x4 = ends
    if n == 3:
        w = min(1.0, (math.sqrt(0.5) * (x4 - x1)) ** 2 / ssq)
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    score = lambda rank: NormalDist().inv_cdf((rank - 0.375) / (n + 0.25))
    ssm = normal_score_sum(1, n, n, 0.375, 0.25, 2)
    m_n, m_n1 = score(n), score(n - 1)
    u = 1.0 / math.sqrt(n)
    # Published polynomial coefficients.
    a_n = m_n / math.sqrt(ssm) + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - 2.706056 * u))))
    a_n1 = m_n1 / math.sqrt(ssm) + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u))))
    if n > 5:
        phi = (ssm - 2 * m_n**2 - 2 * m_n1**2) / (1 - 2 * a_n**2 - 2 * a_n1**2)
        inner = score_sum - m_n * (x4 - x1) - m_n1 * (x3 - x2)
        total = inner / math.sqrt(phi) + a_n * (x4 - x1) + a_n1 * (x3 - x2)
    else:
        phi = (ssm - 2 * m_n**2) / (1 - 2 * a_n**2)
        total = (score_sum - m_n * (x4 - x1)) / math.sqrt(phi) + a_n * (x4 - x1)
    w = min(1.0, total * total / ssq)
    if w >= 1.0:
        return 1.0, 1.0
    ln = math.log(n)
    if n >= 12:
        mu = -1.5861 + ln * (-0.31082 + ln * (-0.083751 + 0.0038915 * ln))
        sigma = math.exp(-0.4803 + ln * (-0.082676 + 0.0030302 * ln))
        y = math.log1p(-w)
    else:
        gamma = -2.273 + 0.459 * n
        if math.log1p(-w) >= gamma:
            return w, 1e-99
        mu = 0.5440 + n * (-0.39978 + n * (0.025054 - 0.0006714 * n))
        sigma = math.exp(1.3822 + n * (-0.77857 + n * (0.062767 - 0.0020322 * n)))
        y = -math.log(gamma - math.log1p(-w))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2.0))


def mwu_exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties, for one small sample."""
    small, large = min(n1, n2), max(n1, n2)
    ways = np.zeros((small + 1, small * large + 1))
    ways[0, 0] = 1.0
    for value in range(1, small + large + 1):
        for size in range(min(value, small), 0, -1):
            # ``value`` is the rank of the size-th chosen element; its contribution to U is value - size.
            shift = value - size
            if 0 <= shift <= large:
                ways[size, shift:] += ways[size - 1, : ways.shape[1] - shift]
    share = ways[small] / ways[small].sum()
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2.0 * share[math.ceil(top - 1e-9):].sum()))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    result, c, d = 1.0, 1.0, 0.0
    for step in range(0, 1000):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / (c if abs(c) > tiny else tiny)
        change = c * d
        result *= change
        if step and abs(change - 1.0) < 1e-16:
            break
    return scale * (result - 1.0)


def f_sf(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if not math.isfinite(f) or f < 0:
        return float("nan")
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2.0, x / 2.0)

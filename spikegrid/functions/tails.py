"""Tail probabilities for small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta of {a}, {b} at {x} did not converge")


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value of Student's t."""
    return pd.Series([incomplete_beta(n / 2, 0.5, n / (n + v * v)) if v == v and n == n and n > 0 else None for v, n in zip(t, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) if v == v else None for v in z], dtype=float)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum over the tables with these margins that are no likelier than this one.

    Probabilities rise to the mode and fall after it, so the sum has two tails: each is
    walked outwards by ratios of neighbours until its terms no longer count; where the
    other tail begins is found by halving."""
    r, s, n = a + b, a + c, a + b + c + d
    low, high = max(0, r + s - n), min(r, s)
    lf = lambda k: math.lgamma(k + 1)
    logp = lambda k: lf(s) - lf(k) - lf(s - k) + lf(n - s) - lf(r - k) - lf(n - s - r + k) - lf(n) + lf(r) + lf(n - r)
    up = lambda k: (s - k) * (r - k) / ((k + 1) * (n - s - r + k + 1))       # p(k + 1) / p(k)

    def tail(k: int, step: int) -> float:
        if not low <= k <= high:
            return 0.0
        term = total = 1.0
        start = math.exp(logp(k))
        while low <= k + step <= high and term > 1e-18 * total:
            term *= up(k) if step > 0 else 1 / up(k - 1)
            total += term
            k += step
        return start * total

    mode = min(high, max(low, (r + 1) * (s + 1) // (n + 2)))
    seen = logp(a) + 1e-7
    if a == mode or logp(mode) <= seen:
        return 1.0
    step = 1 if a < mode else -1
    # the nearest table beyond the mode that is no likelier
    near, far = mode, (high + 1 if step > 0 else low - 1)
    while abs(far - near) > 1:
        middle = (near + far) // 2
        near, far = (near, middle) if logp(middle) <= seen else (middle, far)
    return min(1.0, tail(a, -step) + tail(far, step))


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher test of a 2 x 2 table: tables no likelier than the observed one."""
    return pd.Series([fisher_two_sided(*map(int, v)) for v in zip(a, b, c, d)], dtype=float)

"""Column expressions shared by the operators (all stay in code generation)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Extent:
    """Arena limits; numbers, or columns when limits differ per session."""

    x_lo: float | Column
    x_hi: float | Column
    y_lo: float | Column
    y_hi: float | Column

    @staticmethod
    def centred(width: float, height: float) -> "Extent":
        return Extent(-width / 2, width / 2, -height / 2, height / 2)


def nearest_node(value, lo, hi, n: int) -> Column:
    """Index of the nearest of ``n`` evenly spaced nodes, ties to the lower index."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    step = (hi - lo) / F.lit(float(n - 1))
    raw = F.ceil((_c(value) - lo) / step - F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(raw, F.lit(0)))).cast("int")


def grid_row(y, ext: Extent, n: int) -> Column:
    """Rows count downwards from the top edge."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (ext.y_lo, ext.y_hi))
    return nearest_node(hi - _c(y), F.lit(0.0), hi - lo, n)


def grid_row_upward_span(y, ext: Extent, n: int) -> Column:
    """Compatibility form of spike rows: the row axis spans the x range."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (ext.x_lo, ext.x_hi))
    return nearest_node(hi - _c(y), F.lit(0.0), hi - lo, n)


def grid_col(x, ext: Extent, n: int) -> Column:
    return nearest_node(x, ext.x_lo, ext.x_hi, n)


def grid_col_yspan(x, ext: Extent, n: int) -> Column:
    """Compatibility form of spike columns: the column axis spans the y range."""
    return nearest_node(x, ext.y_lo, ext.y_hi, n)


def wrap_angle(a) -> Column:
    """Angle folded to [0, 2 pi)."""
    return F.pmod(_c(a), F.lit(TWO_PI))


def circular_distance(a, b) -> Column:
    d = _c(a) - _c(b)
    return F.atan2(F.sin(d), F.cos(d))


def hypot2(dx, dy) -> Column:
    dx, dy = _c(dx), _c(dy)
    return F.sqrt(dx * dx + dy * dy)


def safe_div(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(b != 0, a / b)


def safe_corr(a, b) -> Column:
    """Pearson correlation as an aggregate; null without spread on both sides."""
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def signed_log(x) -> Column:
    x = _c(x)
    return F.signum(x) * F.log1p(F.abs(x))


def chi2_survival_even(m, df: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom."""
    if df % 2:
        raise ValueError("df must be even (two features per channel)")
    half = _c(m) / 2
    total: Column = F.lit(1.0)
    for k in range(1, df // 2):
        total = total + F.pow(half, F.lit(k)) / F.lit(float(math.factorial(k)))
    return F.exp(-half) * total


def bin_of(value, lo, width) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    width = width if isinstance(width, Column) else F.lit(float(width))
    return F.floor((_c(value) - lo) / width)


def bin_count(length: float, width: float) -> int:
    """Number of bins of ``width`` that cover ``length``."""
    return math.ceil(length / width)


def resize_shape(height: float, width: float, base: int = 64) -> tuple[int, int]:
    """Rows and columns of a map whose longest side has ``base`` bins."""
    if height > width:
        return base, math.ceil(base * width / height)
    return math.ceil(base * height / width), base


def vector_length(dx, dy) -> Column:
    return hypot2(dx, dy)


def signed_angle(ax, ay, bx, by) -> Column:
    """Angle from vector a to vector b."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def array_mean(a) -> Column:
    a = _c(a)
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def root_energy(a) -> Column:
    """Waveform energy: root of summed squares over the root of the length."""
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)) / F.sqrt(F.size(a))


def array_moment(a, mean: Column, k: int) -> Column:
    a = _c(a)
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(k))) / F.size(a)


def differences(a) -> Column:
    """Central differences with one-sided ends (unit spacing)."""
    a = _c(a)
    n = F.size(a)

    def at(i):
        return F.element_at(a, i)

    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(i == 1, at(F.lit(2)) - at(F.lit(1)))
        .when(i == n, at(n) - at(n - 1))
        .otherwise((at(F.least(i + 1, n)) - at(F.greatest(i - 1, F.lit(1)))) / 2),
    )


def first_matching(cases: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    out = F.lit(None) if default is None else default
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def zscore(x, mean, sd) -> Column:
    return safe_div(_c(x) - _c(mean), _c(sd))


def modified_zscore(x, median, mad) -> Column:
    """0.6745 (x - median) / MAD with a MAD of zero taken as one."""
    mad = _c(mad)
    return F.lit(0.6745) * (_c(x) - _c(median)) / F.when(mad == 0, F.lit(1.0)).otherwise(mad)


def hash_uniform(*cols, seed: int = 0) -> Column:
    """Uniform [0, 1) number fixed by the row's own key, so a retried task repeats it."""
    h = F.xxhash64(*[_c(c) for c in cols], F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def digest_number(*cols, seed: int = 0) -> Column:
    """A whole number of 52 bits from a digest of the row's key, the same on any engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

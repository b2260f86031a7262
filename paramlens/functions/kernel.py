"""Distribution functions and tests that Spark lacks, for small result tables.

Plain scalars; ``column`` lifts one over Arrow batches of result rows. Facts never pass here.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
_TINY = 1e-300


def beta_inc(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by the modified Lentz method."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / _lentz(x, a, b)


def _lentz(x: float, a: float, b: float) -> float:
    """1 + d1/(1 + d2/(1 + ...)), the denominator of the continued fraction."""
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1, 2000):
        m = i // 2
        if i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + step / c
        c = c if abs(c) > _TINY else _TINY
        value *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return value


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, d = x + 1 - a, 1 / (x + 1 - a)
    c, h = 1 / _TINY, d
    for i in range(1, 2000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b if abs(n * d + b) > _TINY else _TINY)
        c = b + n / c
        c = c if abs(c) > _TINY else _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def f_survival(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or not d1 > 0 or not d2 > 0:
        return math.nan
    if f <= 0:
        return 1.0
    return 0.0 if math.isinf(f) else beta_inc(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_survival(x: float, k: float) -> float:
    if math.isnan(x) or not k > 0:
        return math.nan
    return gamma_q(k / 2, x / 2) if x > 0 else 1.0


def t_cdf(t: float, df: float) -> float:
    tail = beta_inc(df / (df + t * t), df / 2, 0.5) / 2
    return tail if t < 0 else 1 - tail


def t_inv(p: float, df: float) -> float:
    """By bisection."""
    if not df > 0 or not 0 < p < 1:
        return math.nan
    hi = 1.0
    while t_cdf(hi, df) < max(p, 1 - p):
        hi *= 2
    lo = 0.0
    while hi - lo > 1e-12 * max(1.0, hi):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < max(p, 1 - p) else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def norm_inv(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.nan


def norm_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def z_p(z: float) -> float:
    """Two-sided."""
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def expected_max_z(n: float) -> float:
    """The expected largest of n standard normal draws."""
    if not n >= 2:
        return math.nan
    euler = 0.5772156649015329
    return (1 - euler) * norm_inv(1 - 1 / n) + euler * norm_inv(1 - 1 / (n * math.e))


def wilson(k: float, n: float) -> tuple[float, float]:
    if not n > 0:
        return math.nan, math.nan
    p, z2 = k / n, Z95 * Z95
    mid, half = p + z2 / (2 * n), Z95 * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return max(0.0, (mid - half) / (1 + z2 / n)), min(1.0, (mid + half) / (1 + z2 / n))


def bh(p: list[float]) -> list[float]:
    """Benjamini-Hochberg; values that aren't finite take no part."""
    p = np.asarray(p, dtype=float)
    out, use = np.full(len(p), math.nan), np.flatnonzero(np.isfinite(p))
    order = use[np.argsort(p[use], kind="stable")]
    scaled = p[order] * len(order) / np.arange(1, len(order) + 1)
    out[order] = np.minimum(1.0, np.minimum.accumulate(scaled[::-1])[::-1])
    return out.tolist()


def column(function: Callable[..., float], *args: Column) -> Column:
    """The function applied to rows of doubles; null where an argument is null or the result isn't a number."""

    @F.pandas_udf("double")
    def lifted(*values: pd.Series) -> pd.Series:
        rows = zip(*(v.astype(float) for v in values))
        out = [math.nan if any(math.isnan(x) for x in row) else function(*row) for row in rows]
        return pd.Series([None if math.isnan(x) else x for x in out], dtype="float64")

    return F.nanvl(lifted(*[a.cast("double") for a in args]), F.lit(None))

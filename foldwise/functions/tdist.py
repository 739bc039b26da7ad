"""Student's t for any degrees of freedom, at a cost that hardly depends on them.

The distribution function is a regularised incomplete beta function, summed as a continued fraction on the side
where it converges fast. Quantiles follow by Newton steps from the normal one. Both run on summary rows, one per
comparison, in batches.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or _TINY)
            c = 1.0 + step / c or _TINY
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def _log_beta_half(a: float) -> float:
    """log B(a, 1/2); by an asymptotic series where the difference of log-gammas would cancel."""
    if a < 1e4:
        return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    return 0.5 * math.log(math.pi) - 0.5 * math.log(a) + 1 / (8 * a) - 1 / (192 * a**3)


def upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    a, y = df / 2, t * t / (df + t * t)  # y = 1 - x
    if y == 0:
        return 0.5
    if y >= 1:
        return 0.0
    front = math.exp(a * math.log1p(-y) + 0.5 * math.log(y) - _log_beta_half(a))
    if 1 - y < (a + 1) / (a + 2.5):
        return 0.5 * front * _fraction(a, 0.5, 1 - y) / a
    return 0.5 - front * _fraction(0.5, a, y)


def cdf(t: float, df: float) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    tail = upper_tail(abs(t), df)
    return min(1.0, max(0.0, 1 - tail if t >= 0 else tail))


def quantile(p: float, df: float) -> float | None:
    """Upper quantile (p > 0.5)."""
    if df is None or math.isnan(df) or df < 1:
        return None
    low, high, t = 0.0, math.inf, NormalDist().inv_cdf(p)
    for _ in range(200):
        over = upper_tail(t, df) - (1 - p)
        low, high = (t, high) if over > 0 else (low, t)
        density = math.exp(-(df + 1) / 2 * math.log1p(t * t / df) - 0.5 * math.log(df) - _log_beta_half(df / 2))
        new = t + over / density if density > 0 else math.inf
        if not low < new < high:
            new = (low + high) / 2 if high < math.inf else 2 * t + 1
        if abs(new - t) <= 1e-15 * max(1.0, abs(t)):
            return new
        t = new
    return t


def t_cdf(t: Column, df: Column) -> Column:
    """P(T <= t)."""

    @F.pandas_udf("double")
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([cdf(a, b) for a, b in zip(ts, dfs)], dtype="float64")

    return run(t.cast("double"), df.cast("double"))


def t_quantile(p: float, df: Column) -> Column:
    """Upper quantile (p > 0.5); NULL below one degree of freedom."""

    @F.pandas_udf("double")
    def run(dfs: pd.Series) -> pd.Series:
        known = {d: quantile(p, d) for d in set(dfs.dropna())}
        return pd.Series([known.get(d) for d in dfs], dtype="float64")

    return run(df.cast("double"))

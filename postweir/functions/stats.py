"""Exact binomial test. It runs on one row per group, after the data were aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = 4096
_TIE = math.log1p(1e-7)  # fixed value: outcomes this little more likely than the observed one count as equally likely


def _stirling_rest(k: float) -> float:
    """log k! minus Stirling's formula."""
    if k == 0:
        return 0.0
    if k < 30:
        return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - 1 / (1260 * k * k)) / (k * k)) / k


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x"""
    if x == 0:
        return mean
    return x * math.log1p((x - mean) / mean) + mean - x


def _log_pmf(k: int, n: int, p: float) -> float:
    if k == 0:
        return n * math.log1p(-p)
    if k == n:
        return n * math.log(p)
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k)
    spread = 0.5 * math.log(n / (2 * math.pi * k * (n - k)))
    return spread + rest - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))


def _at_least(k: int, n: int, p: float) -> float:
    """P(X >= k): terms are summed away from the mean until they no longer matter."""
    if k <= 0:
        return 1.0
    if k > n or p == 0:
        return 0.0
    if p == 1:
        return 1.0
    if k < n * p:
        return 1.0 - _at_least(n - k + 1, n, 1 - p)
    total, term, at = 1.0, 1.0, k
    while at < n and term > total * 1e-17:
        j = np.arange(at, min(at + _CHUNK, n), dtype=float)
        terms = term * np.cumprod((n - j) / (j + 1) * (p / (1 - p)))
        total, term, at = total + float(terms.sum()), float(terms[-1]), at + len(j)
    return min(1.0, math.exp(_log_pmf(k, n, p)) * total)


def _first_rarer(low: int, high: int, limit: float, n: int, p: float) -> int:
    """Smallest i in [low, high] whose log probability is at most `limit`, high + 1 if none; falls along i."""
    high += 1
    while low < high:
        middle = (low + high) // 2
        if _log_pmf(middle, n, p) <= limit:
            high = middle
        else:
            low = middle + 1
    return low


def binomial_p_value(x: int, n: int, p: float, alternative: str = "two-sided") -> float:
    if alternative == "greater":
        return _at_least(x, n, p)
    if p in (0.0, 1.0):
        return 1.0 if x == n * p else 0.0
    if x == n * p:
        return 1.0
    if x > n * p:
        x, p = n - x, 1 - p
    cut = _first_rarer(math.ceil(n * p), n, _log_pmf(x, n, p) + _TIE, n, p)
    return min(1.0, _at_least(n - x, n, 1 - p) + _at_least(cut, n, p))


def binomial_test(x: Column, n: Column, p: Column, alternative: str = "two-sided") -> Column:
    """p-value of x successes in n trials against probability p; 'two-sided' or 'greater'."""
    if alternative not in ("two-sided", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}")

    @F.pandas_udf(T.DoubleType())
    def p_value(xs: pd.Series, ns: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([
            binomial_p_value(int(a), int(b), float(c), alternative) if b > 0 else None for a, b, c in zip(xs, ns, ps)
        ], dtype="float64")

    return p_value(x.cast("bigint"), n.cast("bigint"), p.cast("double"))

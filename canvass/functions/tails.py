"""Tail probabilities of the chi-square, F and t distributions.

They are applied only to already-aggregated statistics (one row per tested
variable), through Arrow-batched pandas UDFs. SciPy is not available, so the
regularized incomplete gamma and beta functions are evaluated with the
standard series / continued-fraction expansions (Lentz's method).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-16
_TINY = 1e-300
_MAX_ITER = 10_000


def _gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        # series for P(a, x)
        term = total = 1.0 / a
        ap = a
        for _ in range(_MAX_ITER):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    # continued fraction for Q(a, x)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(log_front) * h


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_ITER):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_cf(b, a, 1.0 - x) / b


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return float("nan")
    return _gamma_q(dof / 2.0, x / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return _beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def pearson_p(r: float, n: float) -> float:
    """Two-sided p of Pearson's r with n pairs (t test on n - 2 dof)."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return float("nan")
    df = n - 2.0
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * df / (1.0 - r * r)
    return _beta_i(df / 2.0, 0.5, df / (df + t2))


def _nan_to_none(s: pd.Series) -> pd.Series:
    return s.astype("float64")


@F.pandas_udf(DoubleType())
def _chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _nan_to_none(pd.Series([chi2_sf(a, b) for a, b in zip(x, dof)]))


@F.pandas_udf(DoubleType())
def _f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _nan_to_none(pd.Series([f_sf(a, b, c) for a, b, c in zip(f, d1, d2)]))


@F.pandas_udf(DoubleType())
def _pearson_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return _nan_to_none(pd.Series([pearson_p(a, b) for a, b in zip(r, n)]))


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    return _chi2_sf_udf(stat.cast("double"), dof.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def pearson_pvalue(r: Column, n: Column) -> Column:
    return _pearson_p_udf(r.cast("double"), n.cast("double"))

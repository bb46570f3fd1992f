"""Tail probabilities for the test statistics (Student t, chi-square).

Vectorised NumPy implementations of the regularised incomplete beta and gamma
functions (continued fraction / series, as in standard numerical references).
They run inside an Arrow-batched pandas UDF on the per-feature result table
(one row per tested column), never on raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_EPS = 4e-16
_TINY = 1e-300


def _steps(a: float) -> int:
    """Both expansions settle within a multiple of sqrt(a) steps; far beyond it they have failed."""
    return 1000 + int(40 * math.sqrt(a))


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, _steps(max(a, b))):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            return h
    raise ArithmeticError(f"incomplete beta did not converge for a={a}, b={b}, x={x}")


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or not np.isfinite(t) or not np.isfinite(df) or df <= 0:
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def gammainc_upper_reg(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(_steps(a)):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * _EPS:
                return 1.0 - s * math.exp(-x + a * math.log(x) - gln)
        raise ArithmeticError(f"incomplete gamma did not converge for a={a}, x={x}")
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _steps(a)):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            return math.exp(-x + a * math.log(x) - gln) * h
    raise ArithmeticError(f"incomplete gamma did not converge for a={a}, x={x}")


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or not np.isfinite(x) or dof <= 0:
        return float("nan") if dof is None or dof < 0 else 1.0
    return gammainc_upper_reg(dof / 2.0, x / 2.0)


@pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t.astype(float), df.astype(float))])


@pandas_udf(DoubleType())
def _chi2_p_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x.astype(float), dof.astype(float))])


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p_udf(t, df)


def chi2_p_value(x: Column, dof: Column) -> Column:
    return _chi2_p_udf(x, dof)

"""Distribution functions in numpy, and as Arrow UDFs over columns. Scalars or arrays in, the same shape out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import ConfigError

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


# The published coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile(p):
    p = np.asarray(p, float)
    if np.any((p <= 0) | (p >= 1)):
        raise ConfigError("a probability lies strictly between 0 and 1")
    with np.errstate(all="ignore"):
        q = p - 0.5
        mid = np.polyval(_A, q * q) * q / np.polyval((*_B, 1.0), q * q)
        t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        tail = np.polyval(_C, t) / np.polyval((*_D, 1.0), t)
        return np.where(np.abs(q) <= 0.47575, mid, np.where(p < 0.5, tail, -tail))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 3e-12:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a+1, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_cdf(x, df):
    f = lambda x, v: (lambda p: p if x < 0 else 1 - p)(0.5 * beta_inc(v / 2, 0.5, v / (v + x * x)))
    return np.vectorize(f, otypes=[float])(x, df)


def chi2_cdf(x, df):
    return np.vectorize(lambda x, k: gamma_inc(k / 2, x / 2), otypes=[float])(x, df)


def f_cdf(x, d1, d2):
    return np.vectorize(lambda x, a, b: beta_inc(a / 2, b / 2, a * x / (a * x + b)) if x > 0 else 0.0, otypes=[float])(x, d1, d2)


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    while cdf(hi) < p:
        hi = hi * 2 if hi > 0 else 1.0
    while cdf(lo) > p:
        lo *= 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
        if hi - lo < 1e-13 * max(1, abs(mid)):
            break
    return 0.5 * (lo + hi)


def t_quantile(p, df):
    return np.vectorize(lambda p, v: _invert(lambda x: float(t_cdf(x, v)), p, -10.0, 10.0), otypes=[float])(p, df)


def chi2_quantile(p, df):
    return np.vectorize(lambda p, k: _invert(lambda x: gamma_inc(k / 2, x / 2), p, 0.0, k + 10.0), otypes=[float])(p, df)


# MacKinnon's response surfaces (limit, 1/n, 1/n^2) of the augmented Dickey-Fuller statistic.
ADF_SURFACE = {
    "none": {0.01: (-2.5658, -1.960, -10.04), 0.05: (-1.9393, -0.398, 0.0), 0.10: (-1.6156, -0.181, 0.0)},
    "constant": {0.01: (-3.4335, -5.999, -29.25), 0.05: (-2.8621, -2.738, -8.36), 0.10: (-2.5671, -1.438, -4.48)},
    "trend": {0.01: (-3.9638, -8.353, -47.44), 0.05: (-3.4126, -4.039, -17.83), 0.10: (-3.1279, -2.418, -7.58)},
}
# Critical values of the KPSS statistic.
KPSS_TABLE = {"level": {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}, "trend": {0.10: 0.119, 0.05: 0.146, 0.025: 0.176, 0.01: 0.216}}


def adf_critical(n: int, trend: str = "constant", alpha: float = 0.05) -> float:
    try:
        a, b, c = ADF_SURFACE[trend][alpha]
    except KeyError:
        raise ConfigError(f"no critical value for {trend}, {alpha}") from None
    return a + b / n + c / n**2


def kpss_critical(trend: str = "level", alpha: float = 0.05) -> float:
    try:
        return KPSS_TABLE[trend][alpha]
    except KeyError:
        raise ConfigError(f"no critical value for {trend}, {alpha}") from None


def _udf(fn, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series(fn(*[x.to_numpy(float) for x in xs]))

    return run(*cols)


def normal_cdf_col(x: Column) -> Column:
    return _udf(normal_cdf, x)


def t_cdf_col(x: Column, df: Column) -> Column:
    return _udf(t_cdf, x, df)


def chi2_cdf_col(x: Column, df: Column) -> Column:
    return _udf(chi2_cdf, x, df)


def f_cdf_col(x: Column, d1: Column, d2: Column) -> Column:
    return _udf(f_cdf, x, d1, d2)

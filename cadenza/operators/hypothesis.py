"""Normality tests of a series and its dependence measures, a row for each series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from cadenza.functions.dist import normal_cdf, normal_quantile
from cadenza.functions.numeric import hurst, pacf
from cadenza.operators.series import reduce_series
from cadenza.schema import KEYS, DataError

RESULT = "test string, statistic double, p_value double, rejected boolean"


def jarque_bera_np(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    if n < 8:
        raise DataError("eight values are needed")
    z = (x - x.mean()) / x.std(ddof=1)
    jb = n / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
    return float(jb), math.exp(-jb / 2)


def kolmogorov_np(x: np.ndarray) -> tuple[float, float]:
    """Against the normal law of the sample's own mean and deviation; asymptotic p-value."""
    n = len(x)
    f = normal_cdf((np.sort(x) - x.mean()) / x.std(ddof=1))
    i = np.arange(1, n + 1)
    d = float(max((i / n - f).max(), (f - (i - 1) / n).max()))
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)) if t > 0.2 else 1.0
    return d, min(1.0, max(0.0, p))


def shapiro_np(x: np.ndarray) -> tuple[float, float]:
    """W by Royston's approximation of the coefficients, for 3 to 5000 values."""
    n = len(x)
    if n < 3:
        raise DataError("three values are needed")
    # The coefficients of all polynomials below are Royston's.
    x = np.sort(x)
    m = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    ss = float(m @ m)
    u = 1 / math.sqrt(n)
    a = m / math.sqrt(ss)
    if n > 5:
        last = a[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
        prev = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, prev, -last, -prev
    d = x - x.mean()
    if not (d @ d) > 0:
        raise DataError("a constant series has no W")
    w = min(1.0, float(a @ x) ** 2 / float(d @ d))
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(g - math.log1p(-w + 1e-300) if w < 1 else 1e-300, 1e-300))
        mu, s = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, l = math.log(max(1 - w, 1e-300)), math.log(n)
        mu, s = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], l), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], l))
    return w, float(1 - normal_cdf((y - mu) / s))


def normality(df: DataFrame, test: str = "shapiro_wilk", alpha: float = 0.05, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """shapiro_wilk (beyond 5000 values Jarque-Bera, and named so), kolmogorov_smirnov or jarque_bera."""
    fns = {"shapiro_wilk": shapiro_np, "kolmogorov_smirnov": kolmogorov_np, "jarque_bera": jarque_bera_np}

    def run(t: np.ndarray, x: np.ndarray) -> dict:
        x = x[~np.isnan(x)]
        name = "jarque_bera" if test == "shapiro_wilk" and len(x) > 5000 else test
        s, p = fns[name](x)
        return {"test": name, "statistic": s, "p_value": p, "rejected": bool(p < alpha)}

    return reduce_series(df, run, RESULT, keys, order, value)


def dependence(df: DataFrame, lags: int = 10, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Partial autocorrelations (lag 0 is 1) and the Hurst exponent."""
    clean = lambda x: x[~np.isnan(x)]
    return reduce_series(df, lambda t, x: {"pacf": pacf(clean(x), lags).tolist(), "hurst": hurst(clean(x))}, "pacf array<double>, hurst double", keys, order, value)

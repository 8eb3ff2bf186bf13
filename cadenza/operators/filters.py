"""Filters over a series: windows where the frame is fixed, a grouped map where each step needs the one before."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.series import per_series
from cadenza.schema import KEYS, ConfigError


def odd(window: int) -> int:
    return window + 1 - window % 2


def moving_average(df: DataFrame, window: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Centred mean over an odd window (even ones grow by one), NaN where the frame is not full."""
    if window < 3:
        raise ConfigError("a window has three rows at least")
    h = odd(window) // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    return df.withColumn("filtered", F.when(F.count(value).over(w) == 2 * h + 1, F.avg(value).over(w)).otherwise(F.lit(float("nan"))))


def held_moving_average(df: DataFrame, window: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """The moving average with its first and last value held to the edges, and the residual."""
    x = moving_average(df, window, keys, order, value)
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.when(~F.isnan("filtered"), F.col("filtered"))
    y = F.coalesce(ok, F.last(ok, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(ok, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(float("nan")))
    return x.withColumn("filtered", y).withColumn("residual", F.col(value) - F.col("filtered"))


def weighted(df: DataFrame, weights: list[float], keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Centred weighted mean; NaN where the kernel leaves the series."""
    if len(weights) < 3 or len(weights) % 2 == 0 or abs(sum(weights)) < 1e-300:
        raise ConfigError("a kernel has an odd number of weights, three at least, with a sum")
    w, h, total = Window.partitionBy(*keys).orderBy(order), len(weights) // 2, sum(weights)
    terms = [F.lit(k / total) * (F.lag(value, h - i).over(w) if i <= h else F.lead(value, i - h).over(w)) for i, k in enumerate(weights)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return df.withColumn("filtered", F.coalesce(out, F.lit(float("nan"))))


#: Kernels that are polynomials of the distance on either side, as coefficients of 1, |u| and u^2.
KERNELS = {"epanechnikov": (0.75, 0.0, -0.75), "uniform": (0.5, 0.0, 0.0), "triangular": (1.0, -1.0, 0.0)}


def kernel_smooth(df: DataFrame, half_width: int, kernel: str = "epanechnikov", keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Kernel mean over row distances, renormalised at the edges. Bandwidth in rows; the Gaussian is cut at three of them.

    A polynomial kernel needs sums of value and its first two moments over the frame's halves, so no row carries its frame;
    the Gaussian is a sum over its lags.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    if kernel == "gaussian":
        weight = lambda k: math.exp(-0.5 * (k / half_width) ** 2)
        lag = lambda k: F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value)
        num, den = F.lit(0.0), F.lit(0.0)
        for k in range(-3 * half_width, 3 * half_width + 1):
            num = num + F.coalesce(lag(k) * weight(k), F.lit(0.0))
            den = den + F.when(lag(k).isNotNull(), F.lit(weight(k))).otherwise(F.lit(0.0))
        return df.withColumn("filtered", num / den)
    if kernel not in KERNELS:
        raise ConfigError(f"unknown kernel {kernel!r}")
    c0, c1, c2 = KERNELS[kernel]
    h = float(half_width)
    v = F.when(F.col(value).isNotNull(), F.col(value))
    one = F.when(F.col(value).isNotNull(), F.lit(1.0))
    x = df.withColumn("_i", F.row_number().over(w).cast("double"))
    num, den = F.lit(0.0), F.lit(0.0)
    for sign, frame in ((-1.0, w.rowsBetween(-half_width, -1)), (1.0, w.rowsBetween(0, half_width))):
        # distance is sign * (j - i); its powers are expanded about the row's own number
        for y, add in ((v, "num"), (one, "den")):
            s0, s1, s2 = (F.coalesce(F.sum(y * p).over(frame), F.lit(0.0)) for p in (F.lit(1.0), F.col("_i"), F.col("_i") * F.col("_i")))
            d1, d2 = s1 - F.col("_i") * s0, s2 - 2 * F.col("_i") * s1 + F.col("_i") * F.col("_i") * s0
            term = c0 * s0 + c1 * sign * d1 / h + c2 * d2 / (h * h)
            num, den = (num + term, den) if add == "num" else (num, den + term)
    return x.withColumn("filtered", num / den).drop("_i")


def savgol_coefficients(window: int, degree: int, at: int | None = None) -> np.ndarray:
    h = window // 2
    x = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    return np.linalg.pinv(x).T @ (float(0 if at is None else at - h) ** np.arange(degree + 1))


def savitzky_golay(df: DataFrame, window: int, degree: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Polynomial smoothing; at the edges the polynomial of the first and last window is read off its centre."""
    if window % 2 == 0 or window < degree + 2:
        raise ConfigError("the window is odd and has degree + 2 rows at least")
    w, h = Window.partitionBy(*keys), window // 2
    o = w.orderBy(order)
    x = df.withColumns({"_i": F.row_number().over(o) - 1, "_n": F.count("*").over(w)})
    shift = F.when(F.col("_i") < h, F.col("_i")).when(F.col("_i") >= F.col("_n") - h, F.col("_i") - F.col("_n") + window).otherwise(F.lit(h))
    out = None
    for place in range(window):
        c = savgol_coefficients(window, degree, place)
        total = F.lit(0.0)
        for j, cj in enumerate(c):
            k = j - place  # rows from here
            total = total + F.lit(float(cj)) * (F.lead(value, k).over(o) if k > 0 else F.lag(value, -k).over(o) if k < 0 else F.col(value))
        out = F.when(shift == place, total) if out is None else out.when(shift == place, total)
    return x.withColumn("filtered", F.when(F.col("_n") < window, F.lit(float("nan"))).otherwise(out)).drop("_i", "_n")


def ema(df: DataFrame, alpha: float, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """s = alpha x + (1 - alpha) s, begun at the first value."""
    if not 0 < alpha <= 1:
        raise ConfigError("alpha lies in (0, 1]")

    def run(t: np.ndarray, x: np.ndarray) -> dict:
        s, out = np.nan, np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            s = v if i == 0 else alpha * v + (1 - alpha) * s
            out[i] = s
        return {"filtered": out}

    return per_series(df, run, "filtered double", keys, order, value)


def loess_fit(x: np.ndarray, bandwidth: float, degree: int = 1, robust: int = 0, kernel: str = "tricube") -> np.ndarray:
    """Local regression in row space over the nearest share of rows, with bisquare reweighting if asked for.

    The weighted moments of all rows of a block come as sums over a strided view, and small normal systems are solved at
    once; distances are scaled to one, so that those stay well conditioned.
    """
    n = len(x)
    k = max(degree + 1, min(n, math.ceil(bandwidth * n)))
    rob = np.ones(n)
    out = np.empty(n)
    place = np.arange(n)
    lo = np.minimum(np.maximum(0, place - (k - 1) // 2), n - k)
    h = np.maximum(np.maximum(place - lo, lo + k - 1 - place), 1)
    block = max(1, 2_000_000 // k)
    for _ in range(robust + 1):
        xs, rs = np.lib.stride_tricks.sliding_window_view(x, k), np.lib.stride_tricks.sliding_window_view(rob, k)
        for a in range(0, n, block):
            i = slice(a, min(n, a + block))
            u = (lo[i, None] + np.arange(k)[None] - place[i, None]) / h[i, None]
            au = np.minimum(np.abs(u), 1)
            if kernel == "tricube":
                w = (1 - au**3) ** 3
            elif kernel == "epanechnikov":
                w = 0.75 * (1 - au**2)
            else:
                w = np.exp(-0.5 * (3 * np.abs(u)) ** 2)
            w = w * rs[lo[i]]
            y = xs[lo[i]]
            powers = [w]
            for _p in range(2 * degree):
                powers.append(powers[-1] * u)
            m = np.stack([p.sum(1) for p in powers], 1)
            gram = m[:, np.arange(degree + 1)[:, None] + np.arange(degree + 1)[None]]
            rhs = np.stack([(powers[p] * y).sum(1) for p in range(degree + 1)], 1)
            scale = np.maximum(m[:, 0], 1e-300)
            out[i] = (np.linalg.pinv(gram / scale[:, None, None], hermitian=True) @ (rhs / scale[:, None])[..., None])[:, 0, 0]
        r = x - out
        s = np.median(np.abs(r))
        if s <= 0:
            break
        rob = np.where(np.abs(r) < 6 * s, (1 - (r / (6 * s)) ** 2) ** 2, 0)
    return out


def loess(df: DataFrame, bandwidth: float, degree: int = 1, robust: int = 0, kernel: str = "tricube", keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    return per_series(df, lambda t, x: {"filtered": loess_fit(x, bandwidth, degree, robust, kernel)}, "filtered double", keys, order, value)


def spline_filter(df: DataFrame, step: int = 0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """A cubic spline through every step-th valid row and the last (step 0: chosen by length)."""
    from cadenza.functions.numeric import cubic_spline

    def run(t: np.ndarray, x: np.ndarray) -> dict:
        ok = np.flatnonzero(~np.isnan(x))
        s = step or max(1, min(len(ok) // 200, len(ok) // 4))
        knots = np.unique(np.append(ok[::s], ok[-1:]))
        return {"filtered": cubic_spline(t[knots], x[knots])(t) if len(knots) > 3 else np.interp(t, t[knots], x[knots]) if len(knots) else x}

    return per_series(df, run, "filtered double", keys, order, value)


def advise_window(x: np.ndarray, method: str = "silverman_mad") -> int:
    """An odd window from Silverman's rule on the deviation of the values, or from the first peak of the autocorrelation."""
    n = len(x)
    if method == "acf_peak":
        c = x - x.mean()
        r = np.array([(c[: n - k] * c[k:]).sum() for k in range(n // 2)]) / max((c * c).sum(), 1e-300)
        peaks = [k for k in range(1, len(r) - 1) if r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > 0]
        return odd(max(3, peaks[0] if peaks else n // 20))
    s = np.median(np.abs(x - np.median(x))) / 0.6745 if method == "silverman_mad" else x.std(ddof=1)
    spread = x.max() - x.min()
    return odd(max(3, min(n // 2, int(1.06 * (s / spread if spread else 0) * n ** (-0.2) * n))))


def window_advice(df: DataFrame, method: str = "silverman_mad", keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Per series the odd window that advise_window() suggests for its valid values."""
    from cadenza.operators.series import reduce_series

    return reduce_series(df, lambda t, x: {"window": advise_window(x[~np.isnan(x)], method)}, "window int", keys, order, value)

"""Sequential models of one series each: stationarity tests, ARIMA, decomposition, spectra, SSA, Kalman.

Kernels are plain numpy; the functions at the end run them for each series as a grouped map.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import numeric as N
from cadenza.functions.dist import adf_critical, kpss_critical
from cadenza.operators.filters import odd
from cadenza.operators.series import per_series, reduce_series
from cadenza.schema import KEYS, ConfigError, DataError, SeriesTooShort

# ---- stationarity --------------------------------------------------------------------------------------------------


def newey_west(e: np.ndarray, lags: int = -1) -> float:
    """Uncentred long-run variance under Bartlett weights."""
    n = len(e)
    l = max(1, int(4 * (n / 100) ** (2 / 9))) if lags < 0 else lags
    return float((e @ e) / n + 2 * sum((1 - j / (l + 1)) * (e[j:] @ e[: n - j]) / n for j in range(1, l + 1)))


def _trend_columns(n: int, trend: str, start: int = 0) -> list[np.ndarray]:
    return ([] if trend == "none" else [np.ones(n)]) + ([np.arange(start, start + n, dtype=float)] if trend == "trend" else [])


def adf(x: np.ndarray, trend: str = "constant", lags: int | str = "aic", alpha: float = 0.05) -> dict:
    n = len(x)
    d = np.diff(x)

    def fit(p: int) -> tuple[float, float, int]:
        y = d[p:]
        cols = [x[p:-1], *_trend_columns(len(y), trend), *[d[p - k : len(d) - k] for k in range(1, p + 1)]]
        a = np.stack(cols, 1)
        r = N.lsq(a, y)
        rss, m = float(r["residuals"] @ r["residuals"]), len(y)
        ic = m * math.log(max(rss, 1e-300) / m) + a.shape[1] * (2 if lags != "bic" else math.log(m))
        return float(r["x"][0] / (r["sigma0"] * math.sqrt(r["cofactor"][0, 0]))), ic, m

    if isinstance(lags, int):
        stat, _, m = fit(lags)
        p = lags
    else:
        most = min(int(12 * (n / 100) ** 0.25), n // 2 - 3)
        tried = [(fit(p), p) for p in range(most + 1)]
        (stat, _, m), p = min(tried, key=lambda z: z[0][1])
    bucket = 0.01 if alpha <= 0.015 else 0.05 if alpha <= 0.075 else 0.10
    crit = adf_critical(m, trend, bucket)
    return {"test": "adf", "statistic": stat, "critical": crit, "lags": p, "p_value": math.nan, "rejected": bool(stat < crit)}


def kpss(x: np.ndarray, trend: str = "level", lags: int = -1, alpha: float = 0.05) -> dict:
    n = len(x)
    a = np.stack(_trend_columns(n, "trend" if trend == "trend" else "constant"), 1)
    e = -N.lsq(a, x)["residuals"]
    s = np.cumsum(e)
    stat = float((s @ s) / (n * n * newey_west(e, lags)))
    crit = kpss_critical(trend, alpha)
    return {"test": "kpss", "statistic": stat, "critical": crit, "lags": lags, "p_value": math.nan, "rejected": bool(stat > crit)}


def phillips_perron(x: np.ndarray, trend: str = "constant", lags: int = -1, alpha: float = 0.05) -> dict:
    y = x[1:]
    n = len(y)
    a = np.stack([x[:-1], *_trend_columns(n, trend)], 1)
    r = N.lsq(a, y)
    e = -r["residuals"]
    se = r["sigma0"] * math.sqrt(r["cofactor"][0, 0])
    t = (r["x"][0] - 1) / se
    g0, l2 = float(e @ e) / n, newey_west(e, lags)
    z = math.sqrt(g0 / l2) * t - 0.5 * (l2 - g0) / math.sqrt(l2) * n * se / r["sigma0"]
    bucket = 0.01 if alpha <= 0.015 else 0.05 if alpha <= 0.075 else 0.10
    crit = adf_critical(n, trend, bucket)
    return {"test": "pp", "statistic": float(z), "critical": crit, "lags": lags, "p_value": math.nan, "rejected": bool(z < crit)}


def stationarity_np(x: np.ndarray, alpha: float = 0.05) -> dict:
    """Strict majority of the unit-root tests, and KPSS; a test that fails is left out."""
    out = {}
    for name, fn in (("adf", adf), ("pp", phillips_perron), ("kpss", kpss)):
        try:
            out[name] = fn(x, alpha=alpha)
        except (DataError, ValueError, np.linalg.LinAlgError):
            continue
    roots = [out[k]["rejected"] for k in ("adf", "pp") if k in out]
    stationary = bool(roots) and sum(roots) * 2 > len(roots) and not out.get("kpss", {"rejected": False})["rejected"]
    return {"stationary": stationary, "recommended_diff": 0 if stationary else 1, **{f"{k}_{f}": out[k][f] if k in out else None for k in ("adf", "pp", "kpss") for f in ("statistic", "rejected")}}


def stationarity(df: DataFrame, alpha: float = 0.05, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    cols = "stationary boolean, recommended_diff int, adf_statistic double, adf_rejected boolean, pp_statistic double, pp_rejected boolean, kpss_statistic double, kpss_rejected boolean"
    return reduce_series(df, lambda t, x: stationarity_np(x[~np.isnan(x)], alpha), cols, keys, order, value)


# ---- ARIMA ---------------------------------------------------------------------------------------------------------


def arima_lags(p: int, season_p: int, s: int) -> list[int]:
    """The lags i + j s that are not zero, as free coefficients."""
    return sorted({i + j * s for i in range(p + 1) for j in range(season_p + 1)} - {0})


def arima_fit(x: np.ndarray, p: int, q: int, sp: int = 0, sq: int = 0, s: int = 0) -> dict:
    """Hannan-Rissanen: residuals of a long autoregression stand in for the shocks of the second regression."""
    ar, ma = arima_lags(p, sp, s), arima_lags(q, sq, s)
    n = len(x)
    mean = float(x.mean())
    c = x - mean
    e = np.zeros(n)
    if ma:
        k = min(max(max(ar, default=0), max(ma)) + max(4, int(10 * math.log10(n))), n // 4)
        a, y = N.lag_matrix(c, k)
        e[k:] = -N.lsq(a, y)["residuals"]
        start = k + max(ma)
    else:
        start = 0
    start = max(start, max(ar, default=0))
    if n - start <= len(ar) + len(ma) + 1:
        raise DataError("too few values for these orders")
    cols = [c[start - l : n - l] for l in ar] + [e[start - l : n - l] for l in ma]
    y = c[start:]
    if cols:
        r = N.lsq(np.stack(cols, 1), y)
        coef, res = r["x"], -r["residuals"]
    else:
        coef, res = np.zeros(0), y
    m, k = len(y), len(coef) + 1
    var = float(res @ res) / m
    ll = -0.5 * m * (math.log(2 * math.pi * max(var, 1e-300)) + 1)
    full = np.zeros(n)
    full[start:] = res
    return {"mean": mean, "ar_lags": ar, "ma_lags": ma, "ar": coef[: len(ar)].tolist(), "ma": coef[len(ar) :].tolist(), "sigma2": var, "loglik": ll, "aic": -2 * ll + 2 * k, "bic": -2 * ll + k * math.log(m), "n": m, "residuals": full}


def arima_select(x: np.ndarray, max_p: int = 3, max_q: int = 3, criterion: str = "aic", **season) -> tuple[int, int, dict]:
    best = None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            try:
                f = arima_fit(x, p, q, **season)
            except (DataError, ValueError, np.linalg.LinAlgError, N.SingularMatrix):
                continue
            if best is None or f[criterion] < best[2][criterion]:
                best = (p, q, f)
    if best is None:
        raise DataError("no order could be fitted")
    return best


def psi_weights(f: dict, h: int) -> np.ndarray:
    psi = np.zeros(h)
    psi[0] = 1
    for k in range(1, h):
        v = sum(a * psi[k - l] for a, l in zip(f["ar"], f["ar_lags"], strict=True) if l <= k) + sum(b for b, l in zip(f["ma"], f["ma_lags"], strict=True) if l == k)
        psi[k] = v if abs(v) <= 1e6 else 0.0
    return psi


def arima_forecast(x: np.ndarray, f: dict, h: int) -> list[dict]:
    """Recursive mean and 95 % band, on the scale that was fitted."""
    c, e = list(x - f["mean"]), list(f["residuals"])
    out, se = [], np.sqrt(f["sigma2"] * np.cumsum(psi_weights(f, h) ** 2))
    for k in range(h):
        v = sum(a * c[-l] for a, l in zip(f["ar"], f["ar_lags"], strict=True)) + sum(b * e[-l] for b, l in zip(f["ma"], f["ma_lags"], strict=True))
        c.append(v), e.append(0.0)
        m = f["mean"] + v
        out.append({"step": k + 1, "forecast": m, "lower95": m - 1.96 * se[k], "upper95": m + 1.96 * se[k]})
    return out


def integrate(forecast: list[dict], last: float) -> list[dict]:
    """A forecast of first differences on the scale of the series; bands add up step by step."""
    total, var, out = last, 0.0, []
    for f in forecast:
        total += f["forecast"]
        var += ((f["upper95"] - f["forecast"]) / 1.96) ** 2
        w = 1.96 * math.sqrt(var)
        out.append({"step": f["step"], "forecast": total, "lower95": total - w, "upper95": total + w})
    return out


def arima(df: DataFrame, max_p: int = 2, max_q: int = 2, d: int = -1, season: int = 0, season_d: int = 0, horizon: int = 0, criterion: str = "aic", compat: bool = False, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Difference, choose orders, fit; with a horizon forecast rows, else one row of the fit.

    d -1: from the stationarity tests. compat leaves the forecast on the differenced scale.
    """

    def run(t: np.ndarray, x: np.ndarray):
        x = x[~np.isnan(x)]
        z = x
        for _ in range(season_d):
            z = z[season:] - z[:-season]
        dd = stationarity_np(z)["recommended_diff"] if d < 0 else d
        level = z
        for _ in range(dd):
            z = np.diff(z)
        p, q, f = arima_select(z, max_p, max_q, criterion)
        if horizon:
            out = arima_forecast(z, f, horizon)
            return out if compat or dd != 1 or season_d else integrate(out, float(level[-1]))
        return {"p": p, "d": dd, "q": q, **{k: f[k] for k in ("mean", "ar", "ma", "sigma2", "loglik", "aic", "bic", "n")}}

    cols = "step bigint, forecast double, lower95 double, upper95 double" if horizon else "p int, d int, q int, mean double, ar array<double>, ma array<double>, sigma2 double, loglik double, aic double, bic double, n bigint"
    return reduce_series(df, run, cols, keys, order, value)


# ---- decomposition -------------------------------------------------------------------------------------------------


def moving(x: np.ndarray, w: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= w:
        out[w // 2 : len(x) - w // 2] = np.convolve(x, np.ones(w) / w, "valid")
    return out


def classical_np(x: np.ndarray, period: int, use_median: bool = False) -> dict:
    """Additive: centred mean (even periods grow by one, edges held), slot means centred, remainder."""
    tr = moving(x, odd(period))
    ok = np.flatnonzero(~np.isnan(tr))
    tr = np.interp(np.arange(len(x)), ok, tr[ok])
    slot = np.arange(len(x)) % period
    f = np.median if use_median else np.mean
    s = np.array([f((x - tr)[slot == k]) for k in range(period)])
    s = (s - s.mean())[slot]
    return {"trend": tr, "seasonal": s, "residual": x - tr - s}


def _sliding(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The sum of x[i:i+len(k)] * k for each i, by transforms where the kernel is long."""
    if len(k) < 64:
        return np.correlate(x, k, "valid")
    m = 1 << (len(x) + len(k)).bit_length()
    return np.fft.irfft(np.fft.rfft(x, m) * np.conj(np.fft.rfft(k, m)), m)[: len(x) - len(k) + 1]


def _stl_loess(y: np.ndarray, w: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Local lines over the `width` nearest of the rows 0..n-1 with weights w, read off at the places `at`, also outside.

    Away from the ends all neighbourhoods have one shape, so the moments of each are sliding sums.
    """
    n = len(y)
    out = np.empty(len(at))
    inner = (at - width // 2 >= 0) & (at - width // 2 <= n - width)
    if width >= 3 and inner.any():
        d = np.arange(width) - width // 2
        u = np.abs(d) / max(width // 2, width - 1 - width // 2)
        k = np.where(u <= 0.999, np.where(u <= 0.001, 1.0, (1 - np.minimum(u, 1) ** 3) ** 3), 0.0)
        left = at[inner] - width // 2
        s0, s1, s2, t0, t1 = (_sliding(a, k * d**p)[left] for a, p in ((w, 0), (w, 1), (w, 2), (w * y, 0), (w * y, 1)))
        has = s0 > 1e-9
        s0 = np.where(has, s0, 1.0)
        mean_d, mean_y = s1 / s0, t0 / s0
        v = s2 / s0 - mean_d**2
        steep = np.sqrt(np.maximum(v, 0)) > 0.001 * max(n - 1, 1)
        slope = np.where(steep, (t1 / s0 - mean_d * mean_y) / np.where(steep, v, 1), 0)
        out[inner] = np.where(has, mean_y - slope * mean_d, y[at[inner]])
        at, edge = at[~inner], np.flatnonzero(~inner)
        if len(at):
            out[edge] = _loess_at(y, w, width, at)
        return out
    return _loess_at(y, w, width, at)


def _loess_at(y: np.ndarray, w: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """_stl_loess() with the weights of each place written out."""
    n = len(y)
    q = min(width, n)
    out = np.empty(len(at))
    block = max(1, 2_000_000 // q)
    for a in range(0, len(at), block):
        t = at[a : a + block]
        left = np.clip(t - q // 2, 0, n - q)
        j = left[:, None] + np.arange(q)[None]
        h = np.maximum(t - left, left + q - 1 - t) + max(0, (width - n) // 2)
        u = np.abs(j - t[:, None]) / np.maximum(h, 1)[:, None]
        k = np.where(u <= 0.999, np.where(u <= 0.001, 1.0, (1 - np.minimum(u, 1) ** 3) ** 3), 0.0) * w[j]
        total = k.sum(1)
        empty = total <= 0
        k[empty, np.clip(t - left, 0, q - 1)[empty]] = 1.0
        k = k / k.sum(1)[:, None]
        m = (k * j).sum(1)
        d = j - m[:, None]
        v = (k * d * d).sum(1)
        steep = np.sqrt(v) > 0.001 * max(n - 1, 1)
        k = np.where(steep[:, None], k * (1 + ((t - m) / np.where(steep, v, 1))[:, None] * d), k)
        out[a : a + block] = (k * y[j]).sum(1)
    return out


def _means(x: np.ndarray, width: int) -> np.ndarray:
    s = np.append(0.0, np.cumsum(x))
    return (s[width:] - s[:-width]) / width


def stl_np(x: np.ndarray, period: int, s_width: int = 7, t_width: int = 0, inner: int = 2, outer: int = 0) -> dict:
    """Seasonal and trend by local regression, with bisquare weights in outer rounds.

    In each inner round the cycle subseries are smoothed and carried on by one period at both ends; three moving averages
    (twice the period, then three) and a local regression over the next odd number to the period take the low frequencies
    out of them; what is left is the season, and the series without it is smoothed to the trend.
    """
    n = len(x)
    if n < 2 * period:
        raise SeriesTooShort(f"{n} rows are fewer than two periods of {period}")
    t_width = t_width or odd(math.ceil(1.5 * period / (1 - 1.5 / s_width)))
    tr, season, w = np.zeros(n), np.zeros(n), np.ones(n)
    every = np.arange(n)
    for round_ in range(outer + 1):
        for _ in range(inner):
            d = x - tr
            cyc = np.empty(n + 2 * period)
            for k in range(period):
                part = d[k::period]
                cyc[k::period] = _stl_loess(part, w[k::period], s_width, np.arange(-1, len(part) + 1))
            low = _stl_loess(_means(_means(_means(cyc, period), period), 3), np.ones(n), odd(period), every)
            season = cyc[period : period + n] - low
            tr = _stl_loess(x - season, w, t_width, every)
        r = np.abs(x - tr - season)
        h = 6 * np.median(r)
        if round_ < outer and h > 0:
            w = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - np.minimum(r / h, 1) ** 2) ** 2, 0.0))
    return {"trend": tr, "seasonal": season, "residual": x - tr - season}


def decompose(df: DataFrame, period: int, method: str = "classical", keys: list[str] = KEYS, order: str = "mjd", value: str = "value", **kw) -> DataFrame:
    fn = {"classical": classical_np, "stl": stl_np}.get(method)
    if fn is None:
        raise ConfigError(f"unknown method {method!r}")
    return per_series(df, lambda t, x: fn(x, period, **kw), "trend double, seasonal double, residual double", keys, order, value)


def classical_sql(df: DataFrame, period: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """The classical decomposition from windows alone: no group in a Python task, however long the series."""
    from pyspark.sql.window import Window

    from cadenza.operators.filters import held_moving_average

    x = held_moving_average(df, period, keys, order, value).withColumnRenamed("filtered", "trend").drop("residual")
    w = Window.partitionBy(*keys)
    x = x.withColumn("_slot", F.pmod(F.row_number().over(w.orderBy(order)) - 1, F.lit(period)))
    s = x.groupBy(*keys, "_slot").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    s = s.withColumn("seasonal", F.col("_s") - F.avg("_s").over(w)).drop("_s")
    return x.join(s, [*keys, "_slot"]).drop("_slot").withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


# ---- spectra -------------------------------------------------------------------------------------------------------


def window_of(name: str, n: int) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / max(1, n - 1)
    shapes = {
        "rectangular": [1.0], "hann": [0.5, -0.5], "hamming": [0.54, -0.46], "blackman": [0.42, -0.5, 0.08],
        "flattop": [0.21557895, -0.41663158, 0.277263158, -0.083578947, 0.006947368],
    }
    if name not in shapes:
        raise ConfigError(f"unknown window {name!r}")
    return sum(a * np.cos(k * t) for k, a in enumerate(shapes[name])) * np.ones(n)


def periodogram(x: np.ndarray, step: float, window: str = "hann") -> dict:
    """One-sided density, amplitude and phase of the mean-free series, padded to a power of two."""
    n = len(x)
    w = window_of(window, n)
    m = 1 << (n - 1).bit_length()
    z = np.fft.rfft((x - x.mean()) * w, m)
    side = np.full(len(z), 2.0)
    side[0] = side[-1] = 1
    return {"frequency": np.fft.rfftfreq(m, step), "psd": side * np.abs(z) ** 2 * step / (w * w).sum(), "amplitude": side * np.abs(z) / w.sum(), "phase": np.angle(z)}


def welch(x: np.ndarray, step: float, segment: int, overlap: float = 0.5, window: str = "hann") -> dict:
    hop = max(1, int(segment * (1 - overlap)))
    parts = [periodogram(x[i : i + segment], step, window) for i in range(0, len(x) - segment + 1, hop)] or [periodogram(x, step, window)]
    ph = np.stack([p["phase"] for p in parts])
    return {"frequency": parts[0]["frequency"], "psd": np.mean([p["psd"] for p in parts], 0), "amplitude": np.mean([p["amplitude"] for p in parts], 0), "phase": np.arctan2(np.sin(ph).mean(0), np.cos(ph).mean(0))}


def spectrum(df: DataFrame, method: str = "fft", keys: list[str] = KEYS, order: str = "mjd", value: str = "value", **kw) -> DataFrame:
    def run(t: np.ndarray, x: np.ndarray) -> list[dict]:
        ok = ~np.isnan(x)
        step = float(np.median(np.diff(t[ok])))
        r = periodogram(x[ok], step, **kw) if method == "fft" else welch(x[ok], step, **kw)
        return [dict(zip(r, v, strict=True)) for v in zip(*(a.tolist() for a in r.values()), strict=True)]

    return reduce_series(df, run, "frequency double, psd double, amplitude double, phase double", keys, order, value).drop("error")


def spectrogram(df: DataFrame, window: int = 1461, overlap: float = 0.5, low: float = 0.0, high: float = math.inf, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Density for each frame (at its middle) and frequency inside the band."""

    def run(t: np.ndarray, x: np.ndarray) -> list[dict]:
        step, hop, out = float(np.median(np.diff(t))), max(1, int(window * (1 - overlap))), []
        for i in range(0, len(x) - window + 1, hop):
            r = periodogram(x[i : i + window], step)
            keep = (r["frequency"] >= low) & (r["frequency"] <= high)
            out += [{"mid": float(t[i : i + window].mean()), "frequency": f, "psd": p} for f, p in zip(r["frequency"][keep].tolist(), r["psd"][keep].tolist(), strict=True)]
        return out

    return reduce_series(df, run, "mid double, frequency double, psd double", keys, order, value).drop("error")


#: Frequencies that a row meets at once.
FREQUENCY_BLOCK = 4096


def _trigonometric_sums(x: DataFrame, oversampling: float, keys: list[str]) -> DataFrame:
    """Per key and frequency number _k: the sums of a spectrum over the rows (_t, _c) of x; _w frequencies, _span days."""
    names = ["s2", "c2", "ys", "yc"]
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_k int, frequency double, _w int, n bigint", *[f"{c} double" for c in names], "yy double"])

    def run(parts):
        import pandas as pd

        sums: dict[tuple, list] = {}

        def rows():
            for key, (f, w, n, a, yy) in sums.items():
                k = np.arange(key[-1] * FREQUENCY_BLOCK + 1, min(w, (key[-1] + 1) * FREQUENCY_BLOCK) + 1)
                yield pd.DataFrame({**{c: [v] * len(k) for c, v in zip(keys, key, strict=False)}, "_k": k, "frequency": f, "_w": w, "n": n, **dict(zip(names, a, strict=True)), "yy": yy})

        for pdf in parts:
            for key, g in pdf.groupby([*keys, "_block"], dropna=False):
                t, c, w = g["_t"].to_numpy(float), g["_c"].to_numpy(float), int(g["_w"].iloc[0])
                k = np.arange(key[-1] * FREQUENCY_BLOCK + 1, min(w, (key[-1] + 1) * FREQUENCY_BLOCK) + 1)
                f = k / (float(g["_span"].iloc[0]) * oversampling)
                if key not in sums:
                    sums[key] = [f, w, 0, np.zeros((4, len(k))), 0.0]
                for i in range(0, len(t), 64):
                    angle = 2 * np.pi * (t[i : i + 64, None] * f[None])
                    sin, cos = np.sin(angle), np.cos(angle)
                    sums[key][3] += np.stack([2 * (sin * cos).sum(0), len(angle) - 2 * (sin * sin).sum(0), c[i : i + 64] @ sin, c[i : i + 64] @ cos])
                sums[key][2] += len(t)
                sums[key][4] += float((c * c).sum())
            if len(sums) > 500:  # sums of one block may come in parts
                yield from rows()
                sums.clear()
        yield from rows()

    blocks = x.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_w") - 1) / FREQUENCY_BLOCK).cast("int"))))
    spark = x.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # few rows, much work
    parts = blocks.repartition(tasks, "_block", *keys).mapInPandas(run, schema)
    return parts.groupBy(*keys, "_k").agg(F.first("frequency").alias("frequency"), F.first("_w").alias("_w"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in [*names, "yy"]])


def lomb_scargle(df: DataFrame, frequencies: int = 0, oversampling: float = 4.0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value", compat: bool = False) -> DataFrame:
    """Normalised power at `frequencies` steps of 1/(oversampling span), and its false-alarm probability.

    frequencies 0: as many as reach 1/(2 median step) of each series. Rows meet blocks of frequencies, a block of a series
    is summed in one task batch by batch, and no series has to fit in memory. A sine or cosine that vanishes at all epochs
    adds no power. compat divides the power by n once more.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    span = F.max(order).over(w) - F.min(order).over(w)
    count = F.lit(frequencies)
    if not frequencies:
        d = F.col(order) - F.lag(order).over(w.orderBy(order))
        x = x.withColumn("_step", F.when(d > 0, d))
        count = F.greatest(F.lit(1), F.floor(span * oversampling / (2 * F.median("_step").over(w)) + 1e-6).cast("int"))
    x = x.select(*keys, (F.col(order) - F.min(order).over(w)).alias("_t"), (F.col(value) - F.avg(value).over(w)).alias("_c"), span.alias("_span"), count.alias("_w"))
    s = _trigonometric_sums(x, oversampling, keys)
    tau = F.atan2("s2", "c2") / 2
    co, si = F.cos(tau), F.sin(tau)
    yc, ys = F.col("yc") * co + F.col("ys") * si, F.col("ys") * co - F.col("yc") * si
    r = F.sqrt(F.col("s2") * F.col("s2") + F.col("c2") * F.col("c2"))
    cc, ss = (F.col("n") + r) / 2, (F.col("n") - r) / 2
    part = lambda y, of: F.when(of > 1e-10 * F.col("n"), y * y / of).otherwise(F.lit(0.0))
    power = 0.5 * (part(yc, cc) + part(ys, ss)) / (F.col("yy") / (F.col("n") - 1))
    power = power / F.col("n") if compat else power
    out = s.select(*keys, F.col("_k").alias("k"), "frequency", power.alias("power"), "_w")
    return out.withColumn("fap", F.least(F.lit(1.0), F.col("_w") * F.exp(-F.col("power"))) if not compat else F.least(F.lit(1.0), F.col("_w") * F.sqrt("power") * F.exp(-F.col("power")))).drop("_w")


def peaks(spec: DataFrame, top: int = 10, min_period: float = 0.0, max_period: float = math.inf, max_fap: float = 1.0, keys: list[str] = KEYS, power: str = "power") -> DataFrame:
    """Strict local maxima above the median power, the `top` largest, power relative to the largest."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    o = w.orderBy("frequency")
    x = spec.withColumns({"_l": F.lag(power).over(o), "_r": F.lead(power).over(o), "_m": F.median(power).over(w), "_top": F.max(power).over(w), "period": 1 / F.col("frequency")})
    x = x.where((F.col(power) > F.col("_l")) & (F.col(power) > F.col("_r")) & (F.col(power) > F.col("_m")) & F.col("period").between(min_period, max_period))
    if "fap" in spec.columns:
        x = x.where(F.col("fap") <= max_fap)
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.desc(power), "frequency"))).where(F.col("rank") <= top)
    return x.select(*keys, "rank", "frequency", "period", power, (F.col(power) / F.col("_top")).alias("relative"))


# ---- SSA -----------------------------------------------------------------------------------------------------------


def diagonal_average(m: np.ndarray) -> np.ndarray:
    """Means of the anti-diagonals."""
    k, l = m.shape
    at = np.add.outer(np.arange(k), np.arange(l)).ravel()
    return np.bincount(at, m.ravel()) / np.bincount(at)


def ssa_np(x: np.ndarray, window: int, rank: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(components, one a row; share of the captured variance of each)."""
    h = N.hankel(x, window)
    if rank:
        u, s, vt = N.randomized_svd(h, rank)
    else:
        val, vec = np.linalg.eigh(h.T @ h)
        o = np.argsort(val)[::-1]
        s, vt = np.sqrt(np.maximum(val[o], 0)), vec[:, o].T
        u = h @ vt.T / np.where(s > 1e-12, s, 1)
    n, k = len(x), len(h)
    m = 1 << (n - 1).bit_length()
    ones = np.bincount(np.add.outer(np.arange(k), np.arange(window)).ravel())
    comp = np.stack([np.fft.irfft(np.fft.rfft(u[:, i] * s[i], m) * np.fft.rfft(vt[i], m), m)[:n] / ones for i in range(len(s))])
    return comp, s**2 / max((s**2).sum(), 1e-300)


def w_correlation(comp: np.ndarray, window: int) -> np.ndarray:
    n = comp.shape[1]
    w = np.minimum(np.minimum(np.arange(1, n + 1), n - np.arange(n)), min(window, n - window + 1))
    g = (comp * w) @ comp.T
    d = np.sqrt(np.diag(g))
    return np.abs(g) / np.where(np.outer(d, d) > 0, np.outer(d, d), 1)


def ssa_groups(comp: np.ndarray, share: np.ndarray, window: int, method: str = "wcorr", threshold: float = 0.8) -> np.ndarray:
    """A group number for each component, by w-correlation linkage, k-means on shape, or leading variance."""
    k = len(comp)
    if method == "variance":
        return (np.append(0, np.cumsum(share)[:-1]) >= threshold).astype(int)
    if method == "kmeans":
        f = np.stack([share, (np.diff(np.sign(comp), axis=1) != 0).mean(1)], 1)
        f = (f - f.min(0)) / np.where(np.ptp(f, 0) > 0, np.ptp(f, 0), 1)
        from cadenza.operators.cluster import best_kmeans

        return best_kmeans(f, 2, min(8, k - 1))[0]
    if method != "wcorr":
        raise ConfigError(f"unknown grouping {method!r}")
    d = 1 - w_correlation(comp, window)
    groups = [[i] for i in range(k)]
    while len(groups) > 1:
        best = min((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] > 1 - threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.empty(k, int)
    for g, members in enumerate(sorted(groups, key=min)):
        out[members] = g
    return out


def ssa(df: DataFrame, window: int, rank: int = 10, grouping: str = "wcorr", threshold: float = 0.8, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """The series as a sum of groups: (row time, group, value), the group's share of variance, and the remainder (-1)."""

    def run(t: np.ndarray, x: np.ndarray) -> list[dict]:
        comp, share = ssa_np(x, window, rank)
        g = ssa_groups(comp, share, window, grouping, threshold)
        out = [{"mjd": a, "grp": int(k), "share": float(share[g == k].sum()), "part": b} for k in np.unique(g) for a, b in zip(t.tolist(), comp[g == k].sum(0).tolist(), strict=True)]
        return out + [{"mjd": a, "grp": -1, "share": 0.0, "part": b} for a, b in zip(t.tolist(), (x - comp.sum(0)).tolist(), strict=True)]

    return reduce_series(df, run, "mjd double, grp int, share double, part double", keys, order, value).drop("error")


# ---- Kalman --------------------------------------------------------------------------------------------------------


def kalman_model(kind: str, q: float, r: float, dt: float = 1.0) -> dict:
    f = {"local_level": np.eye(1), "local_trend": np.array([[1, dt], [0, 1.0]]), "constant_velocity": np.array([[1, dt], [0, 1.0]])}.get(kind)
    if f is None:
        raise ConfigError(f"unknown model {kind!r}")
    n = len(f)
    h = np.zeros((1, n))
    h[0, 0] = 1
    noise = np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]) if kind == "constant_velocity" else np.eye(n)
    return {"f": f, "h": h, "q": q * noise, "r": r, "p0": r / max(q, 1e-300) * np.eye(n)}


def _kalman_level(y: np.ndarray, q: float, r: float, p: float) -> dict:
    """kalman_np() of a local level, in plain numbers."""
    ok = np.flatnonzero(np.isfinite(y))
    x, ll = float(y[ok[0]]) if len(ok) else 0.0, 0.0
    xs, ps, xp, pp = [], [], [], []
    for v in y.tolist():
        p += q
        xp.append(x), pp.append(p)
        if math.isfinite(v):
            s = p + r
            e, k = v - x, p / s
            x += k * e
            p = (1 - k) * p * (1 - k) + r * k * k
            ll -= 0.5 * (math.log(2 * math.pi * s) + e * e / s)
        xs.append(x), ps.append(p)
    column = lambda a: np.array(a).reshape(-1, 1)
    return {"x": column(xs), "p": column(ps)[:, :, None], "xp": column(xp), "pp": column(pp)[:, :, None], "loglik": ll}


def kalman_np(y: np.ndarray, m: dict) -> dict:
    """Filtered states; a value that is not finite only predicts. Joseph form."""
    f, h, q, r = m["f"], m["h"], m["q"], m["r"]
    n = len(f)
    if n == 1:
        return _kalman_level(y, float(q[0, 0]), r, float(m["p0"][0, 0]))
    x, p = np.zeros(n), m["p0"].copy()
    ok = np.flatnonzero(np.isfinite(y))
    x[0] = y[ok[0]] if len(ok) else 0.0
    xs, ps, xp, pp, ll = [], [], [], [], 0.0
    for v in y.tolist():
        x, p = f @ x, f @ p @ f.T + q
        xp.append(x), pp.append(p)
        if math.isfinite(v):
            s = float((h @ p @ h.T)[0, 0]) + r
            e = v - float((h @ x)[0])
            k = (p @ h.T)[:, 0] / s
            a = np.eye(n) - np.outer(k, h[0])
            x, p = x + k * e, a @ p @ a.T + r * np.outer(k, k)
            ll += -0.5 * (math.log(2 * math.pi * s) + e * e / s)
        xs.append(x), ps.append(p)
    return {"x": np.array(xs), "p": np.array(ps), "xp": np.array(xp), "pp": np.array(pp), "loglik": ll}


def rts_np(k: dict, m: dict) -> dict:
    """Smoothed states and the covariances of each with the one before it. Gains are made at once, the recursion is plain."""
    x, p = k["x"].copy(), k["p"].copy()
    n = len(x)
    g = k["p"][:-1] @ m["f"].T @ np.linalg.pinv(k["pp"][1:])
    if len(m["f"]) == 1:
        gs, xs, ps = g[:, 0, 0].tolist(), x[:, 0].tolist(), p[:, 0, 0].tolist()
        xp, pp = k["xp"][:, 0].tolist(), k["pp"][:, 0, 0].tolist()
        for t in range(n - 2, -1, -1):
            xs[t] += gs[t] * (xs[t + 1] - xp[t + 1])
            ps[t] += gs[t] * (ps[t + 1] - pp[t + 1]) * gs[t]
        x, p = np.array(xs).reshape(-1, 1), np.array(ps).reshape(-1, 1, 1)
    else:
        for t in range(n - 2, -1, -1):
            x[t] += g[t] @ (x[t + 1] - k["xp"][t + 1])
            p[t] += g[t] @ (p[t + 1] - k["pp"][t + 1]) @ g[t].T
    lag = np.zeros_like(p)
    lag[1:] = p[1:] @ g.transpose(0, 2, 1)
    return {"x": x, "p": p, "lag": lag}


def kalman_em(y: np.ndarray, kind: str, q: float, r: float, rounds: int = 50, tol: float = 1e-6) -> tuple[float, float]:
    """Isotropic q and r by expectation maximisation, with unit steps."""
    last = -np.inf
    ok = np.isfinite(y)
    for _ in range(rounds):
        m = kalman_model(kind, q, r)
        k = kalman_np(y, m)
        s = rts_np(k, m)
        f, n = m["f"], len(m["f"])
        e = y[ok] - (s["x"][ok] @ m["h"].T)[:, 0]
        r = max(float((e * e + (m["h"] @ s["p"][ok] @ m["h"].T)[:, 0, 0]).mean()), 1e-12)
        d = s["x"][1:] - s["x"][:-1] @ f.T
        cross = np.einsum("ij,tij->t", f, s["lag"][1:])  # the trace of F C'
        tot = float((d * d).sum() + np.trace(s["p"][1:], axis1=1, axis2=2).sum() - 2 * cross.sum() + np.trace(f @ s["p"][:-1] @ f.T, axis1=1, axis2=2).sum())
        q = max(tot / (n * (len(y) - 1)), 1e-12)
        if abs(k["loglik"] - last) < tol * max(1.0, abs(last) if np.isfinite(last) else 1.0):
            break
        last = k["loglik"]
    return q, r


def kalman(df: DataFrame, kind: str = "local_level", noise: str = "heuristic", q: float = 1.0, r: float = 1.0, smoothing: float = 10.0, horizon: int = 0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Filtered and smoothed level with deviations for each row, then `horizon` rows of forecast (observed is null)."""

    def run(t: np.ndarray, y: np.ndarray) -> list[dict]:
        dt = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
        qq, rr = q, r
        if noise in ("heuristic", "em"):
            rr = float(np.nanvar(y)) or 1.0
            qq = rr / smoothing
        if noise == "em":
            qq, rr = kalman_em(y, kind, qq, rr)
        m = kalman_model(kind, qq, rr, dt)
        k = kalman_np(y, m)
        s = rts_np(k, m)
        rows = [{"mjd": a, "observed": b, "filtered": c[0], "smoothed": d[0], "filtered_sd": math.sqrt(max(e[0, 0], 0)), "smoothed_sd": math.sqrt(max(g[0, 0], 0)), "q": qq, "r": rr, "loglik": k["loglik"]} for a, b, c, d, e, g in zip(t.tolist(), y.tolist(), k["x"], s["x"], k["p"], s["p"], strict=True)]
        x, p = k["x"][-1], k["p"][-1]
        for i in range(horizon):
            x, p = m["f"] @ x, m["f"] @ p @ m["f"].T + m["q"]
            rows.append({"mjd": float(t[-1] + (i + 1) * dt), "observed": None, "filtered": x[0], "smoothed": x[0], "filtered_sd": math.sqrt(p[0, 0]), "smoothed_sd": math.sqrt(p[0, 0]), "q": qq, "r": rr, "loglik": k["loglik"]})
        return rows

    return reduce_series(df, run, "mjd double, observed double, filtered double, smoothed double, filtered_sd double, smoothed_sd double, q double, r double, loglik double", keys, order, value).drop("error")

"""Extreme values: block maxima, peaks over a threshold, GEV and GPD fits, return levels and goodness of fit."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.dist import chi2_quantile
from cadenza.functions.numeric import nelder_mead
from cadenza.operators.series import reduce_series
from cadenza.operators.stats import valid
from cadenza.schema import KEYS, ConfigError, DataError


def block_maxima(df: DataFrame, size: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Maximum of each block of rows; an incomplete last block is dropped."""
    w = Window.partitionBy(*keys)
    x = df.where(valid(value)).withColumns({"block": F.floor((F.row_number().over(w.orderBy(order)) - 1) / size), "_n": F.count("*").over(w)})
    return x.where((F.col("block") + 1) * size <= F.col("_n")).groupBy(*keys, "block").agg(F.max(value).alias("maximum"))


def exceedances(df: DataFrame, p: float = 0.95, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    q = df.where(valid(value)).groupBy(*keys).agg(F.percentile(value, F.lit(p)).alias("threshold"))
    over = F.when(F.col(value) > F.col("threshold"), F.col(value) - F.col("threshold"))
    return df.where(valid(value)).join(q, keys).groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.count(over).alias("n_exceed"), F.avg(over).alias("mean_excess"))


def mean_excess(df: DataFrame, probabilities: list[float], keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Mean excess over each of several quantile thresholds: one exact percentile pass, one join, one aggregate."""
    x = df.where(valid(value))
    q = x.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, probabilities))).alias("_u"))
    t = q.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, probabilities)).alias("p"), F.col("_u").alias("threshold"))).alias("_e")).select(*keys, F.col("_e.p").alias("p"), F.col("_e.threshold").alias("threshold"))
    return x.join(t, keys).where(F.col(value) > F.col("threshold")).groupBy(*keys, "p").agg(F.first("threshold").alias("threshold"), F.count("*").alias("n"), F.avg(F.col(value) - F.col("threshold")).alias("mean_excess"))


def choose_threshold(x: np.ndarray, candidates: int = 50) -> float:
    """The elbow of the mean-excess curve: the candidate farthest from the chord between its ends."""
    s = np.sort(x)
    u = np.quantile(s, np.linspace(0.5, 0.98, candidates))
    m = np.array([s[s > v].mean() - v if (s > v).any() else 0.0 for v in u])
    a, b = (u - u[0]) / (np.ptp(u) or 1), (m - m.min()) / (np.ptp(m) or 1)
    d = np.abs((b[-1] - b[0]) * a - (a[-1] - a[0]) * b + a[-1] * b[0] - b[-1] * a[0])
    return float(u[int(np.argmax(d))])


def gpd_loglik(e: np.ndarray, xi: float, sigma: float) -> float:
    if sigma <= 0 or xi <= -0.5:
        return -math.inf
    if abs(xi) < 1e-9:
        return -len(e) * math.log(sigma) - e.sum() / sigma
    z = 1 + xi * e / sigma
    return -math.inf if (z <= 0).any() else -len(e) * math.log(sigma) - (1 + 1 / xi) * np.log(z).sum()


def gpd_fit(e: np.ndarray, method: str = "auto") -> dict:
    """By maximum likelihood, or by probability-weighted moments for few values (never 'converged')."""
    n = len(e)
    if n < 5:
        raise DataError("too few exceedances")
    s = np.sort(e)
    b0, b1 = s.mean(), ((n - 1 - np.arange(n)) / (n - 1) * s).mean()
    xi, sigma = 2 - b0 / (b0 - 2 * b1), 2 * b0 * b1 / (b0 - 2 * b1)
    if method == "pwm" or (method == "auto" and n < 50):
        return {"xi": float(xi), "sigma": float(sigma), "loglik": float(gpd_loglik(e, xi, sigma)), "converged": False}
    p, v, ok = nelder_mead(lambda p: -gpd_loglik(e, p[0], p[1]) if np.isfinite(gpd_loglik(e, p[0], p[1])) else 1e300, [max(-0.4, min(xi, 0.9)) if sigma > 0 else 0.1, sigma if sigma > 0 else b0])
    return {"xi": float(p[0]), "sigma": float(p[1]), "loglik": float(-v), "converged": ok}


def gpd_level(u: float, xi: float, sigma: float, rate: float, period: float) -> float:
    m = rate * period
    return u + sigma * math.log(m) if abs(xi) < 1e-9 else u + sigma / xi * (m**xi - 1)


def gev_loglik(x: np.ndarray, mu: float, sigma: float, xi: float) -> float:
    if sigma <= 0:
        return -math.inf
    z = (x - mu) / sigma
    if abs(xi) < 1e-9:
        return -len(x) * math.log(sigma) - z.sum() - np.exp(-z).sum()
    t = 1 + xi * z
    return -math.inf if (t <= 0).any() else -len(x) * math.log(sigma) - (1 + 1 / xi) * np.log(t).sum() - (t ** (-1 / xi)).sum()


def gev_fit(x: np.ndarray) -> dict:
    s = x.std(ddof=1) * math.sqrt(6) / math.pi
    start = [x.mean() - 0.5772156649015329 * s, s, 0.1]
    p, v, ok = nelder_mead(lambda p: -gev_loglik(x, *p) if np.isfinite(gev_loglik(x, *p)) else 1e300, start)
    return {"mu": float(p[0]), "sigma": float(p[1]), "xi": float(p[2]), "loglik": float(-v), "converged": ok}


def gev_level(mu: float, sigma: float, xi: float, period: float) -> float:
    y = -math.log(1 - 1 / period)
    return mu - sigma * math.log(y) if abs(xi) < 1e-9 else mu + sigma / xi * (y**-xi - 1)


def gpd_interval(e: np.ndarray, u: float, rate: float, period: float, fit: dict, method: str = "profile", level: float = 0.95, draws: int = 500, seed: int = 42, compat: bool = False) -> tuple[float, float]:
    est = gpd_level(u, fit["xi"], fit["sigma"], rate, period)
    if method == "bootstrap":
        rng = np.random.default_rng(seed)
        got = []
        for _ in range(draws):
            b = rng.choice(e, len(e))
            try:
                f = gpd_fit(b, "pwm")
                got.append(gpd_level(u, f["xi"], f["sigma"], rate, period))
            except (DataError, ZeroDivisionError, OverflowError):
                continue
        return float(np.quantile(got, (1 - level) / 2)), float(np.quantile(got, (1 + level) / 2))
    if method == "delta":
        h = [1e-4 * max(abs(fit["xi"]), 0.1), 1e-4 * fit["sigma"]]
        p = [fit["xi"], fit["sigma"]]
        var, grad = [], []
        for k in range(2):
            up, dn = p.copy(), p.copy()
            up[k] += h[k]
            dn[k] -= h[k]
            second = (gpd_loglik(e, *up) - 2 * gpd_loglik(e, *p) + gpd_loglik(e, *dn)) / h[k] ** 2
            var.append(-1 / second if second < 0 else 0.0)
            grad.append((gpd_level(u, *up, rate, period) - gpd_level(u, *dn, rate, period)) / (2 * h[k]))
        v = sum(g * g * s for g, s in zip(grad, var, strict=True)) / (len(e) if compat else 1)
        return est - 1.96 * math.sqrt(v), est + 1.96 * math.sqrt(v)
    if method != "profile":
        raise ConfigError(f"unknown interval {method!r}")
    drop = float(chi2_quantile(level, 1)) / 2
    m = rate * period

    def best(z: float) -> float:
        top = -math.inf
        for xi in np.linspace(-0.45, 1.2, 120):
            s = (z - u) / math.log(m) if abs(xi) < 1e-9 else (z - u) * xi / (m**xi - 1)
            top = max(top, gpd_loglik(e, float(xi), s))
        return top

    peak = max(fit["loglik"], best(est))
    out = []
    for sign in (-1, 1):
        lo, step = est, max(abs(est - u) * 0.05, 1e-9)
        hi = est + sign * step
        while best(hi) > peak - drop and abs(hi - est) < 1e6 * step and (sign > 0 or hi > u):
            lo, hi = hi, est + (hi - est) * 2 if sign > 0 else max(u + 1e-9, est + (hi - est) * 2)
            if hi <= u + 1e-9:
                break
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if best(mid) > peak - drop else (lo, mid)
        out.append(float(lo))
    return out[0], out[1]


def goodness(x: np.ndarray, cdf) -> dict:
    f = np.clip(cdf(np.sort(x)), 1e-12, 1 - 1e-12)
    n, i = len(x), np.arange(1, len(x) + 1)
    return {"anderson_darling": float(-n - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).sum() / n), "kolmogorov": float(max((i / n - f).max(), (f - (i - 1) / n).max()))}


def gpd_cdf(xi: float, sigma: float):
    return lambda e: 1 - np.exp(-e / sigma) if abs(xi) < 1e-9 else 1 - np.maximum(1 + xi * e / sigma, 0) ** (-1 / xi)


def gev_cdf(mu: float, sigma: float, xi: float):
    return lambda x: np.exp(-np.exp(-(x - mu) / sigma)) if abs(xi) < 1e-9 else np.exp(-np.maximum(1 + xi * (x - mu) / sigma, 1e-300) ** (-1 / xi))


RETURNS = "return_period double, estimate double, lower_ci double, upper_ci double, xi double, sigma double, location double, rate double, anderson_darling double, kolmogorov double"


def return_levels(df: DataFrame, periods: list[float], method: str = "pot", threshold: float | None = None, block: int = 365, interval: str = "profile", compat: bool = False, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Return levels, a row for each series and period. Peaks over threshold: periods in the unit of order; blocks: in blocks."""

    def run(t: np.ndarray, x: np.ndarray) -> list[dict]:
        ok = ~np.isnan(x)
        t, x = t[ok], x[ok]
        out = []
        if method == "pot":
            u = choose_threshold(x) if threshold is None else threshold
            e = x[x > u] - u
            f, rate = gpd_fit(e), len(e) / max(t[-1] - t[0], 1e-12)
            g = goodness(e, gpd_cdf(f["xi"], f["sigma"]))
            for p in periods:
                lo, hi = gpd_interval(e, u, rate, p, f, interval, compat=compat)
                out.append({"return_period": p, "estimate": gpd_level(u, f["xi"], f["sigma"], rate, p), "lower_ci": lo, "upper_ci": hi, "xi": f["xi"], "sigma": f["sigma"], "location": u, "rate": rate, **g})
            return out
        if method != "blocks":
            raise ConfigError(f"unknown method {method!r}")
        m = x[: len(x) // block * block].reshape(-1, block).max(1)
        f = gev_fit(m)
        rng = np.random.default_rng(42)
        boot = [gev_fit(rng.choice(m, len(m))) for _ in range(100)] if interval == "bootstrap" else []
        for p in periods:
            est = gev_level(f["mu"], f["sigma"], f["xi"], p)
            z = [gev_level(b["mu"], b["sigma"], b["xi"], p) for b in boot] or [est]
            out.append({"return_period": p, "estimate": est, "lower_ci": float(np.quantile(z, 0.025)), "upper_ci": float(np.quantile(z, 0.975)), "xi": f["xi"], "sigma": f["sigma"], "location": f["mu"], "rate": 1.0, **goodness(m, gev_cdf(f["mu"], f["sigma"], f["xi"]))})
        return out

    return reduce_series(df, run, RETURNS, keys, order, value)

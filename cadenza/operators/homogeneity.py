"""Change points: test statistics from prefix sums, segmentations, and the adjustment of a series at its shifts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.series import reduce_series
from cadenza.schema import KEYS, ConfigError


def split_statistics(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """For each split k of n: means to the left and right, pooled deviation, Yao-Davis T and SNHT statistics.

    Prefix sums over the series' window, of values centred at the series mean, so nothing cancels and nothing is quadratic.
    """
    w = Window.partitionBy(*keys)
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumns({"_n": F.count("*").over(w), "_m": F.avg(value).over(w)})
    x = x.withColumn("_c", F.col(value) - F.col("_m"))
    o = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"k": F.count("*").over(o), "_s": F.sum("_c").over(o), "_q": F.sum(F.col("_c") * F.col("_c")).over(o), "_qq": F.sum(F.col("_c") * F.col("_c")).over(w)})
    n, k = F.col("_n"), F.col("k")
    left, right = F.col("_s") / k, -F.col("_s") / (n - k)
    within = F.col("_q") - F.col("_s") * F.col("_s") / k + (F.col("_qq") - F.col("_q")) - F.col("_s") * F.col("_s") / (n - k)
    raw = F.sqrt((n - k) * k / n) * F.abs(left - right)
    x = x.where(k < n).withColumns({"n": n, "shift": right - left, "raw_t": raw, "t_stat": raw / F.sqrt(within / (n - 2)), "snht": (k * left * left + (n - k) * right * right) / (F.col("_qq") / n)})
    return x.select(*keys, order, "n", "k", "shift", "raw_t", "t_stat", "snht")


def t_argmax(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value", compat: bool = False) -> DataFrame:
    """The split of the largest T; compat: of the largest unscaled statistic, scaled afterwards."""
    s = split_statistics(df, keys, order, value)
    by = F.struct(F.col("raw_t" if compat else "t_stat"), -F.col("k"))
    return s.groupBy(*keys).agg(F.max_by("k", by).alias("k"), F.max_by("t_stat", by).alias("t_stat"), F.max_by("shift", by).alias("shift"), F.max_by(order, by).alias("last_left"))


def snht_argmax(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    s = split_statistics(df, keys, order, value)
    by = F.struct(F.col("snht"), -F.col("k"))
    return s.groupBy(*keys).agg(F.max_by("k", by).alias("k"), F.max("snht").alias("snht"), F.max_by("shift", by).alias("shift"))


def sigma_star(x: np.ndarray, k: int) -> float:
    """Long-run deviation of the residuals about both means, by Bartlett weights over the first cube root of n lags."""
    r = np.concatenate([x[:k] - x[:k].mean(), x[k:] - x[k:].mean()])
    n = len(r)
    c = lambda j: (r[: n - j] * r[j:]).sum() / n
    lags = math.ceil(n ** (1 / 3))
    v = c(0) + 2 * sum((1 - j / (lags + 1)) * c(j) for j in range(1, lags + 1))
    return math.sqrt(max(v / max(c(0), 1e-300), 1e-12))


def yao_davis(x: np.ndarray, alpha: float = 0.05, compat: bool = False) -> dict:
    """The most likely split, its scaled statistic, Gumbel critical value and p-value."""
    n = len(x)
    if n < 5:
        return {"k": -1, "detected": False, "statistic": 0.0, "p_value": 1.0, "critical": np.inf, "shift": 0.0}
    c = x - x.mean()
    k = np.arange(1, n)
    s, q = np.cumsum(c)[:-1], np.cumsum(c * c)[:-1]
    raw = np.sqrt((n - k) * k / n) * np.abs(s / k + s / (n - k))
    sd = np.sqrt(np.maximum((c * c).sum() - s * s / k - s * s / (n - k), 0) / (n - 2))
    t = np.where(sd > 0, raw / np.where(sd > 0, sd, 1), 0)
    i = int(np.argmax(raw if compat else t))
    star = sigma_star(x, int(k[i]))
    stat = t[i] / star
    ll = math.log(math.log(n))
    a, b = math.sqrt(2 * ll), 2 * ll + 0.5 * math.log(ll) - 0.5 * math.log(math.pi) if ll > 0 else 0.0
    y = a * stat - b if a > 0 else stat
    p = 1 - math.exp(-2 * math.exp(-y)) if y > -700 else 1.0
    crit = (b - math.log(-0.5 * math.log(1 - alpha))) / a if a > 0 else np.inf
    kk = int(k[i])
    return {"k": kk, "detected": bool(stat > crit), "statistic": float(stat), "p_value": float(p), "critical": crit * star, "shift": float(x[kk:].mean() - x[:kk].mean())}


def split_interval(x: np.ndarray, k: int, alpha: float = 0.05) -> tuple[int, int]:
    """Places between which the split at k lies with probability 1 - alpha: splits whose likelihood ratio is not too small.

    Under normal noise the residual sum of squares of a split, over the variance, falls behind the best one's by less than
    the quantile of chi-square with one degree of freedom.
    """
    from cadenza.functions.dist import chi2_quantile

    n = len(x)
    c = x - x.mean()
    m = np.arange(1, n)
    s = np.cumsum(c)[:-1]
    rss = (c * c).sum() - s * s / m - s * s / (n - m)
    best = rss[k - 1]
    near = np.flatnonzero((rss - best) / max(best / max(n - 2, 1), 1e-300) <= float(chi2_quantile(1 - alpha, 1)))
    return int(m[near[0]]), int(m[near[-1]])


def snht_np(x: np.ndarray, permutations: int = 999, alpha: float = 0.05, seed: int = 42) -> dict:
    n = len(x)
    z = x - x.mean()
    k = np.arange(1, n)
    stat = lambda v: (lambda s: (s * s / k + s * s / (n - k)) / max((v * v).mean(), 1e-300))(np.cumsum(v)[:-1])
    t = stat(z)
    i = int(np.argmax(t))
    rng = np.random.default_rng(seed)
    above = sum(stat(rng.permutation(z)).max() >= t[i] for _ in range(permutations))
    p = (above + 1) / (permutations + 1)
    return {"k": int(k[i]), "detected": bool(p < alpha), "statistic": float(t[i]), "p_value": p, "critical": np.nan, "shift": float(x[i + 1 :].mean() - x[: i + 1].mean())}


def pelt_np(x: np.ndarray, penalty: str = "bic", fixed: float = 0.0, least: int = 2) -> list[int]:
    """Starts of the segments after the first: optimal partition under an L2 cost, with pruning."""
    n = len(x)
    s, q = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    d = np.diff(x)
    var = (np.median(np.abs(d - np.median(d))) / 0.6745 / math.sqrt(2)) ** 2 if n > 1 else 0.0
    var = var or float(np.var(x)) or 1.0
    rules = {"bic": math.log(n), "aic": 2.0, "mbic": 3 * math.log(n), "fixed": fixed}
    if penalty not in rules:
        raise ConfigError(f"unknown penalty {penalty!r}")
    beta = fixed if penalty == "fixed" else rules[penalty] * 2 * var if penalty == "bic" else rules[penalty] * var
    f = np.full(n + 1, np.inf)
    f[0] = -beta
    back = np.zeros(n + 1, int)
    cand = np.array([0])
    for t in range(least, n + 1):
        ok = cand[t - cand >= least]
        cost = q[t] - q[ok] - (s[t] - s[ok]) ** 2 / (t - ok)
        total = f[ok] + cost + beta
        j = int(np.argmin(total))
        f[t], back[t] = total[j], ok[j]
        keep = ok[f[ok] + cost <= f[t]]
        cand = np.append(np.concatenate([keep, cand[t - cand < least]]), t - least + 1) if t - least + 1 > 0 else cand
        cand = np.unique(cand)
    out, t = [], n
    while back[t] > 0:
        out.append(int(back[t]))
        t = back[t]
    return out[::-1]


def bocpd_np(x: np.ndarray, hazard: float = 250.0, threshold: float = 0.5, prior: tuple = (0.0, 1.0, 1.0, 1.0), compat: bool = False) -> list[int]:
    """Change points by run-length recursion with normal-inverse-gamma segments.

    A point is reported where the most likely run length drops. compat: where the mass of run length zero passes the
    threshold; under a constant hazard that mass is 1/hazard at every step.
    """
    from math import lgamma, log, pi

    mu0, k0, a0, b0 = prior
    x = (x - np.mean(x)) / (np.std(x) or 1.0)
    mu, kk, a, b = (np.array([v]) for v in (mu0, k0, a0, b0))
    logp = np.zeros(1)
    h = 1 / hazard
    lg = np.vectorize(lgamma, otypes=[float])
    out, last = [], 0
    for t, v in enumerate(x.tolist()):
        scale = b * (kk + 1) / (a * kk)
        pred = lg(a + 0.5) - lg(a) - 0.5 * np.log(2 * a * pi * scale) - (a + 0.5) * np.log1p((v - mu) ** 2 / (2 * a * scale))
        grow = logp + pred + log(1 - h)
        m = (logp + pred).max()
        change = log(h) + m + math.log(np.exp(logp + pred - m).sum())
        new = np.append(change, grow)
        m = new.max()
        new -= m + math.log(np.exp(new - m).sum())
        mu1, k1 = (kk * mu + v) / (kk + 1), kk + 1
        b1 = b + kk * (v - mu) ** 2 / (2 * (kk + 1))
        mu, kk, a, b = np.append(mu0, mu1), np.append(k0, k1), np.append(a0, a + 0.5), np.append(b0, b1)
        best = int(np.argmax(new))
        if compat:
            if t and math.exp(new[0]) > threshold:
                out.append(t)
        elif t and best < last and t - best > (out[-1] if out else 0) and last - best > 2:
            out.append(t - best + (best > 0))
        last = best
        keep = new > -50
        keep[0] = True
        if keep.sum() < len(new) and best < keep.sum():
            mu, kk, a, b, new = mu[keep], kk[keep], a[keep], b[keep], new[keep]
        logp = new
    return out


def segment(t: np.ndarray, x: np.ndarray, method: str = "yao_davis", least: int = 30, least_seconds: float = 0.0, alpha: float = 0.05, **kw) -> list[dict]:
    """All change points: binary segmentation by a split test, or one pass of pelt or bocpd."""
    ok = np.flatnonzero(~np.isnan(x))
    t, x = t[ok], x[ok]
    found: list[tuple] = []
    if method in ("pelt", "bocpd"):
        cuts = pelt_np(x, **kw) if method == "pelt" else bocpd_np(x, **kw)
        edges = [0, *cuts, len(x)]
        found = [(c, float(x[c : edges[i + 2]].mean() - x[edges[i] : c].mean()), np.nan, c, c) for i, c in enumerate(cuts)]
    elif method in ("yao_davis", "snht"):
        test = (lambda v: yao_davis(v, alpha)) if method == "yao_davis" else (lambda v: snht_np(v, alpha=alpha))
        stack = [(0, len(x))]
        while stack:
            i, j = stack.pop()
            if j - i < 2 * least:
                continue
            r = test(x[i:j])
            k = i + r["k"]
            if r["detected"] and k - i >= least and j - k >= least and min(t[k] - t[i], t[j - 1] - t[k]) * 86400 >= least_seconds:
                a, b = split_interval(x[i:j], r["k"], alpha)
                found.append((k, r["shift"], r["p_value"], i + a, i + b))
                stack += [(i, k), (k, j)]
    else:
        raise ConfigError(f"unknown method {method!r}")
    return [{"global_index": int(ok[k]), "mjd": float(t[k]), "shift": s, "p_value": p, "mjd_low": float(t[a]), "mjd_high": float(t[min(b, len(t) - 1)])} for k, s, p, a, b in sorted(found)]


def change_points(df: DataFrame, method: str = "yao_davis", keys: list[str] = KEYS, order: str = "mjd", value: str = "value", **kw) -> DataFrame:
    """(keys, global_index, mjd, shift, p_value, mjd_low, mjd_high) of each change point; series without one give no row.

    Between mjd_low and mjd_high a split lies with probability 1 - alpha; segmenting methods give the point itself.
    """
    out = reduce_series(df, lambda t, x: segment(t, x, method, **kw), "global_index bigint, mjd double, shift double, p_value double, mjd_low double, mjd_high double", keys, order, value)
    return out.drop("error")


def adjust(df: DataFrame, points: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Subtract the shifts up to each row; the first segment is the reference.

    Points and rows are pooled and a running sum over time does the as-of join, a single sort by series.
    """
    w = Window.partitionBy(*keys).orderBy(order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"_row": F.lit(1), "_s": F.lit(0.0)})
    marks = points.select(*keys, F.col("mjd").alias(order), F.col("shift").alias("_s")).withColumn("_row", F.lit(0))
    x = rows.unionByName(marks, allowMissingColumns=True).withColumn("_sum", F.sum("_s").over(w))
    return x.where("_row = 1").withColumn("adjusted", F.col(value) - F.col("_sum")).drop("_row", "_s", "_sum")

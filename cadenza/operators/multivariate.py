"""Multivariate operators over a wide table: moments are distributed aggregates, p-by-p algebra runs on the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.dist import f_cdf
from cadenza.functions.numeric import hankel, randomized_svd
from cadenza.operators.models import diagonal_average
from cadenza.operators.ordered import with_lags
from cadenza.schema import ConfigError, DataError


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(cond)


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """Count, means and centred cross products for each group: of each task's rows, then joined, a row a group at the end."""
    by, p = by or [], len(cols)
    x = complete(df, cols).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    keys = x.columns[:-1]
    schema = ", ".join([*[f"{k} {x.schema[k].dataType.simpleString()}" for k in keys], "_n bigint, _m array<double>, _s array<double>"])

    def joined(a: tuple, b: tuple) -> tuple:
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def row(key: tuple, v: tuple) -> dict:
        return {**dict(zip(keys, key, strict=True)), "_n": v[0], "_m": v[1], "_s": v[2].ravel()}

    def part(batches):
        out = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False) if keys else [((), pdf)]
            for key, g in groups:
                v = np.stack(g["_x"].to_numpy())
                key = tuple(None if pd.isna(k) else k for k in key)
                m = v.mean(0)
                new = len(v), m, (v - m).T @ (v - m)
                out[key] = joined(out[key], new) if key in out else new
        if out:
            yield pd.DataFrame([row(k, v) for k, v in out.items()])

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(n, np.asarray(m), np.asarray(s).reshape(p, p)) for n, m, s in zip(pdf["_n"], pdf["_m"], pdf["_s"], strict=True)]
        total = parts[0]
        for v in parts[1:]:
            total = joined(total, v)
        return pd.DataFrame([row(key, total)])

    rows = x.mapInPandas(part, schema).groupBy(*keys).applyInPandas(join, schema).collect()
    out = {tuple(r[k] for k in keys): (r["_n"], np.array(r["_m"]), np.array(r["_s"]).reshape(p, p)) for r in rows}
    return out or ({} if by else {(): (0, np.full(p, np.nan), np.zeros((p, p)))})


def covariance(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    n, m, s = moments(df, cols)[()]
    if n < 2:
        raise DataError("two complete rows are needed")
    return n, m, s / (n - 1)


def linear_scores(df: DataFrame, cols: list[str], centre: np.ndarray, loadings: np.ndarray, names: list[str]) -> DataFrame:
    """Projections of each row as plain expressions."""
    z = {n: sum((F.col(c) - float(centre[i])) * float(loadings[i, k]) for i, c in enumerate(cols)) for k, n in enumerate(names)}
    return df.withColumns(z)


def pca(df: DataFrame, cols: list[str], components: int = 0, variance: float = 0.0) -> dict:
    """Loadings (largest entry positive), variances and their shares; scores by linear_scores."""
    n, m, c = covariance(df, cols)
    val, vec = np.linalg.eigh(c)
    o = np.argsort(val)[::-1]
    val, vec = np.maximum(val[o], 0), vec[:, o]
    vec *= np.sign(vec[np.abs(vec).argmax(0), range(len(cols))])
    share = val / val.sum() if val.sum() > 0 else val
    k = components or (int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1) if variance else len(cols))
    return {"n": n, "mean": m, "variances": val[:k], "shares": share[:k], "loadings": vec[:, :k]}


def mssa(df: DataFrame, cols: list[str], window: int, rank: int = 10, order: str = "mjd") -> DataFrame:
    """Multichannel SSA of one multichannel series: (time, channel, component, value), singular values and shares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[cols].to_numpy(float)
        h = np.hstack([hankel(x[:, j] - x[:, j].mean(), window) for j in range(len(cols))])
        u, s, vt = randomized_svd(h, rank)
        share = s**2 / (s**2).sum()
        rows = []
        for i in range(len(s)):
            for j, c in enumerate(cols):
                part = diagonal_average(s[i] * np.outer(u[:, i], vt[i, j * window : (j + 1) * window]))
                rows.append(pd.DataFrame({order: pdf[order].to_numpy(float), "channel": c, "component": i, "singular_value": s[i], "share": share[i], "part": part}))
        return pd.concat(rows)

    return df.select(order, *cols).groupBy().applyInPandas(run, f"{order} double, channel string, component int, singular_value double, share double, part double")


def var_fit(df: DataFrame, cols: list[str], max_lag: int = 5, criterion: str = "aic", order: str = "mjd") -> dict:
    """Vector autoregression without intercept, order by aic, bic or hqc; normal equations as distributed sums."""
    p = len(cols)
    x = with_lags(complete(df, cols), order, cols, max_lag)
    names = [f"{c}__{k}" for k in range(1, max_lag + 1) for c in cols]
    best = None
    for q in range(1, max_lag + 1):
        use = names[: p * q]
        y = x.where(F.col("_r") > q)
        t = y.count()
        if t <= p * q + 1:
            break
        sums = [F.sum(F.col(a) * F.col(b)) for a in use + cols for b in use + cols]
        g = np.array(y.agg(*sums).first(), float).reshape(len(use) + p, -1)
        a = np.linalg.solve(g[: len(use), : len(use)], g[: len(use), len(use) :])
        rss = g[len(use) :, len(use) :] - a.T @ g[: len(use), len(use) :]
        sig = rss / t
        k = p * p * q
        ic = math.log(max(np.linalg.det(sig), 1e-300)) + {"aic": 2 * k / t, "bic": k * math.log(t) / t, "hqc": 2 * k * math.log(math.log(t)) / t}[criterion]
        if best is None or ic < best["ic"]:
            best = {"order": q, "ic": ic, "coefficients": a.T, "sigma": sig, "n": t}
    if best is None:
        raise DataError("too few rows for a vector autoregression")
    return best


def granger(df: DataFrame, cols: list[str], lag: int, order: str = "mjd") -> list[dict]:
    """Does each channel help to predict each other one? F test on the drop of the squared residuals."""
    x = with_lags(complete(df, cols), order, cols, lag).where(F.col("_r") > lag)
    names = [f"{c}__{k}" for c in cols for k in range(1, lag + 1)] + cols
    g = np.array(x.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).first(), float).reshape(len(names), -1)
    n = x.count()

    def rss(target: str, sources: list[str]) -> float:
        i = [names.index(f"{s}__{k}") for s in sources for k in range(1, lag + 1)]
        t = names.index(target)
        return float(g[t, t] - g[t, i] @ np.linalg.solve(g[np.ix_(i, i)], g[i, t]))

    out = []
    for a in cols:
        for b in cols:
            if a != b:
                r0, r1 = rss(b, [b]), rss(b, [b, a])
                f = (r0 - r1) / lag / (r1 / (n - 2 * lag))
                out.append({"cause": a, "effect": b, "f": f, "p_value": float(1 - f_cdf(f, lag, n - 2 * lag))})
    return out


def varimax(l: np.ndarray, rounds: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Kaiser-normalised rotation."""
    h = np.sqrt((l * l).sum(1))[:, None]
    a, r, d = l / np.where(h > 0, h, 1), np.eye(l.shape[1]), 0.0
    for _ in range(rounds):
        b = a @ r
        u, s, vt = np.linalg.svd(a.T @ (b**3 - b @ np.diag((b * b).sum(0)) / len(a)))
        r = u @ vt
        if s.sum() < d * (1 + tol):
            break
        d = s.sum()
    return a @ r * h


def factor_analysis(df: DataFrame, cols: list[str], factors: int, rotate: bool = True, rounds: int = 100, tol: float = 1e-6) -> dict:
    """Principal axes of the correlation matrix, communalities begun at squared multiple correlations."""
    n, m, c = covariance(df, cols)
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    h = np.clip(1 - 1 / np.diag(np.linalg.inv(r + 1e-10 * np.eye(len(r)))), 0.01, 0.99)
    for _ in range(rounds):
        a = r.copy()
        np.fill_diagonal(a, h)
        val, vec = np.linalg.eigh(a)
        o = np.argsort(val)[::-1][:factors]
        l = vec[:, o] * np.sqrt(np.maximum(val[o], 0))
        new = np.clip((l * l).sum(1), 0.01, 0.99)
        done = np.abs(new - h).max() < tol
        h = new
        if done:
            break
    l = varimax(l) if rotate and factors > 1 else l
    return {"n": n, "mean": m, "sd": sd, "loadings": l, "communalities": h, "score_weights": l @ np.linalg.pinv(l.T @ l)}


def cca(df: DataFrame, xs: list[str], ys: list[str]) -> dict:
    """Canonical correlations and weights of two disjoint sets, from one covariance aggregate."""
    if set(xs) & set(ys):
        raise ConfigError("the sets share a channel")
    n, m, c = covariance(df, xs + ys)
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    p = len(xs)

    def root(s: np.ndarray) -> np.ndarray:
        val, vec = np.linalg.eigh(s)
        return vec @ np.diag([1 / math.sqrt(v) if v > 1e-12 else 0.0 for v in val]) @ vec.T

    a, b = root(r[:p, :p]), root(r[p:, p:])
    u, s, vt = np.linalg.svd(a @ r[:p, p:] @ b)
    k = min(p, len(ys))
    return {"n": n, "correlations": np.clip(s[:k], 0, 1), "x_weights": a @ u[:, :k], "y_weights": b @ vt[:k].T}


def steady(s: np.ndarray, compat: bool = False) -> np.ndarray:
    """A scatter that can be inverted: itself, or with a small ridge if it is near singular (compat: in any case)."""
    d = np.sqrt(np.maximum(np.diag(s), 0))
    if not compat and (d > 0).all() and np.linalg.eigvalsh(s / np.outer(d, d))[0] > 1e-10:
        return s
    return s + 1e-8 * np.trace(s) / len(s) * np.eye(len(s))


def lda(df: DataFrame, cols: list[str], label: str, compat: bool = False) -> dict:
    """Discriminants of the pooled scatter, projected centroids, and per-class covariances for the quadratic rule.

    A ridge moves the borders between classes, so there is one only if the scatter needs it; compat: always.
    """
    g = moments(df, cols, [label])
    n = sum(v[0] for v in g.values())
    mean = sum(v[0] * v[1] for v in g.values()) / n
    sw = sum(v[2] for v in g.values())
    sw = steady(sw, compat)
    sb = sum(v[0] * np.outer(v[1] - mean, v[1] - mean) for v in g.values())
    l = np.linalg.cholesky(sw)
    val, vec = np.linalg.eigh(np.linalg.solve(l, np.linalg.solve(l, sb).T))
    k = max(1, min(len(cols), len(g) - 1))
    o = np.argsort(val)[::-1][:k]
    w = np.linalg.solve(l.T, vec[:, o])
    return {"labels": [key[0] for key in g], "compat": compat, "weights": w, "eigenvalues": val[o], "mean": mean, "centroids": np.array([(v[1] - mean) @ w for v in g.values()]), "classes": {key[0]: (v[0], v[1], v[2] / max(1, v[0] - 1)) for key, v in g.items()}}


def lda_predict(df: DataFrame, cols: list[str], model: dict, quadratic: bool = False, to: str = "predicted") -> DataFrame:
    """Nearest projected centroid, or the largest class density, as column expressions."""
    cost, out, names = [], df, []
    if quadratic:
        n = sum(v[0] for v in model["classes"].values())
        for k in model["labels"]:
            m, mu, s = model["classes"][k]
            s = steady(s, model["compat"])
            inv = np.linalg.inv(s)
            d = sum((F.col(a) - float(mu[i])) * (F.col(b) - float(mu[j])) * float(inv[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols))
            cost.append((k, d + float(np.linalg.slogdet(s)[1] - 2 * math.log(m / n))))
    else:
        w = model["weights"]
        names = [f"_z{k}" for k in range(w.shape[1])]
        out = linear_scores(df, cols, model["mean"], w, names)
        z = [F.col(n) for n in names]
        for k, cen in zip(model["labels"], model["centroids"], strict=True):
            cost.append((k, sum((a - float(b)) * (a - float(b)) for a, b in zip(z, cen, strict=True))))
    best = F.least(*[F.struct(c.alias("d"), F.lit(k).alias("k")) for k, c in cost]) if len(cost) > 1 else F.struct(cost[0][1].alias("d"), F.lit(cost[0][0]).alias("k"))
    return out.withColumn(to, best["k"]).drop(*names)


def mahalanobis(df: DataFrame, cols: list[str], robust: bool = False, alpha: float = 0.025, rounds: int = 10) -> DataFrame:
    """Distance of each row and whether it passes the chi-square limit (Wilson-Hilferty). robust: concentration steps."""
    from cadenza.functions.dist import normal_quantile

    p = len(cols)
    n, m, c = covariance(df, cols)
    x = complete(df, cols)

    def d2(m: np.ndarray, c: np.ndarray):
        inv = np.linalg.inv(c + 1e-12 * np.trace(c) * np.eye(p))

        @F.pandas_udf("double")
        def of(v: pd.Series) -> pd.Series:
            z = np.array(v.tolist(), float).reshape(len(v), p) - m
            return pd.Series(((z @ inv) * z).sum(1))

        values = F.array(*[F.col(c).cast("double") for c in cols])
        return F.when(F.exists(values, lambda v: v.isNull()), F.lit(None)).otherwise(of(values))

    if robust:
        h = max(p + 1, int(0.75 * n))
        last = math.inf
        for _ in range(rounds):
            limit = x.select(F.percentile(d2(m, c), F.lit(h / n)).alias("q")).first()["q"]
            _, m, c = covariance(x.where(d2(m, c) <= limit), cols)
            det = float(np.linalg.det(c))
            if abs(det - last) < 1e-12 * max(abs(det), 1e-300):
                break
            last = det
    z = float(normal_quantile(1 - alpha))
    crit = p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3
    return df.withColumn("distance", F.sqrt(d2(m, c))).withColumn("is_outlier", F.col("distance") > math.sqrt(crit))


def manova(df: DataFrame, cols: list[str], label: str) -> dict:
    """Wilks (Rao's F), Pillai, Hotelling and Roy from within and between scatter."""
    g = moments(df, cols, [label])
    n, k, p = sum(v[0] for v in g.values()), len(g), len(cols)
    mean = sum(v[0] * v[1] for v in g.values()) / n
    e = sum(v[2] for v in g.values())
    e = e + 1e-10 * np.eye(p)
    h = sum(v[0] * np.outer(v[1] - mean, v[1] - mean) for v in g.values())
    val = np.maximum(np.linalg.eigvals(np.linalg.solve(e, h)).real, 0)
    wilks = float(np.prod(1 / (1 + val)))
    q = k - 1
    d = p * p + q * q - 5
    t = math.sqrt((p * p * q * q - 4) / d) if d > 0 and p * p * q * q > 4 else 1.0
    df1 = p * q
    df2 = t * (n - 1 - (p + k) / 2) - (p * q - 2) / 2
    r = wilks ** (1 / t)
    f = (1 - r) / r * df2 / df1
    return {"wilks": wilks, "f": f, "df1": df1, "df2": df2, "p_value": float(1 - f_cdf(f, df1, df2)), "pillai": float((val / (1 + val)).sum()), "hotelling": float(val.sum()), "roy": float(val.max())}


def labels_from(df: DataFrame, channel: str, to: str = "label") -> DataFrame:
    return df.withColumn(to, F.round(channel).cast("int"))


ANALYSES = {
    "pca": pca, "mssa": mssa, "var": var_fit, "granger": granger, "factor_analysis": factor_analysis, "cca": cca, "lda": lda, "mahalanobis": mahalanobis, "manova": manova,
}


def analyze(df: DataFrame, method: str, cols: list[str], **kw):
    """The analysis of that name over the channels cols; "ccf" takes two channels and max_lag."""
    if method == "ccf":
        from cadenza.operators.relational import ccf

        if len(cols) != 2:
            raise ConfigError("a cross-correlation has two channels")
        return ccf(df, *cols, **kw)
    if method not in ANALYSES:
        raise ConfigError(f"unknown analysis {method!r}; known: ccf, {', '.join(ANALYSES)}")
    return ANALYSES[method](df, cols, **kw)

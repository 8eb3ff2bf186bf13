"""Regression over series. x is mjd minus the series' first valid epoch; residuals are fitted minus observed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import numeric as N
from cadenza.functions.dist import chi2_cdf, f_cdf, t_quantile
from cadenza.operators.series import reduce_series
from cadenza.operators.stats import valid
from cadenza.schema import KEYS, ConfigError

FIT = "names array<string>, coefficients array<double>, std_errors array<double>, sigma0 double, r2 double, adj_r2 double, aic double, bic double, n bigint, t_ref double"


def centred(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    return df.where(valid(value)).withColumn("x", F.col(order) - F.min(order).over(Window.partitionBy(*keys)))


def linear(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """a0 + a1 x as one aggregate."""
    a = centred(df, keys, order, value).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept"), F.regr_r2(value, "x").alias("r2"), F.min(order).alias("t_ref"))
    return a


def calibration(df: DataFrame, x: str, y: str, keys: list[str] = KEYS) -> DataFrame:
    """Orthogonal (total least squares) line of y on x, in closed form from the moments."""
    a = df.where(valid(x) & valid(y)).groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    d = F.col("_yy") - F.col("_xx")
    slope = (d + F.sqrt(d * d + 4 * F.col("_xy") * F.col("_xy"))) / (2 * F.col("_xy"))
    return a.withColumn("slope", slope).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).select(*keys, "n", "slope", "intercept")


def goodness(y: np.ndarray, v: np.ndarray, k: int, compat: bool = False) -> dict:
    """R2, adjusted R2, AIC, BIC. compat rebuilds y as fitted + residual, the sign of which is against it."""
    n, rss = len(y), float(v @ v)
    obs = (y + v) + v if compat else y
    sst = float(((obs - obs.mean()) ** 2).sum())
    r2 = 1 - rss / sst if sst > 0 else math.nan
    ll = n * math.log(max(rss, 1e-300) / n)
    return {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k) if n > k else math.nan, "aic": ll + 2 * k, "bic": ll + k * math.log(n)}


def fit_np(t: np.ndarray, y: np.ndarray, design: Callable[[np.ndarray], np.ndarray], names: list[str], robust: str | None = None) -> dict:
    ok = ~np.isnan(y)
    x, y = t[ok] - t[ok][0], y[ok]
    a = design(x)
    r = N.irls(a, y, robust) if robust else N.lsq(a, y)
    se = r["sigma0"] * np.sqrt(np.diag(r["cofactor"]))
    return {"names": names, "coefficients": r["x"].tolist(), "std_errors": se.tolist(), "sigma0": float(r["sigma0"]), "n": len(y), "t_ref": float(t[ok][0]), **goodness(y, r["residuals"], a.shape[1])}


def design_of(model: str, degree: int = 1, period: float = 365.25, harmonics: int = 1) -> tuple[Callable, list[str]]:
    periods = [period / k for k in range(1, harmonics + 1)]
    season = [f"{f}{k}" for k in range(1, harmonics + 1) for f in ("sin", "cos")]
    if model in ("polynomial", "linear", "robust"):
        d = 1 if model == "linear" else degree
        return (lambda x: N.polynomial(x, d)), [f"a{i}" for i in range(d + 1)]
    if model == "harmonic":
        return (lambda x: N.harmonic(x, periods)), ["a0", *season]
    if model == "trend":
        return (lambda x: np.column_stack([np.ones_like(x), x, N.harmonic(x, periods)[:, 1:]])), ["a0", "a1", *season]
    raise ConfigError(f"unknown model {model!r}")


def fit(df: DataFrame, model: str = "polynomial", robust: str | None = None, keys: list[str] = KEYS, order: str = "mjd", value: str = "value", **kw) -> DataFrame:
    """Coefficients with errors and goodness of fit, a row for each series."""
    design, names = design_of(model, **kw)
    kind = robust or ("bisquare" if model == "robust" else None)
    return reduce_series(df, lambda t, y: fit_np(t, y, design, names, kind), FIT, keys, order, value)


def harmonic_normal(df: DataFrame, period: float, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """One harmonic from distributed normal equations: nine sums for each series and a closed 3x3 solution; any length."""
    x = centred(df, keys, order, value)
    w = 2 * math.pi / period
    x = x.withColumns({"_s": F.sin(F.col("x") * w), "_c": F.cos(F.col("x") * w)})
    names = {"s": "_s", "c": "_c"}
    m = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("my"), *[F.avg(v).alias(f"m{k}") for k, v in names.items()],
        F.covar_pop("_s", "_s").alias("ss"), F.covar_pop("_c", "_c").alias("cc"), F.covar_pop("_s", "_c").alias("sc"), F.covar_pop("_s", value).alias("sy"), F.covar_pop("_c", value).alias("cy"),
    )
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    m = m.withColumns({"b_sin": (F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc")) / det, "b_cos": (F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc")) / det})
    return m.select(*keys, "n", (F.col("my") - F.col("b_sin") * F.col("ms") - F.col("b_cos") * F.col("mc")).alias("a0"), "b_sin", "b_cos", F.sqrt(F.col("b_sin") ** 2 + F.col("b_cos") ** 2).alias("amplitude"), F.atan2("b_sin", "b_cos").alias("phase"))


def predict(df: DataFrame, at: list[float], model: str = "polynomial", level: float = 0.95, robust: str | None = None, keys: list[str] = KEYS, order: str = "mjd", value: str = "value", **kw) -> DataFrame:
    """Fitted value with confidence and prediction bands at times relative to each series' first valid epoch."""
    design, _ = design_of(model, **kw)

    def run(t: np.ndarray, y: np.ndarray) -> list[dict]:
        ok = ~np.isnan(y)
        x, z = t[ok] - t[ok][0], y[ok]
        a = design(x)
        r = N.irls(a, z, robust) if robust else N.lsq(a, z)
        b = design(np.asarray(at, float))
        q = float(t_quantile(0.5 + level / 2, r["dof"]))
        h = np.einsum("ij,jk,ik->i", b, r["cofactor"], b)
        p, c, d = b @ r["x"], q * r["sigma0"] * np.sqrt(h), q * r["sigma0"] * np.sqrt(1 + h)
        return [{"x": u, "predicted": v, "conf_lower": v - e, "conf_upper": v + e, "pred_lower": v - f, "pred_upper": v + f} for u, v, e, f in zip(at, p.tolist(), c.tolist(), d.tolist(), strict=True)]

    return reduce_series(df, run, "x double, predicted double, conf_lower double, conf_upper double, pred_lower double, pred_upper double", keys, order, value)


def cross_validate(x: np.ndarray, y: np.ndarray, degree: int, folds: int | None = None, robust: str | None = None) -> dict:
    """Leave-one-out errors from the hat diagonal, or k folds (always with robust weights)."""
    a = N.polynomial(x, degree)
    if folds is None and robust is None:
        e = N.lsq(a, y)["residuals"] / np.maximum(1 - N.leverage(a), 1e-12)
    else:
        k = max(2, min(folds or 10, len(x) // 2, 100))
        fold = np.random.default_rng(42).permutation(len(x)) % k
        e = np.empty(len(x))
        for f in range(k):
            tr = fold != f
            c = (N.irls(a[tr], y[tr], robust) if robust else N.lsq(a[tr], y[tr]))["x"]
            e[~tr] = a[~tr] @ c - y[~tr]
    return {"rmse": float(np.sqrt((e * e).mean())), "mae": float(np.abs(e).mean()), "bias": float(e.mean())}


MODELS: dict[str, tuple[Callable, Callable]] = {
    "exponential": (lambda x, p: p[0] * np.exp(np.clip(p[1] * x, -700, 700)), lambda x, y: [y[0] or 1.0, 0.0]),
    "logistic": (lambda x, p: p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -700, 700))), lambda x, y: [y.max(), 4 / (np.ptp(x) or 1), np.median(x)]),
    "gaussian": (lambda x, p: p[0] * np.exp(-0.5 * ((x - p[1]) / (p[2] or 1e-9)) ** 2), lambda x, y: [y.max(), x[np.argmax(y)], (np.ptp(x) or 1) / 4]),
}


def nonlinear(df: DataFrame, model: str | Callable, start: list[float] | None = None, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """A named model or any function f(x, params), by damped least squares."""
    f, guess = MODELS[model] if isinstance(model, str) else (model, None)

    def run(t: np.ndarray, y: np.ndarray) -> dict:
        ok = ~np.isnan(y)
        x, z = t[ok] - t[ok][0], y[ok]
        p, done = N.levenberg_marquardt(f, x, z, np.asarray(start if start is not None else guess(x, z), float))
        v = f(x, p) - z
        return {"coefficients": p.tolist(), "converged": done, "n": len(z), "rmse": float(np.sqrt((v * v).mean())), **goodness(z, v, len(p))}

    return reduce_series(df, run, "coefficients array<double>, converged boolean, n bigint, rmse double, r2 double, adj_r2 double, aic double, bic double", keys, order, value)


def decompose_trend(df: DataFrame, period: float, harmonics: int = 1, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """trend, seasonal and residual of a line with harmonics."""
    from cadenza.operators.series import per_series

    design, _ = design_of("trend", period=period, harmonics=harmonics)

    def run(t: np.ndarray, y: np.ndarray) -> dict:
        ok = ~np.isnan(y)
        x = t - t[ok][0]
        c = N.lsq(design(x[ok]), y[ok])["x"]
        a = design(x)
        return {"trend": a[:, :2] @ c[:2], "seasonal": a[:, 2:] @ c[2:], "residual": y - a @ c}

    return per_series(df, run, "trend double, seasonal double, residual double", keys, order, value)


def diagnostics(a: np.ndarray, y: np.ndarray, compat: bool = False) -> dict:
    """ANOVA F, leverage, standardised residuals, Cook's distances, VIF, Breusch-Pagan."""
    r = N.lsq(a, y)
    v, p, n = r["residuals"], a.shape[1], len(y)
    obs = (y + v) + v if compat else y
    sst, sse = float(((obs - obs.mean()) ** 2).sum()), float(v @ v)
    ssr = sst - sse
    f = ssr / (p - 1) / (sse / (n - p)) if p > 1 and sse > 0 else math.nan
    h = N.leverage(a)
    std = v / (r["sigma0"] * np.sqrt(np.maximum(1 - h, 1e-12)))
    vif = []
    for j in range(1, p):
        b = N.lsq(np.delete(a, j, 1), a[:, j])["residuals"]
        t = ((a[:, j] - a[:, j].mean()) ** 2).sum()
        vif.append(float(t / max(b @ b, 1e-300)))
    fitted = y + v
    lm = n * np.corrcoef(fitted, v * v)[0, 1] ** 2
    return {
        "f": f, "f_p": float(1 - f_cdf(f, p - 1, n - p)) if f == f else math.nan, "leverage": h, "standardised": std, "cook": std**2 * h / (p * np.maximum(1 - h, 1e-12)),
        "high_leverage": h > 2 * p / n, "influential": std**2 * h / (p * np.maximum(1 - h, 1e-12)) > 4 / n, "vif": vif, "bp": float(lm), "bp_p": float(1 - chi2_cdf(lm, 1)),
    }


def breusch_pagan(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """n R2 of the squared residuals of a line on its fitted values: two aggregates for each series, of any length."""
    x = centred(df, keys, order, value)
    l = x.groupBy(*keys).agg(F.regr_slope(value, "x").alias("_b"), F.regr_intercept(value, "x").alias("_a"))
    r = x.join(l, keys).withColumn("_fit", F.col("_a") + F.col("_b") * F.col("x"))
    e = (F.col("_fit") - F.col(value)) * (F.col("_fit") - F.col(value))
    return r.withColumn("_e", e).groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") * F.pow(F.corr("_e", "_fit"), 2)).alias("lm"))

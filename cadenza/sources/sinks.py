"""Result tables as delimited files or parquet, partitioned by series, with the column layout of each module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.schema import KEYS, ConfigError

# The columns of each module's table, in order.
LAYOUTS = {
    "filter": ["time_mjd", "original", "filtered", "residual"],
    "homogeneity": ["mjd", "original", "seasonal", "deseasonalized", "adjusted", "flag", "change_point"],
    "decomposition": ["time_mjd", "original", "trend", "seasonal", "residual"],
    "evt": ["return_period", "estimate", "lower_ci", "upper_ci"],
    "kriging": ["mjd", "utc", "value", "variance", "ci_lower", "ci_upper", "is_observed"],
    "spline": ["index", "mjd", "utc", "observed", "fitted", "residual", "ci_lower", "ci_upper"],
    "spatial": ["x", "y", "value", "variance", "ci_lower", "ci_upper"],
    "spatial_cv": ["x", "y", "observed", "predicted", "error"],
    "regression": ["mjd", "observed", "fitted", "residual", "ci_lower", "ci_upper"],
    "regression_influence": ["mjd", "residual", "leverage", "standardized", "cooks_distance", "is_influential"],
    "gnss_spp": ["t", "x", "y", "z", "clock", "n_sats", "sigma0", "pdop", "converged"],
    "gnss_clock": ["t", "sat", "clock"],
    "gnss_tropo": ["t", "sat", "elevation", "zhd", "zwd", "delay"],
    "gnss_ppp": ["t", "x", "y", "z", "clock", "zwd", "sigma_x", "sigma_y", "sigma_z", "n_sats"],
    "gnss_ppp_tropo": ["t", "zwd", "ztd"],
    "simulate": ["t", "p05", "p25", "p50", "p75", "p95"],
    "stationarity": ["mjd", "original", "residual", "diff1", "diff2"],
    "ssa": ["mjd", "original", "trend", "noise"],
    "outlier": ["mjd", "original", "residual", "cleaned", "seasonal", "outlier_flag"],
    "outlier_hat": ["mjd", "original", "residual", "cleaned", "seasonal", "leverage", "threshold", "outlier_flag"],
    "arima": ["mjd", "original", "residual", "fitted", "forecast", "lower95", "upper95"],
    "clustering": ["mjd", "value", "cluster", "label"],
    "qc": ["mjd", "value", "qc_flag"],
}


def shaped(df: DataFrame, layout: str, rename: dict[str, str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Key columns, then the layout's; columns that df lacks are null."""
    if layout not in LAYOUTS:
        raise ConfigError(f"unknown layout {layout!r}")
    for new, old in (rename or {}).items():
        df = df.withColumn(new, F.col(old))
    have = set(df.columns)
    return df.select(*[k for k in keys if k in have], *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in LAYOUTS[layout]])


def write(df: DataFrame, path: str, layout: str | None = None, fmt: str = "csv", rename: dict[str, str] | None = None, keys: list[str] = KEYS, mode: str = "overwrite") -> None:
    """One directory for each series. The rows of a series are sorted inside its files, which takes no global sort."""
    out = shaped(df, layout, rename, keys) if layout else df
    by = [k for k in keys if k in out.columns]
    order = next((c for c in ("mjd", "time_mjd", "t", "index") if c in out.columns), None)
    if by:
        out = out.repartition(*by)
    if order:
        out = out.sortWithinPartitions(*by, order)
    w = out.write.mode(mode)
    w = w.partitionBy(*by) if by else w
    if fmt == "csv":
        w.option("sep", ";").option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ConfigError(f"unknown format {fmt!r}")


#: Title and first lines of each module's protocol; further columns follow under their names.
PROTOCOLS = {
    "filter": ("Filter", {"method": "method", "window": "window (rows)", "n": "rows", "rmse": "deviation of residuals"}),
    "homogeneity": ("Change points", {"global_index": "row", "mjd": "time (MJD)", "mjd_low": "from", "mjd_high": "to", "shift": "shift", "p_value": "p-value"}),
    "qc": ("Quality control", {"n": "rows", "n_missing": "missing", "n_gaps": "gaps", "coverage": "share covered", "n_outliers": "outliers"}),
    "kalman": ("Kalman filter", {"q": "process noise", "r": "measurement noise", "loglik": "log-likelihood"}),
    "arima": ("ARIMA", {"p": "autoregressive order", "d": "differences", "q": "moving-average order", "aic": "AIC", "bic": "BIC", "sigma2": "residual variance"}),
    "regression": ("Regression", {"names": "terms", "coefficients": "coefficients", "std_errors": "standard errors", "r2": "R squared", "sigma0": "unit weight error"}),
    "stationarity": ("Stationarity", {"adf": "augmented Dickey-Fuller", "kpss": "KPSS", "pp": "Phillips-Perron", "recommendation": "recommended differences"}),
    "evt": ("Extremes", {"threshold": "threshold", "return_period": "return period", "estimate": "return level", "lower_ci": "from", "upper_ci": "to"}),
    "spatial": ("Interpolation", {"method": "method", "n": "points", "rmse": "cross-validated error"}),
    "multivariate": ("Channels", {"n": "complete rows", "variances": "variances", "shares": "shares", "statistic": "statistic", "p_value": "p-value"}),
    "gnss": ("Positioning", {"n": "epochs", "mean_x": "X (m)", "mean_y": "Y (m)", "mean_z": "Z (m)", "sd_x": "scatter of X (m)", "sd_y": "scatter of Y (m)", "sd_z": "scatter of Z (m)"}),
}


def protocol(df: DataFrame, keys: list[str] = KEYS, kind: str | None = None) -> DataFrame:
    """One text for each row of a summary: 'name: value' lines; kind: under a module's title, its own lines first."""
    if kind is not None and kind not in PROTOCOLS:
        raise ConfigError(f"unknown protocol {kind!r}")
    title, names = PROTOCOLS[kind] if kind else (None, {})
    keys = [k for k in keys if k in df.columns]
    cols = [c for c in names if c in df.columns] + [c for c in df.columns if c not in keys and c not in names]
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = [F.lit(f"{title}\n{'=' * len(title)}"), *[F.concat(F.lit(f"{k}: "), shown(k)) for k in keys]] if title else []
    return df.select(*keys, F.concat_ws("\n", *head, *[F.concat(F.lit(f"{names.get(c, c)}: "), shown(c)) for c in cols]).alias("protocol"))

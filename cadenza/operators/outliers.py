"""Outlier detectors: one aggregate for each series, joined back, and a score for each row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.series import per_series
from cadenza.operators.stats import valid
from cadenza.schema import KEYS, ConfigError


def _flag(df: DataFrame, centre, scale, k: float, value: str) -> DataFrame:
    """A scale of zero gives no outliers."""
    score = F.when(scale > 0, (F.col(value) - centre) / scale)
    return df.withColumn("score", score).withColumn("is_outlier", F.coalesce(F.abs("score") > k, F.lit(False)))


def iqr(df: DataFrame, k: float = 1.5, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """(x - median) / IQR beyond k: about the median, not from the quartiles."""
    q = df.where(valid(value)).groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return _flag(df.join(q, keys, "left"), F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0], k, value).drop("_q")


def mad(df: DataFrame, k: float = 3.5, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    from cadenza.operators.stats import mad as deviation

    m = df.where(valid(value)).groupBy(*keys).agg(F.median(value).alias("_m")).join(deviation(df, keys, value), keys)
    return _flag(df.join(m, keys, "left"), F.col("_m"), F.col("mad") / 0.6745, k, value).drop("_m", "mad")


def zscore(df: DataFrame, k: float = 3.0, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    s = df.where(valid(value)).groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return _flag(df.join(s, keys, "left"), F.col("_m"), F.col("_s"), k, value).drop("_m", "_s")


DETECTORS = {"iqr": iqr, "mad": mad, "zscore": zscore}


def hat_matrix(df: DataFrame, order_p: int = 3, alpha: float = 0.05, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Leverage in the lag matrix of order p beyond chi-square(1-alpha, p) / n; the first p rows have none."""
    from cadenza.functions.dist import chi2_quantile
    from cadenza.functions.numeric import lag_matrix, leverage

    def run(t: np.ndarray, x: np.ndarray) -> dict:
        lev = np.full(len(x), np.nan)
        if len(x) > 2 * order_p:
            lev[order_p:] = leverage(lag_matrix(x, order_p)[0])
        limit = float(chi2_quantile(1 - alpha, order_p)) / max(1, len(x) - order_p)
        return {"leverage": lev, "threshold": np.full(len(x), limit), "is_outlier": lev > limit}

    return per_series(df, run, "leverage double, threshold double, is_outlier boolean", keys, order, value)


def clean(df: DataFrame, detector: str = "mad", k: float = 3.5, seasonal: str | None = None, max_fill: int = 0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Outliers of the residual (value - seasonal column) become gaps, are filled linearly, and get the season back.

    flag 0: as it was, 1: an outlier that could not be filled, 2: an outlier that was replaced.
    """
    from cadenza.operators.gaps import fill_linear

    if detector not in DETECTORS:
        raise ConfigError(f"unknown detector {detector!r}")
    season = F.col(seasonal) if seasonal else F.lit(0.0)
    x = DETECTORS[detector](df.withColumn("_res", F.col(value) - season), k, keys, "_res")
    x = x.withColumn("_gap", F.when(F.col("is_outlier"), F.lit(float("nan"))).otherwise(F.col("_res")))
    x = fill_linear(x, max_fill, keys, order, "_gap")
    out = x.withColumns({"cleaned": F.when(F.col("is_outlier"), F.col("filled") + season).otherwise(F.col(value)), "flag_out": F.when(~F.col("is_outlier"), 0).when(F.isnan("filled"), 1).otherwise(2)})
    return out.drop("_res", "_gap", "filled")


def count(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if("is_outlier").alias("n_outliers"), F.count("*").alias("n"))



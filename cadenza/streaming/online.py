"""Recursive operators over streams, and windowed quality control with late data.

State lives for each series key: the last value of an exponential mean, the state and covariance of a Kalman filter. Rows
of a key inside a micro-batch are taken in time order; the results equal the batch operators on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.models import kalman_model
from cadenza.schema import KEYS, ConfigError


def _run(df: DataFrame, step, state_schema: str, columns: str, keys: list[str], order: str, value: str) -> DataFrame:
    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        rows, s = step(s, pdf[order].to_numpy(float), pdf[value].to_numpy(float))
        state.update(s)
        out = pd.DataFrame({k: [v] * len(pdf) for k, v in zip(keys, key, strict=True)})
        yield out.assign(**{order: pdf[order], value: pdf[value]}, **rows)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{order} double, {value} double", columns])
    return df.select(*keys, order, value).groupBy(*keys).applyInPandasWithState(go, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def ema(df: DataFrame, alpha: float, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    if not 0 < alpha <= 1:
        raise ConfigError("alpha lies in (0, 1]")

    def step(s, t: np.ndarray, x: np.ndarray):
        last, out = s[0] if s else None, []
        for v in x.tolist():
            last = v if last is None else alpha * v + (1 - alpha) * last
            out.append(last)
        return {"filtered": out}, (last,)

    return _run(df, step, "last double", "filtered double", keys, order, value)


def kalman(df: DataFrame, kind: str, q: float, r: float, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Filtered level and its deviation; the state holds x and P."""
    m = kalman_model(kind, q, r)
    n = len(m["f"])

    def step(s, t: np.ndarray, y: np.ndarray):
        if s:
            x, p = np.array(s[0]), np.array(s[1]).reshape(n, n)
        else:
            x, p = np.zeros(n), m["p0"].copy()
            ok = y[np.isfinite(y)]
            x[0] = ok[0] if len(ok) else 0.0
        lev, sd = [], []
        for v in y.tolist():
            x, p = m["f"] @ x, m["f"] @ p @ m["f"].T + m["q"]
            if np.isfinite(v):
                k = (p @ m["h"].T)[:, 0] / (float((m["h"] @ p @ m["h"].T)[0, 0]) + r)
                a = np.eye(n) - np.outer(k, m["h"][0])
                x, p = x + k * (v - float((m["h"] @ x)[0])), a @ p @ a.T + r * np.outer(k, k)
            lev.append(float(x[0])), sd.append(float(np.sqrt(max(p[0, 0], 0))))
        return {"filtered": lev, "filtered_sd": sd}, (x.tolist(), p.ravel().tolist())

    return _run(df, step, "x array<double>, p array<double>", "filtered double, filtered_sd double", keys, order, value)


def windowed_qc(df: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None, keys: list[str] = KEYS, t: str = "t", value: str = "value") -> DataFrame:
    """Counts, missing values and moments of each window, for rows no later than the watermark."""
    w = F.window(t, window, slide) if slide else F.window(t, window)
    ok = F.when(~F.isnan(value), F.col(value))
    return df.withWatermark(t, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.count(ok).alias("n_valid"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("stddev"), F.min(ok).alias("min"), F.max(ok).alias("max"))


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", keys: list[str] = KEYS, t: str = "t", value: str = "value") -> DataFrame:
    """Runs of rows without a longer gap."""
    return df.withWatermark(t, late).groupBy(*keys, F.session_window(t, gap).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))

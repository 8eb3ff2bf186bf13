"""Random samples, bootstrap intervals, permutation tests and simulation. Replicates are rows, so they run in parallel."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import numeric as N
from cadenza.functions.dist import normal_cdf, normal_quantile
from cadenza.schema import ConfigError, DataError


class Sampler:
    """Seeded draws by name."""

    def __init__(self, seed: int = 42):
        self.rng = np.random.default_rng(seed)

    def draw(self, name: str, size: int, *args: float) -> np.ndarray:
        r = self.rng
        table = {
            "normal": r.normal, "uniform": r.uniform, "exponential": lambda rate=1.0, size=None: r.exponential(1 / rate, size), "student_t": r.standard_t, "chi2": r.chisquare, "f": r.f,
            "beta": r.beta, "gamma": r.gamma, "laplace": r.laplace, "poisson": r.poisson, "binomial": lambda n, p, size=None: r.binomial(int(n), p, size),
        }
        if name not in table:
            raise ConfigError(f"unknown distribution {name!r}")
        return table[name](*args, size=size)

    def bootstrap_indices(self, n: int) -> np.ndarray:
        return self.rng.integers(n, size=n)

    def block_indices(self, n: int, block: int) -> np.ndarray:
        """Moving blocks, cut to n."""
        starts = self.rng.integers(max(1, n - block + 1), size=-(-n // block))
        return (starts[:, None] + np.arange(block)).ravel()[:n]


def block_length(x: np.ndarray) -> int:
    """The first lag of insignificant autocorrelation, at most a quarter of the series."""
    n = len(x)
    r = N.acf(x, n // 4)
    small = np.flatnonzero(np.abs(r[1:]) < 1.96 / math.sqrt(n))
    return int(max(1, min(small[0] + 1 if len(small) else n // 4, n // 4)))


def replicate(spark: SparkSession, n: int, fn: Callable[[int], float], partitions: int = 0) -> np.ndarray:
    """fn(i) for i in range(n), spread over the cluster; n numbers come back, bounded by the caller."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "v": [float(fn(int(i))) for i in pdf["id"]]})

    df = spark.range(0, n, 1, partitions or min(n, spark.sparkContext.defaultParallelism)).mapInPandas(run, "id bigint, v double")
    return df.toPandas().sort_values("id")["v"].to_numpy()


def confidence(spark: SparkSession, x: np.ndarray, stat: Callable[[np.ndarray], float], method: str = "percentile", n: int = 1000, alpha: float = 0.05, block: int = 0, seed: int = 42) -> dict:
    """Percentile, bias-corrected accelerated or block bootstrap interval of any statistic."""
    x = np.asarray(x, float)
    if len(x) < 2:
        raise DataError("two values are needed")
    b = (block or block_length(x)) if method == "block" else 0
    draw = lambda i: stat(x[Sampler(seed + i).block_indices(len(x), b) if b else Sampler(seed + i).bootstrap_indices(len(x))])
    r = np.sort(replicate(spark, n, draw))
    est = float(stat(x))
    lo, hi = alpha / 2, 1 - alpha / 2
    if method == "bca":
        jack = np.array([stat(np.delete(x, i)) for i in range(len(x))])
        d = jack.mean() - jack
        den = 6 * ((d * d).sum()) ** 1.5
        if den > 0:
            z0 = float(normal_quantile(((r < est).sum() + 0.5) / (n + 1)))
            a = (d**3).sum() / den
            adj = lambda p: float(np.clip(normal_cdf(z0 + (z0 + normal_quantile(p)) / (1 - a * (z0 + normal_quantile(p)))), 0.001, 0.999))
            lo, hi = adj(lo), adj(hi)
    elif method not in ("percentile", "block"):
        raise ConfigError(f"unknown interval {method!r}")
    return {"estimate": est, "lower": float(np.quantile(r, lo)), "upper": float(np.quantile(r, hi)), "bias": float(r.mean() - est), "std_error": float(r.std(ddof=1)), "block": b}


def permutation_test(spark: SparkSession, kind: str, x: np.ndarray, y: np.ndarray | None = None, stat: Callable | None = None, n: int = 999, mean0: float = 0.0, seed: int = 42, compat: bool = False) -> dict:
    """One-sample (sign flips about mean0), two-sample or correlation test; p = (count+1)/(n+1).

    The one-sample statistic is taken of the centred values; compat: of the raw ones.
    """
    x = np.asarray(x, float)
    if kind == "one_sample":
        f = stat or np.mean
        c = x - mean0
        off = mean0 if compat else 0.0
        obs = abs(f(c + off))
        draw = lambda i: abs(f(c * np.random.default_rng(seed + i).choice([-1.0, 1.0], len(c)) + off))
    elif kind == "two_sample":
        f2 = stat or (lambda a, b: a.mean() - b.mean())
        z, k = np.append(x, y), len(x)
        obs = abs(f2(x, np.asarray(y, float)))
        draw = lambda i: (lambda p: abs(f2(p[:k], p[k:])))(np.random.default_rng(seed + i).permutation(z))
    elif kind == "correlation":
        y = np.asarray(y, float)
        obs = abs(np.corrcoef(x, y)[0, 1])
        draw = lambda i: abs(np.corrcoef(x, np.random.default_rng(seed + i).permutation(y))[0, 1])
    else:
        raise ConfigError(f"unknown test {kind!r}")
    r = replicate(spark, n, draw)
    return {"statistic": float(obs), "p_value": float(((r >= obs - 1e-15).sum() + 1) / (n + 1)), "n": n}


# ---- simulation ----------------------------------------------------------------------------------------------------


def simulate_arima(n: int, ar: list[float], ma: list[float], sigma: float, d: int = 0, burn: int = 200, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e = rng.normal(0, sigma, n + burn)
    x = np.zeros(n + burn)
    for t in range(n + burn):
        x[t] = e[t] + sum(a * x[t - k - 1] for k, a in enumerate(ar) if t > k) + sum(b * e[t - k - 1] for k, b in enumerate(ma) if t > k)
    x = x[burn:]
    for _ in range(d):
        x = np.cumsum(x)
    return x


def simulate_kalman(n: int, kind: str, q: float, r: float, seed: int = 42) -> np.ndarray:
    from cadenza.operators.models import kalman_model

    m, rng = kalman_model(kind, q, r), np.random.default_rng(seed)
    l = np.linalg.cholesky(m["q"] + 1e-300 * np.eye(len(m["f"])))
    x, out = np.zeros(len(m["f"])), np.empty(n)
    for t in range(n):
        x = m["f"] @ x + l @ rng.normal(size=len(x))
        out[t] = x[0] + rng.normal(0, math.sqrt(r))
    return out


def inject(x: np.ndarray, outliers: int = 0, size: float = 5.0, gaps: int = 0, gap_length: int = 5, shifts: int = 0, shift: float = 3.0, seed: int = 42, compat: bool = False) -> np.ndarray:
    """Outliers, gaps (NaN; compat: 0.0) and lasting shifts, in units of the deviation."""
    rng, x, s = np.random.default_rng(seed), x.astype(float).copy(), x.std() or 1.0
    for i in rng.integers(len(x), size=outliers):
        x[i] += size * s * rng.choice([-1, 1])
    for i in rng.integers(len(x), size=shifts):
        x[i:] += shift * s * rng.choice([-1, 1])
    for i in rng.integers(len(x), size=gaps):
        x[i : i + gap_length] = 0.0 if compat else np.nan
    return x


def simulate(spark: SparkSession, runs: int, make: Callable[[int], np.ndarray], seed: int = 42) -> DataFrame:
    """(sim, seq, value): one run a row of the range, seed + sim for its stream."""

    def go(batches):
        for pdf in batches:
            for i in pdf["id"]:
                x = make(seed + int(i))
                yield pd.DataFrame({"sim": int(i), "seq": np.arange(len(x)), "value": x})

    return spark.range(0, runs, 1, min(runs, spark.sparkContext.defaultParallelism)).mapInPandas(go, "sim bigint, seq bigint, value double")


def envelope(sims: DataFrame, at: str = "seq", value: str = "value") -> DataFrame:
    """5, 25, 50, 75 and 95 percentiles over the simulations at each step."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return sims.groupBy(at).agg(q.alias("q")).select(at, *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])

"""B-spline regression of a series with a confidence band; the number of control points by cross-validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cadenza.functions.dist import t_quantile
from cadenza.functions.numeric import bspline_basis, bspline_choose, bspline_fit, bspline_knots
from cadenza.operators.series import per_series
from cadenza.schema import KEYS


def fit(df: DataFrame, n_control: int = 0, degree: int = 3, level: float = 0.95, folds: int = 5, most: int = 40, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """fitted, residual, ci_lower, ci_upper. Uneven sampling (deviation of the step beyond a tenth of its mean) takes
    knots at the quantiles of time."""

    def run(t: np.ndarray, x: np.ndarray) -> dict:
        ok = ~np.isnan(x)
        a, y = t[ok], x[ok]
        d = np.diff(a)
        even = bool(len(d) and d.std() / max(d.mean(), 1e-300) <= 0.1)
        n = n_control or bspline_choose(a, y, degree, folds, most)
        _, c, s, cof = bspline_fit(a, y, n, degree, even)
        u = np.clip((t - a.min()) / (np.ptp(a) or 1.0), 0, 1)
        b = bspline_basis(u, bspline_knots(n, degree, None if even else (a - a.min()) / (np.ptp(a) or 1.0)), degree)
        fitted = b @ c
        w = float(t_quantile(0.5 + level / 2, max(1, len(y) - n))) * s * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", b, cof, b), 0))
        return {"fitted": fitted, "residual": x - fitted, "ci_lower": fitted - w, "ci_upper": fitted + w}

    return per_series(df, run, "fitted double, residual double, ci_lower double, ci_upper double", keys, order, value)

"""Dense numerics in numpy: splines, interpolation, least squares, optimisers, low-rank factorisation."""

from __future__ import annotations

import math

import numpy as np

from cadenza.schema import ConfigError, DataError, SingularMatrix


# ---- interpolation -------------------------------------------------------------------------------------------------


class cubic_spline:  # noqa: N801  used like a function
    """Interpolating cubic spline: natural, not-a-knot or clamped ends; value and first two derivatives."""

    def __init__(self, x, y, ends: str = "not-a-knot", slopes: tuple[float, float] = (0.0, 0.0)):
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = len(x)
        if n < 2 or (np.diff(x) <= 0).any():
            raise DataError("a spline needs two increasing knots at least")
        h, d = np.diff(x), np.diff(y) / np.diff(x)
        a, b = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1], a[i, i], a[i, i + 1], b[i] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i], 6 * (d[i] - d[i - 1])
        if ends == "clamped":
            a[0, :2], b[0] = (2 * h[0], h[0]), 6 * (d[0] - slopes[0])
            a[-1, -2:], b[-1] = (h[-1], 2 * h[-1]), 6 * (slopes[1] - d[-1])
        elif ends == "not-a-knot" and n > 3:
            a[0, :3] = h[1], -(h[0] + h[1]), h[0]
            a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        else:
            a[0, 0] = a[-1, -1] = 1
        if n > 400:  # banded in practice: solve by elimination along the band
            m = _banded(a, b)
        else:
            m = np.linalg.solve(a, b)
        self.x, self.y, self.h, self.m = x, y, h, m

    def __call__(self, t, derivative: int = 0):
        t = np.asarray(t, float)
        i = np.clip(np.searchsorted(self.x, t, side="right") - 1, 0, len(self.h) - 1)
        h, m0, m1 = self.h[i], self.m[i], self.m[i + 1]
        u, v = t - self.x[i], self.x[i + 1] - t
        c0, c1 = self.y[i] / h - m0 * h / 6, self.y[i + 1] / h - m1 * h / 6
        if derivative == 0:
            return m0 * v**3 / (6 * h) + m1 * u**3 / (6 * h) + c0 * v + c1 * u
        if derivative == 1:
            return -m0 * v**2 / (2 * h) + m1 * u**2 / (2 * h) - c0 + c1
        return (m0 * v + m1 * u) / h


def _banded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b, n = a.copy(), b.copy(), len(b)
    for i in range(n - 1):
        for j in range(i + 1, min(i + 3, n)):
            if a[j, i]:
                f = a[j, i] / a[i, i]
                a[j, i : i + 5] -= f * a[i, i : i + 5]
                b[j] -= f * b[i]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - a[i, i + 1 : i + 5] @ x[i + 1 : i + 5]) / a[i, i]
    return x


def lagrange(x, y, t: float, order: int = 9) -> float:
    """Local polynomial through the order+1 knots about t."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    k = min(order + 1, len(x))
    lo = int(np.clip(np.searchsorted(x, t) - k // 2, 0, len(x) - k))
    xs, ys = x[lo : lo + k], y[lo : lo + k]
    if (hit := np.flatnonzero(xs == t)).size:
        return float(ys[hit[0]])
    return float(sum(ys[i] * np.prod((t - np.delete(xs, i)) / (xs[i] - np.delete(xs, i))) for i in range(k)))


def bspline_basis(t, knots, degree: int) -> np.ndarray:
    """All basis functions at t (rows)."""
    t = np.atleast_1d(np.asarray(t, float))
    n = len(knots) - degree - 1
    b = np.zeros((len(t), len(knots) - 1))
    last = np.searchsorted(knots, knots[-1], side="left") - 1
    i = np.clip(np.searchsorted(knots, t, side="right") - 1, 0, last)
    b[np.arange(len(t)), i] = 1
    for k in range(1, degree + 1):
        new = np.zeros_like(b)
        for j in range(len(knots) - 1 - k):
            l, r = knots[j + k] - knots[j], knots[j + k + 1] - knots[j + 1]
            new[:, j] = ((t - knots[j]) / l * b[:, j] if l else 0) + ((knots[j + k + 1] - t) / r * b[:, j + 1] if r else 0)
        b = new
    return b[:, :n]


def bspline_knots(n_control: int, degree: int, x: np.ndarray | None = None) -> np.ndarray:
    """Clamped knots on [0, 1]: uniform, or at quantiles of x for uneven data."""
    inner = n_control - degree - 1
    p = np.linspace(0, 1, inner + 2)[1:-1]
    mid = p if x is None else np.quantile(x, p)
    return np.concatenate([np.zeros(degree + 1), mid, np.ones(degree + 1)])


def bspline_fit(x, y, n_control: int, degree: int = 3, uniform: bool = True):
    """Least-squares B-spline: (evaluate, coefficients, residual deviation, leverage cofactor)."""
    if not 1 <= degree <= 5 or n_control <= degree:
        raise ConfigError("degree is 1 to 5, with more control points")
    x, y = np.asarray(x, float), np.asarray(y, float)
    lo, span = x.min(), np.ptp(x) or 1.0
    u = (x - lo) / span
    knots = bspline_knots(n_control, degree, None if uniform else u)
    a = bspline_basis(u, knots, degree)
    n = a.T @ a + 1e-10 * np.eye(n_control)
    c = np.linalg.solve(n, a.T @ y)
    r = y - a @ c
    s = np.sqrt((r @ r) / max(1, len(y) - n_control))
    return (lambda t: bspline_basis((np.asarray(t, float) - lo) / span, knots, degree) @ c), c, s, np.linalg.inv(n)


def bspline_choose(x, y, degree: int = 3, folds: int = 5, most: int = 200) -> int:
    """Number of control points by cross-validation on interleaved folds."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    best, at = np.inf, degree + 1
    fold = np.arange(len(x)) % folds
    for n in range(degree + 1, max(degree + 2, min(len(x) // 5, most, len(x) // folds) + 1)):
        err = 0.0
        for f in range(folds):
            tr, te = fold != f, fold == f
            e, *_ = bspline_fit(x[tr], y[tr], n, degree)
            err += ((e(np.clip(x[te], x[tr].min(), x[tr].max())) - y[te]) ** 2).sum()
        if err < best:
            best, at = err, n
    return at


# ---- least squares -------------------------------------------------------------------------------------------------


def lsq(a: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> dict:
    """Weighted least squares. Residuals are fitted minus observed; cofactor is (A'PA)^-1."""
    w = np.ones(len(y)) if w is None else w
    n = a.T @ (a * w[:, None])
    if np.linalg.matrix_rank(a) < a.shape[1]:
        raise SingularMatrix("rank-deficient design")
    q = np.linalg.inv(n)
    x = q @ (a.T @ (w * y))
    v = a @ x - y
    dof = len(y) - a.shape[1]
    return {"x": x, "residuals": v, "sigma0": np.sqrt((w * v * v).sum() / dof) if dof > 0 else np.nan, "cofactor": q, "dof": dof}


def robust_weights(v: np.ndarray, kind: str = "huber") -> np.ndarray:
    s = 1.4826 * np.median(np.abs(v))
    if s <= 0:
        return np.ones(len(v))
    u = np.abs(v) / s
    if kind == "huber":
        return np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1e-300))
    if kind == "bisquare":
        return np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0.0)
    raise ConfigError(f"unknown weights {kind!r}")


def irls(a: np.ndarray, y: np.ndarray, kind: str = "huber", rounds: int = 50, tol: float = 1e-8) -> dict:
    fit = lsq(a, y)
    w = np.ones(len(y))
    for _ in range(rounds):
        w = robust_weights(fit["residuals"], kind)
        new = lsq(a, y, w)
        moved = np.abs(new["x"] - fit["x"]).max()
        fit = new
        if moved < tol:
            break
    return fit | {"weights": w}


def polynomial(x: np.ndarray, degree: int) -> np.ndarray:
    return np.vander(x, degree + 1, increasing=True)


def harmonic(x: np.ndarray, periods: list[float]) -> np.ndarray:
    """[1, sin, cos, sin, cos, ...]."""
    cols = [np.ones_like(x)]
    for p in periods:
        cols += [np.sin(2 * np.pi * x / p), np.cos(2 * np.pi * x / p)]
    return np.stack(cols, 1)


def leverage(a: np.ndarray) -> np.ndarray:
    if len(a) < 2 or a.shape[1] > len(a):
        raise DataError("too few rows for a hat matrix")
    q, _ = np.linalg.qr(a)
    return (q * q).sum(1)


def levenberg_marquardt(f, x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, bool]:
    """Parameters of f(x, p) by damped least squares with a numeric Jacobian."""
    p, lam = np.asarray(start, float).copy(), 1e-3
    r = f(x, p) - y
    cost = r @ r
    for _ in range(rounds):
        j = np.empty((len(x), len(p)))
        for k in range(len(p)):
            h = 1e-5 * max(1.0, abs(p[k]))
            q = p.copy()
            q[k] += h
            j[:, k] = (f(x, q) - f(x, p)) / h
        n, g = j.T @ j, j.T @ r
        for _ in range(30):
            step = np.linalg.solve(n + lam * np.diag(np.diag(n) + 1e-12), -g)
            r2 = f(x, p + step) - y
            if np.isfinite(r2).all() and r2 @ r2 < cost:
                gain = cost - r2 @ r2
                p, r, cost, lam = p + step, r2, r2 @ r2, lam / 10
                if gain <= tol * (cost + tol) or np.abs(step).max() < tol:
                    return p, True
                break
            lam *= 10
        else:
            return p, True
    return p, False


def nelder_mead(f, start, step: float | np.ndarray = 0.1, rounds: int = 1000, tol: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """Simplex search with reflection 1, expansion 2, contraction and shrinkage 1/2; stops when the values agree."""
    x0 = np.asarray(start, float)
    n = len(x0)
    s = np.vstack([x0, x0 + np.diag(np.where(x0 != 0, np.abs(x0) * step, step) if np.isscalar(step) else step)])
    v = np.array([f(p) for p in s])
    for _ in range(rounds):
        o = np.argsort(v, kind="stable")
        s, v = s[o], v[o]
        if np.std(v) < tol:
            return s[0], float(v[0]), True
        c = s[:-1].mean(0)
        r = c + (c - s[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + 2 * (c - s[-1])
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < v[-1] else s[-1]) - c)
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                v[1:] = [f(p) for p in s[1:]]
    return s[0], float(v[0]), False


def randomized_svd(a: np.ndarray, rank: int, oversample: int = 10, power: int = 2, seed: int = 42):
    k = min(rank + oversample, *a.shape)
    q, _ = np.linalg.qr(a @ np.random.default_rng(seed).normal(size=(a.shape[1], k)))
    for _ in range(power):
        q, _ = np.linalg.qr(a.T @ q)
        q, _ = np.linalg.qr(a @ q)
    u, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    return (q @ u)[:, :rank], s[:rank], vt[:rank]


class Svd:
    """The thin singular value decomposition of a matrix, and what is read off it."""

    def __init__(self, a: np.ndarray):
        self.u, self.s, self.vt = np.linalg.svd(np.asarray(a, float), full_matrices=False)

    def rank(self, tol: float | None = None) -> int:
        top = self.s[0] if len(self.s) else 0.0
        return int((self.s > (tol if tol is not None else max(self.u.shape[0], self.vt.shape[1]) * np.finfo(float).eps * top)).sum())

    def condition(self) -> float:
        return float(self.s[0] / self.s[-1]) if len(self.s) and self.s[-1] > 0 else math.inf

    def explained(self) -> np.ndarray:
        """Share of the sum of squares of each component."""
        total = float((self.s**2).sum())
        return self.s**2 / total if total > 0 else np.zeros_like(self.s)

    def truncated(self, k: int) -> np.ndarray:
        """The nearest matrix of rank k."""
        return (self.u[:, :k] * self.s[:k]) @ self.vt[:k]

    def pinv(self, tol: float | None = None) -> np.ndarray:
        k = self.rank(tol)
        return (self.vt[:k].T / self.s[:k]) @ self.u[:, :k].T


def hankel(x: np.ndarray, window: int) -> np.ndarray:
    """Rows of `window` consecutive values."""
    return np.lib.stride_tricks.sliding_window_view(x, window)


def lag_matrix(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the last `lags` values, newest first; the value that follows)."""
    return np.stack([x[lags - k : len(x) - k] for k in range(1, lags + 1)], 1), x[lags:]


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    c = x - x.mean()
    d = (c * c).sum()
    return np.array([(c[: len(c) - k] * c[k:]).sum() / d for k in range(lags + 1)])


def pacf(x: np.ndarray, lags: int) -> np.ndarray:
    """By the Yule-Walker system of each lag."""
    r = acf(x, lags)
    out = [1.0]
    for k in range(1, lags + 1):
        t = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        out.append(float(np.linalg.solve(t, r[1 : k + 1])[-1]))
    return np.array(out)


def hurst(x: np.ndarray) -> float:
    """Slope of log R/S on log length over lengths 4, 8, ... up to half the series, and all of it."""
    n = len(x)
    if n < 20:
        raise DataError("a Hurst exponent needs 20 values")
    lengths = [m for m in (4 * 2**k for k in range(60)) if m <= n // 2] + [n]
    pts = []
    for m in lengths:
        b = x[: n // m * m].reshape(-1, m)
        z = np.cumsum(b - b.mean(1, keepdims=True), 1)
        s = b.std(1)
        rs = (z.max(1) - z.min(1))[s > 0] / s[s > 0]
        if len(rs) and rs.mean() > 0:
            pts.append((np.log(m), np.log(rs.mean())))
    return float(np.polyfit(*zip(*pts, strict=True), 1)[0])

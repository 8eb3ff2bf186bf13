"""Geodesy as column expressions: ellipsoids, coordinate changes, distances. Angles in degrees, lengths in metres."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inv_f: float

    @property
    def f(self) -> float:
        return 1 / self.inv_f

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    def prime_vertical(self, lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return F.lit(self.a) / F.sqrt(1 - self.e2 * s * s)

    def meridional(self, lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return F.lit(self.a * (1 - self.e2)) / F.pow(1 - self.e2 * s * s, 1.5)

    def mean_radius(self, lat: Column) -> Column:
        return F.sqrt(self.meridional(lat) * self.prime_vertical(lat))

    def parallel_radius(self, lat: Column) -> Column:
        return self.prime_vertical(lat) * F.cos(F.radians(lat))


# Semi-major axis and inverse flattening.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
BESSEL = Ellipsoid(6377397.155, 299.1528128)
KRASOVSKY = Ellipsoid(6378245.0, 298.3)
CLARKE1866 = Ellipsoid(6378206.4, 294.978698214)
SPHERE_RADIUS = 6371000.0


def geod_to_ecef(lat: Column, lon: Column, h: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    n, p, l = e.prime_vertical(lat), F.radians(lat), F.radians(lon)
    return (n + h) * F.cos(p) * F.cos(l), (n + h) * F.cos(p) * F.sin(l), (n * (1 - e.e2) + h) * F.sin(p)


def ecef_to_geod(x: Column, y: Column, z: Column, e: Ellipsoid = WGS84, rounds: int = 6) -> tuple[Column, Column, Column]:
    """Latitude, longitude, height. Bowring's start and a few fixed-point steps, unrolled: one expression, no UDF."""
    p = F.hypot(x, y)
    ep2 = e.e2 / (1 - e.e2)
    u = F.atan2(z * e.a, p * e.b)
    for _ in range(rounds // 2):
        lat = F.atan2(z + ep2 * e.b * F.pow(F.sin(u), 3), p - e.e2 * e.a * F.pow(F.cos(u), 3))
        u = F.atan2(F.sin(lat) * (1 - e.f), F.cos(lat))
    s, c = F.sin(lat), F.cos(lat)
    n = F.lit(e.a) / F.sqrt(1 - e.e2 * s * s)
    h = F.when(F.abs(lat) < math.pi / 4, p / c - n).otherwise(z / s - n * (1 - e.e2))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), h


def sphere_to_ecef(lat: Column, lon: Column, r: Column) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)
    return r * F.cos(p) * F.cos(l), r * F.cos(p) * F.sin(l), r * F.sin(p)


def ecef_to_sphere(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return F.degrees(F.atan2(z, F.hypot(x, y))), F.degrees(F.atan2(y, x)), F.sqrt(x * x + y * y + z * z)


def ecef_to_enu(x: Column, y: Column, z: Column, lat0: Column, lon0: Column, h0: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    x0, y0, z0 = geod_to_ecef(lat0, lon0, h0, e)
    p, l = F.radians(lat0), F.radians(lon0)
    dx, dy, dz = x - x0, y - y0, z - z0
    return (
        -F.sin(l) * dx + F.cos(l) * dy,
        -F.sin(p) * F.cos(l) * dx - F.sin(p) * F.sin(l) * dy + F.cos(p) * dz,
        F.cos(p) * F.cos(l) * dx + F.cos(p) * F.sin(l) * dy + F.sin(p) * dz,
    )


def enu_to_ecef(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, h0: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    x0, y0, z0 = geod_to_ecef(lat0, lon0, h0, e)
    p, l = F.radians(lat0), F.radians(lon0)
    return (
        x0 - F.sin(l) * east - F.sin(p) * F.cos(l) * north + F.cos(p) * F.cos(l) * up,
        y0 + F.cos(l) * east - F.sin(p) * F.sin(l) * north + F.cos(p) * F.sin(l) * up,
        z0 + F.cos(p) * north + F.sin(p) * up,
    )


def geod_to_enu(lat: Column, lon: Column, h: Column, lat0: Column, lon0: Column, h0: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    return ecef_to_enu(*geod_to_ecef(lat, lon, h, e), lat0, lon0, h0, e)


def enu_to_geod(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, h0: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    return ecef_to_geod(*enu_to_ecef(east, north, up, lat0, lon0, h0, e), e)


def geod_to_sphere(lat: Column, lon: Column, h: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    return ecef_to_sphere(*geod_to_ecef(lat, lon, h, e))


def sphere_to_geod(lat: Column, lon: Column, r: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    return ecef_to_geod(*sphere_to_ecef(lat, lon, r), e)


def enu_to_aes(east: Column, north: Column, up: Column) -> tuple[Column, Column, Column]:
    """Azimuth from north (0 to 360), elevation, slant range."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.degrees(F.atan2(up, F.hypot(east, north))), F.sqrt(east * east + north * north + up * up)


def aes_to_enu(az: Column, el: Column, s: Column) -> tuple[Column, Column, Column]:
    a, e = F.radians(az), F.radians(el)
    return s * F.cos(e) * F.sin(a), s * F.cos(e) * F.cos(a), s * F.sin(e)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE_RADIUS) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def vincenty_inverse_np(lat1, lon1, lat2, lon2, e: Ellipsoid = WGS84, rounds: int = 200) -> np.ndarray:
    """Distance and the two azimuths of each pair; NaN where the iteration does not settle (near antipodes)."""
    u1, u2 = (np.arctan((1 - e.f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    big_l = np.radians(np.asarray(lon2, float) - lon1)
    lam = big_l.copy()
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sig = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / ss, 0.0)
            c2a = 1 - sa * sa
            c2m = np.where(c2a > 0, cs - 2 * su1 * su2 / c2a, 0.0)
            c = e.f / 16 * c2a * (4 + e.f * (4 - 3 * c2a))
            new = big_l + (1 - c) * e.f * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        k = c2a * (e.a**2 - e.b**2) / e.b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        s = np.where(done, e.b * big_a * (sig - ds), np.nan)
        a1 = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))) % 360
        a2 = np.degrees(np.arctan2(cu1 * np.sin(lam), -su1 * cu2 + cu1 * su2 * np.cos(lam))) % 360
    return np.stack([s, a1, a2], 1)


def vincenty_direct_np(lat1, lon1, az, s, e: Ellipsoid = WGS84) -> np.ndarray:
    """Latitude, longitude and final azimuth after the distance s."""
    a1, u1 = np.radians(az), np.arctan((1 - e.f) * np.tan(np.radians(lat1)))
    s1 = np.arctan2(np.tan(u1), np.cos(a1))
    sa = np.cos(u1) * np.sin(a1)
    c2a = 1 - sa * sa
    k = c2a * (e.a**2 - e.b**2) / e.b**2
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sig = np.asarray(s, float) / (e.b * big_a)
    for _ in range(200):
        c2m, ss, cs = np.cos(2 * s1 + sig), np.sin(sig), np.cos(sig)
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        new = s / (e.b * big_a) + ds
        if np.abs(new - sig).max(initial=0) < 1e-12:
            break
        sig = new
    ss, cs, c2m = np.sin(sig), np.cos(sig), np.cos(2 * s1 + sig)
    t = np.sin(u1) * ss - np.cos(u1) * cs * np.cos(a1)
    lat = np.arctan2(np.sin(u1) * cs + np.cos(u1) * ss * np.cos(a1), (1 - e.f) * np.hypot(sa, t))
    lam = np.arctan2(ss * np.sin(a1), np.cos(u1) * cs - np.sin(u1) * ss * np.cos(a1))
    c = e.f / 16 * c2a * (4 + e.f * (4 - 3 * c2a))
    dl = lam - (1 - c) * e.f * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return np.stack([np.degrees(lat), (np.asarray(lon1) + np.degrees(dl) + 180) % 360 - 180, np.degrees(np.arctan2(sa, -t)) % 360], 1)


def vincenty_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, e: Ellipsoid = WGS84) -> Column:
    """struct(distance, azimuth1, azimuth2), iterated in numpy over Arrow batches."""

    @F.pandas_udf("distance double, azimuth1 double, azimuth2 double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(vincenty_inverse_np(*(x.to_numpy(float) for x in (a, b, c, d)), e), columns=["distance", "azimuth1", "azimuth2"])

    return run(lat1, lon1, lat2, lon2)


def vincenty_direct(lat: Column, lon: Column, az: Column, s: Column, e: Ellipsoid = WGS84) -> Column:
    @F.pandas_udf("lat double, lon double, azimuth double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(vincenty_direct_np(*(x.to_numpy(float) for x in (a, b, c, d)), e), columns=["lat", "lon", "azimuth"])

    return run(lat, lon, az, s)


# ---- covariance ----------------------------------------------------------------------------------------------------


def enu_rotation(lat: float, lon: float) -> np.ndarray:
    p, l = math.radians(lat), math.radians(lon)
    return np.array([[-math.sin(l), math.cos(l), 0], [-math.sin(p) * math.cos(l), -math.sin(p) * math.sin(l), math.cos(p)], [math.cos(p) * math.cos(l), math.cos(p) * math.sin(l), math.sin(p)]])


def geod_np(lat: float, lon: float, h: float, e: Ellipsoid = WGS84) -> np.ndarray:
    p, l = math.radians(lat), math.radians(lon)
    n = e.a / math.sqrt(1 - e.e2 * math.sin(p) ** 2)
    return np.array([(n + h) * math.cos(p) * math.cos(l), (n + h) * math.cos(p) * math.sin(l), (n * (1 - e.e2) + h) * math.sin(p)])


def ecef_np(x: np.ndarray, e: Ellipsoid = WGS84) -> np.ndarray:
    p = math.hypot(x[0], x[1])
    lat = math.atan2(x[2], p * (1 - e.e2))
    for _ in range(10):
        n = e.a / math.sqrt(1 - e.e2 * math.sin(lat) ** 2)
        lat = math.atan2(x[2] + e.e2 * n * math.sin(lat), p)
    n = e.a / math.sqrt(1 - e.e2 * math.sin(lat) ** 2)
    h = p / math.cos(lat) - n if abs(lat) < math.pi / 4 else x[2] / math.sin(lat) - n * (1 - e.e2)
    return np.array([math.degrees(lat), math.degrees(math.atan2(x[1], x[0])), h])


def jacobian(f, x: np.ndarray) -> np.ndarray:
    """Central differences. Steps of the cube root of the rounding unit balance rounding against curvature."""
    cols, most = [], np.abs(x).max()
    for k in range(len(x)):
        d = np.zeros(len(x))
        d[k] = 6e-6 * max(1.0, abs(x[k]), 1e-3 * most)
        cols.append((f(x + d) - f(x - d)) / (2 * d[k]))
    return np.stack(cols, 1)


def sphere_np(x: np.ndarray) -> np.ndarray:
    return np.array([math.degrees(math.atan2(x[2], math.hypot(x[0], x[1]))), math.degrees(math.atan2(x[1], x[0])), float(np.linalg.norm(x))])


def from_sphere_np(x: np.ndarray) -> np.ndarray:
    p, l = math.radians(x[0]), math.radians(x[1])
    return x[2] * np.array([math.cos(p) * math.cos(l), math.cos(p) * math.sin(l), math.sin(p)])


def _changes(e: Ellipsoid, origin: tuple[float, float, float] | None) -> dict:
    o = origin or (0.0, 0.0, 0.0)
    r, x0 = enu_rotation(o[0], o[1]), geod_np(*o, e)
    to = {"ecef": lambda x: x, "geod": lambda x: geod_np(*x, e), "sphere": from_sphere_np, "enu": lambda x: x0 + r.T @ x}
    back = {"ecef": lambda x: x, "geod": lambda x: ecef_np(x, e), "sphere": sphere_np, "enu": lambda x: r @ (x - x0)}
    return {(a, b): (lambda x, a=a, b=b: back[b](to[a](x))) for a in to for b in to if a != b}


def transform_with_covariance(pos: Column, cov: Column, source: str, target: str, origin: tuple[float, float, float] | None = None, e: Ellipsoid = WGS84) -> Column:
    """struct(pos, cov) in the target system, covariance by J C J'. Systems: ecef, geod, sphere, enu (about origin)."""

    @F.pandas_udf("pos array<double>, cov array<array<double>>")
    def run(p: pd.Series, c: pd.Series) -> pd.DataFrame:
        f = _changes(e, origin)[source, target]
        rows = []
        for x, m in zip(p, c, strict=True):
            x = np.asarray(x, float)
            j = jacobian(f, x)
            q = None if m is None else (j @ np.array([np.asarray(r, float) for r in m]) @ j.T).tolist()
            rows.append((f(x).tolist(), q))
        return pd.DataFrame(rows, columns=["pos", "cov"])

    return run(pos, cov)


def monte_carlo_check(pos, cov, source: str, target: str, n: int = 100_000, origin=None, e: Ellipsoid = WGS84, seed: int = 42) -> float:
    """Largest relative difference between propagated and simulated variances."""
    f = _changes(e, origin)[source, target]
    x, c = np.asarray(pos, float), np.asarray(cov, float)
    j = jacobian(f, x)
    want = np.diag(j @ c @ j.T)
    try:
        l = np.linalg.cholesky(c)
    except np.linalg.LinAlgError:
        l = np.eye(len(x))
    draws = x + np.random.default_rng(seed).normal(size=(n, len(x))) @ l.T
    got = np.var([f(d) for d in draws], axis=0, ddof=1)
    return float(np.max(np.abs(got - want) / np.where(want > 0, want, 1)))

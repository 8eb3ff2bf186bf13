"""Satellite positioning: broadcast and precise orbits, atmosphere, visibility, single-point and precise solutions.

Orbits and corrections are numpy functions of one epoch; epochs of a station are independent for single points (grouped
by epoch) and sequential for the precise filter (grouped by station).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.geodesy import ecef_np, enu_rotation
from cadenza.functions.numeric import lagrange

# Speed of light, Earth rotation, gravity constants by system, frequencies (MHz), pseudorange priorities.
C = 299792458.0
OMEGA_E = 7.2921151467e-5
MU = {"G": 3.986005e14, "E": 3.986004418e14, "C": 3.986004418e14, "R": 3.9860044e14, "S": 3.986005e14}
FREQ = {"G": (1575.42, 1227.60), "E": (1575.42, 1176.45), "C": (1561.098, 1207.14)}
CODES = {"G": ["C1C", "C1W", "C1P", "C1X"], "E": ["C1C", "C1X", "C1B"], "R": ["C1C", "C1P"], "C": ["C2I", "C1I", "C1X"], "S": ["C1C"]}
PR_RANGE = (1e6, 4.5e7)


def kepler(eph: dict, t: float) -> tuple[np.ndarray, float]:
    """Position (Earth-fixed at t) and clock with relativity, from one broadcast record; t in GPS seconds."""
    mu = MU.get(eph["system"], MU["G"])
    a = eph["sqrt_a"] ** 2
    toe = eph["week"] * 604800.0 + eph["toe"]
    tk = t - toe
    m = eph["m0"] + (math.sqrt(mu / a**3) + eph["delta_n"]) * tk
    e = eph["e"]
    ea = m
    for _ in range(30):
        d = (ea - e * math.sin(ea) - m) / (1 - e * math.cos(ea))
        ea -= d
        if abs(d) < 1e-13:
            break
    v = math.atan2(math.sqrt(1 - e * e) * math.sin(ea), math.cos(ea) - e)
    phi = v + eph["omega"]
    s2, c2 = math.sin(2 * phi), math.cos(2 * phi)
    u = phi + eph["cus"] * s2 + eph["cuc"] * c2
    r = a * (1 - e * math.cos(ea)) + eph["crs"] * s2 + eph["crc"] * c2
    i = eph["i0"] + eph["idot"] * tk + eph["cis"] * s2 + eph["cic"] * c2
    geo = eph["system"] == "C" and int(eph["sat"][1:]) <= 5
    om = eph["omega0"] + (eph["omega_dot"] - (0 if geo else OMEGA_E)) * tk - OMEGA_E * eph["toe"]
    x, y = r * math.cos(u), r * math.sin(u)
    p = np.array([x * math.cos(om) - y * math.cos(i) * math.sin(om), x * math.sin(om) + y * math.cos(i) * math.cos(om), y * math.sin(i)])
    if geo:
        f, w = math.radians(-5), OMEGA_E * tk
        rx = np.array([[1, 0, 0], [0, math.cos(f), math.sin(f)], [0, -math.sin(f), math.cos(f)]])
        rz = np.array([[math.cos(w), math.sin(w), 0], [-math.sin(w), math.cos(w), 0], [0, 0, 1]])
        p = rz @ rx @ p
    dt = t - eph["toc"]
    clk = eph["af0"] + eph["af1"] * dt + eph["af2"] * dt * dt - 2 * math.sqrt(mu * a) * e * math.sin(ea) / C**2
    return p, clk


def glonass(eph: dict, t: float, step: float = 60.0) -> tuple[np.ndarray, float]:
    """Runge-Kutta integration of position, velocity and the given acceleration in the rotating frame."""
    ae, j2, mu = 6378136.0, 1.0826257e-3, MU["R"]
    s = np.array(eph["state"], float)
    y, acc = s[:6].copy(), s[6:9]

    def f(y: np.ndarray) -> np.ndarray:
        p, v = y[:3], y[3:]
        r = np.linalg.norm(p)
        k = 1.5 * j2 * mu * ae**2 / r**5
        z = 5 * p[2] ** 2 / r**2
        a = -mu / r**3 * p - k * p * np.array([1 - z, 1 - z, 3 - z]) + acc
        a[:2] += OMEGA_E**2 * p[:2] + 2 * OMEGA_E * np.array([v[1], -v[0]])
        return np.append(v, a)

    left = t - eph["toc"]
    while abs(left) > 1e-9:
        h = math.copysign(min(step, abs(left)), left)
        k1 = f(y)
        k2 = f(y + h / 2 * k1)
        k3 = f(y + h / 2 * k2)
        k4 = f(y + h * k3)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        left -= h
    return y[:3], eph["af0"] + eph["af1"] * (t - eph["toc"])


def nearest_ephemeris(records: list[dict], t: float) -> dict | None:
    """Of one satellite's healthy records the one whose reference time is nearest; the first wins a tie."""
    ref = lambda r: r["toc"] if r["system"] in "RS" else r["week"] * 604800.0 + r["toe"]
    ok = [r for r in records if not r.get("health")]
    return min(ok, key=lambda r: abs(ref(r) - t)) if ok else None


def broadcast_position(records: list[dict], t: float) -> tuple[np.ndarray, float] | None:
    r = nearest_ephemeris(records, t)
    return None if r is None else (glonass if r["system"] in "RS" else kepler)(r, t)


def precise_position(ts: np.ndarray, xyz: np.ndarray, clk: np.ndarray, t: float) -> tuple[np.ndarray, float] | None:
    """Lagrange orbit and linear clock; valid to one interval beyond the ends."""
    if len(ts) < 2:
        return None
    step = float(np.median(np.diff(ts)))
    if not ts[0] - step <= t <= ts[-1] + step:
        return None
    return np.array([lagrange(ts, xyz[:, k], t) for k in range(3)]), float(np.interp(t, ts, clk))


def sagnac(p: np.ndarray, tau: float) -> np.ndarray:
    w = OMEGA_E * tau
    return np.array([p[0] * math.cos(w) + p[1] * math.sin(w), -p[0] * math.sin(w) + p[1] * math.cos(w), p[2]])


def azimuth_elevation(rec: np.ndarray, sat: np.ndarray) -> tuple[float, float]:
    g = ecef_np(rec)
    e, n, u = enu_rotation(g[0], g[1]) @ (sat - rec)
    return math.degrees(math.atan2(e, n)) % 360, math.degrees(math.atan2(u, math.hypot(e, n)))


def klobuchar(lat: float, lon: float, az: float, el: float, t: float, alpha: list[float], beta: list[float]) -> float:
    """Ionospheric delay in metres on the first frequency; values out of range count as none."""
    e, a = el / 180, math.radians(az)
    psi = 0.0137 / (e + 0.11) - 0.022
    phi = max(-0.416, min(0.416, lat / 180 + psi * math.cos(a)))
    lam = lon / 180 + psi * math.sin(a) / math.cos(phi * math.pi)
    pm = phi + 0.064 * math.cos((lam - 1.617) * math.pi)
    tt = (43200 * lam + t) % 86400
    amp, per = max(0.0, sum(c * pm**k for k, c in enumerate(alpha))), max(72000.0, sum(c * pm**k for k, c in enumerate(beta)))
    x = 2 * math.pi * (tt - 50400) / per
    d = C * (1 + 16 * (0.53 - e) ** 3) * (5e-9 + (amp * (1 - x * x / 2 + x**4 / 24) if abs(x) < 1.57 else 0))
    return d if math.isfinite(d) and 0 <= d <= 50 else 0.0


def saastamoinen(lat: float, h: float, humidity: float = 0.5) -> tuple[float, float]:
    """Hydrostatic and wet zenith delay under a standard atmosphere."""
    p, t = 1013.25 * (1 - 2.2557e-5 * h) ** 5.2568, 288.15 - 6.5e-3 * h
    e = 6.108 * humidity * math.exp((17.15 * t - 4684) / (t - 38.45))
    return 0.0022768 * p / (1 - 0.00266 * math.cos(2 * math.radians(lat)) - 2.8e-7 * h), 0.002277 * (1255 / t + 0.05) * e


# Niell's coefficients at 15, 30, 45, 60 and 75 degrees (average, amplitude, wet) and for height.
NIELL_LAT = [15.0, 30.0, 45.0, 60.0, 75.0]
NIELL_AVG = [[1.2769934e-3, 1.2683230e-3, 1.2465397e-3, 1.2196049e-3, 1.2045996e-3], [2.9153695e-3, 2.9152299e-3, 2.9288445e-3, 2.9022565e-3, 2.9024912e-3], [62.610505e-3, 62.837393e-3, 63.721774e-3, 63.824265e-3, 64.258455e-3]]
NIELL_AMP = [[0.0, 1.2709626e-5, 2.6523662e-5, 3.4000452e-5, 4.1202191e-5], [0.0, 2.1414979e-5, 3.0160779e-5, 7.2562722e-5, 11.723375e-5], [0.0, 9.0128400e-5, 4.3497037e-5, 84.795348e-5, 170.37206e-5]]
NIELL_WET = [[5.8021897e-4, 5.6794847e-4, 5.8118019e-4, 5.9727542e-4, 6.1641693e-4], [1.4275268e-3, 1.5138625e-3, 1.4572752e-3, 1.5007428e-3, 1.7599082e-3], [4.3472961e-2, 4.6729510e-2, 4.3908931e-2, 4.4626982e-2, 5.4736038e-2]]
NIELL_HEIGHT = (2.53e-5, 5.49e-3, 1.14e-3)


def niell(lat: float, h: float, doy: float, el: float) -> tuple[float, float]:
    """Hydrostatic and wet mapping functions."""
    f = lambda s, a, b, c: (1 + a / (1 + b / (1 + c))) / (s + a / (s + b / (s + c)))
    s = math.sin(math.radians(el))
    day = 2 * math.pi * (doy - 28 + (182.5 if lat < 0 else 0)) / 365.25
    at = lambda row: float(np.interp(abs(lat), NIELL_LAT, row))
    hyd = [at(a) - at(b) * math.cos(day) for a, b in zip(NIELL_AVG, NIELL_AMP, strict=True)]
    return f(s, *hyd) + (1 / s - f(s, *NIELL_HEIGHT)) * h / 1000, f(s, *[at(r) for r in NIELL_WET])


def water_vapour(zwd: float, surface_temperature: float) -> float:
    """Integrated water vapour (kg/m2) from the wet zenith delay."""
    tm = 70.2 + 0.72 * surface_temperature
    return 1e6 * zwd / (461.5 * (22.1e-2 + 3739.0 / tm) * 1e-2) * 1e-2


def saastamoinen_col(lat: Column, h: Column) -> Column:
    """The hydrostatic zenith delay as an expression."""
    p = 1013.25 * F.pow(1 - 2.2557e-5 * h, 5.2568)
    return 0.0022768 * p / (1 - 0.00266 * F.cos(2 * F.radians(lat)) - 2.8e-7 * h)


def pick_code(obs: dict[str, float], system: str) -> float | None:
    return next((obs[c] for c in CODES.get(system, []) if c in obs and PR_RANGE[0] < obs[c] < PR_RANGE[1]), None)


def dop(rec: np.ndarray, sats: np.ndarray) -> dict | None:
    if len(sats) < 4:
        return None
    u = (sats - rec) / np.linalg.norm(sats - rec, axis=1)[:, None]
    g = ecef_np(rec)
    r = np.eye(4)
    r[:3, :3] = enu_rotation(g[0], g[1])
    a = np.column_stack([-u, np.ones(len(u))])
    try:
        q = r @ np.linalg.inv(a.T @ a) @ r.T
    except np.linalg.LinAlgError:
        return None
    d = np.diag(q)
    return {"gdop": math.sqrt(d.sum()), "pdop": math.sqrt(d[:3].sum()), "hdop": math.sqrt(d[:2].sum()), "vdop": math.sqrt(d[2]), "tdop": math.sqrt(d[3])}


def spp_epoch(t: float, sats: list[str], pr: list[float], position, alpha=None, beta=None, mask: float = 10.0, start=None, rounds: int = 15) -> dict:
    """Weighted Gauss-Newton for one epoch; a clock for GPS, and a bias for each further system with two satellites."""
    x = np.zeros(3) if start is None else np.asarray(start, float).copy()
    extra = sorted({s[0] for s in sats if s[0] != "G" and sum(q[0] == s[0] for q in sats) >= 2})
    use = [i for i, s in enumerate(sats) if s[0] == "G" or s[0] in extra]
    clk, bias = 0.0, np.zeros(len(extra))
    out = {"t": t, "converged": False, "n_sats": len(use), "x": None, "y": None, "z": None, "clock": None, "sigma0": None}
    for it in range(rounds):
        rows, res, w, sp = [], [], [], []
        far = np.linalg.norm(x) < 1e6
        for i in use:
            tau = pr[i] / C
            got = position(sats[i], t - tau)
            if got is None:
                continue
            p = sagnac(got[0], tau)
            p_clk = got[1]
            rho = float(np.linalg.norm(p - x))
            corr, wt = 0.0, 1.0
            if not far:
                az, el = azimuth_elevation(x, p)
                if el < mask and it > 2:
                    continue
                g = ecef_np(x)
                s = max(math.sin(math.radians(max(el, 1))), 0.05)
                corr = sum(saastamoinen(g[0], min(max(g[2], -100), 9000))) / s
                if alpha:
                    corr += klobuchar(g[0], g[1], az, max(el, 1), t % 604800, alpha, beta)
                wt = s * s
            b = bias[extra.index(sats[i][0])] if sats[i][0] in extra else 0.0
            res.append(pr[i] - (rho + clk + b - C * p_clk + corr))
            rows.append([*((x - p) / rho), 1.0, *[float(sats[i][0] == e) for e in extra]])
            w.append(wt), sp.append(p)
        a, v, w_ = np.array(rows), np.array(res), np.array(w)
        if len(a) < 4 + len(extra):
            return out
        try:
            d = np.linalg.solve(a.T @ (a * w_[:, None]), a.T @ (w_ * v))
        except np.linalg.LinAlgError:
            return out
        x, clk, bias = x + d[:3], clk + d[3], bias + d[4:]
        if np.abs(d[:3]).max() < 1e-4 and it > 3:
            dof = len(v) - len(d)
            return out | {"converged": True, "n_sats": len(v), "x": x[0], "y": x[1], "z": x[2], "clock": clk / C, "sigma0": math.sqrt(float((w_ * v * v).sum()) / dof) if dof > 0 else math.nan, **(dop(x, np.array(sp)) or {})}
    return out


SPP = "t double, converged boolean, n_sats int, x double, y double, z double, clock double, sigma0 double, gdop double, pdop double, hdop double, vdop double, tdop double"


#: Seconds of the day that a record of one day may also serve on the next and the one before.
REACH = 14_400.0


def _by_day(df: DataFrame, t: str = "t", reach: float = REACH) -> DataFrame:
    """Rows with the day of their time, and again with a neighbouring day that is within reach."""
    day = lambda c: F.floor(c / 86400).cast("bigint")
    days = F.array_distinct(F.array(day(F.col(t)), day(F.col(t) - reach), day(F.col(t) + reach)))
    return df.withColumn("_day", F.explode(days))


def spp(obs: DataFrame, nav: DataFrame, mask: float = 10.0, alpha: list[float] | None = None, beta: list[float] | None = None) -> DataFrame:
    """A solution for each epoch. Observations and ephemerides meet by day, so a task holds one day of either."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list[dict]] = {}
        for r in right.to_dict("records"):
            by.setdefault(r["sat"], []).append(r)
        out = []
        for t, g in left.groupby("t"):
            pairs = [(s, pick_code(dict(o), s[0])) for s, o in sorted(zip(g["sat"], g["obs"], strict=True), key=lambda p: p[0])]
            pairs = [(s, p) for s, p in pairs if p is not None]
            out.append(spp_epoch(float(t), [s for s, _ in pairs], [p for _, p in pairs], lambda s, u: broadcast_position(by.get(s, []), u), alpha, beta, mask))
        return pd.DataFrame(out).reindex(columns=[c.split()[0] for c in SPP.split(", ")])

    o = obs.select("t", "sat", "obs", F.floor(F.col("t") / 86400).cast("bigint").alias("_day"))
    ref = F.when(F.col("system").isin("R", "S"), F.col("toc")).otherwise(F.col("week") * 604800.0 + F.col("toe"))
    e = _by_day(nav.drop("path").withColumn("_t", ref), "_t").drop("_t")
    return o.groupBy("_day").cogroup(e.groupBy("_day")).applyInPandas(run, SPP)


def iono_free(a: float, b: float, system: str) -> float:
    f1, f2 = FREQ[system]
    return (f1 * f1 * a - f2 * f2 * b) / (f1 * f1 - f2 * f2)


class PppFilter:
    """Extended Kalman filter over position, clock, wet zenith delay and one ambiguity for each satellite."""

    def __init__(self, start, sigma_code: float = 0.3, sigma_phase: float = 0.003, slip: float = 0.05, forget: int = 10, zwd_walk: float = 1e-8, kinematic: bool = False):
        self.x = np.array([*start, 0.0, 0.1])
        self.p = np.diag([100.0**2] * 3 + [1e10, 0.3**2])
        self.sats: list[str] = []
        self.gf: dict[str, float] = {}
        self.seen: dict[str, int] = {}
        self.k, self.sc, self.sp, self.slip, self.forget, self.walk, self.kin, self.last = 0, sigma_code, sigma_phase, slip, forget, zwd_walk, kinematic, None

    def step(self, t: float, obs: list[tuple[str, float, float, float]], position, shift: np.ndarray | None = None) -> dict:
        """obs: (satellite, code and phase without ionosphere in metres, geometry-free phase).

        position(satellite) gives the place at transmission, turned with the Earth, and the clock in seconds, or None;
        shift: what is added to the station's place, of tides and the antenna.
        """
        shift = np.zeros(3) if shift is None else shift
        self.k += 1
        dt = 0.0 if self.last is None else t - self.last
        self.last = t
        self.x[3], self.p[3, :], self.p[:, 3] = 0.0, 0.0, 0.0
        self.p[3, 3] = 1e10
        self.p[4, 4] += self.walk * dt
        if self.kin:
            self.p[:3, :3] += 100.0 * np.eye(3)
        for s in [s for s in self.sats if self.k - self.seen[s] > self.forget]:
            i = 5 + self.sats.index(s)
            self.x, self.p = np.delete(self.x, i), np.delete(np.delete(self.p, i, 0), i, 1)
            self.sats.remove(s)
        used = 0
        for s, code, phase, gf in obs:
            got = position(s)
            if got is None:
                continue
            p = got[0] - shift
            rho = float(np.linalg.norm(p - self.x[:3]))
            _, el = azimuth_elevation(self.x[:3], p)
            if el < 7:
                continue
            se = max(math.sin(math.radians(el)), 0.05)
            g = ecef_np(self.x[:3])
            zhd, _ = saastamoinen(g[0], min(max(g[2], -100), 9000))
            mh, mw = niell(g[0], g[2], (t / 86400) % 365.25, el)
            slipped = s in self.gf and abs(gf - self.gf[s]) > self.slip / se
            self.gf[s], self.seen[s] = gf, self.k
            if s not in self.sats or slipped:
                if s not in self.sats:
                    self.sats.append(s)
                    self.x, n = np.append(self.x, 0.0), len(self.p)
                    q = np.zeros((n + 1, n + 1))
                    q[:n, :n] = self.p
                    self.p = q
                i = 5 + self.sats.index(s)
                self.x[i], self.p[i, :], self.p[:, i] = phase - code, 0.0, 0.0
                self.p[i, i] = 1e4
            i = 5 + self.sats.index(s)
            for z, sd, amb in ((code, self.sc / se, 0), (phase, self.sp / se, 1)):
                h = np.zeros(len(self.x))
                h[:3], h[3], h[4], h[i] = (self.x[:3] - p) / rho, 1.0, mw, float(amb)
                v = z - (float(np.linalg.norm(p - self.x[:3])) + self.x[3] - C * got[1] + zhd * mh + self.x[4] * mw + amb * self.x[i])
                sv = float(h @ self.p @ h) + sd * sd
                kg = self.p @ h / sv
                a = np.eye(len(h)) - np.outer(kg, h)
                self.x = self.x + kg * v
                self.p = a @ self.p @ a.T + sd * sd * np.outer(kg, kg)
                self.p = (self.p + self.p.T) / 2
            used += 1
        return {"t": t, "n_sats": used, "x": self.x[0], "y": self.x[1], "z": self.x[2], "clock": self.x[3] / C, "zwd": self.x[4], "sigma_x": math.sqrt(self.p[0, 0]), "sigma_y": math.sqrt(self.p[1, 1]), "sigma_z": math.sqrt(self.p[2, 2])}


PPP = "t double, n_sats int, x double, y double, z double, clock double, zwd double, sigma_x double, sigma_y double, sigma_z double"
#: Code and phase names on both frequencies of each system, and the names of these frequencies in antenna files.
PAIRS = {"G": ("C1C", "C2W", "L1C", "L2W"), "E": ("C1C", "C5Q", "L1C", "L5Q")}
BANDS = {"G": ("G01", "G02"), "E": ("E01", "E05")}


def combinations(obs: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str, str, str]] | None = None, biases: DataFrame | None = None) -> DataFrame:
    """keys, t, sat, code, phase (without ionosphere, metres) and gf (geometry-free phase) of each row of observations.

    biases (sat, code, bias, unit): what each code or phase is too long, in ns; a code without one counts as unbiased.
    """
    names = pairs or PAIRS
    if biases is not None:
        by = biases.where("unit = 'ns'").groupBy("sat").agg(F.map_from_entries(F.collect_list(F.struct("code", F.col("bias") * (C * 1e-9)))).alias("_bias"))
        obs = obs.join(by, "sat", "left")
    else:
        obs = obs.withColumn("_bias", F.lit(None).cast("map<string,double>"))
    bias = lambda n: F.coalesce(F.try_element_at("_bias", F.lit(n)), F.lit(0.0))
    made = None
    for system, (c1, c2, l1, l2) in names.items():
        f1, f2 = FREQ[system]
        code = [F.try_element_at("obs", F.lit(n)) - bias(n) for n in (c1, c2)]
        phase = [F.try_element_at("obs", F.lit(n)) * (C / (f * 1e6)) - bias(n) for n, f in ((l1, f1), (l2, f2))]
        free = lambda a, b, f1=f1, f2=f2: (f1 * f1 * a - f2 * f2 * b) / (f1 * f1 - f2 * f2)
        row = F.struct(free(*code).alias("code"), free(*phase).alias("phase"), (phase[0] - phase[1]).alias("gf"))
        made = F.when(F.col("sat").startswith(system), row) if made is None else made.when(F.col("sat").startswith(system), row)
    return obs.withColumn("_m", made).select(*keys, "t", "sat", "_m.*").where("code is not null and phase is not null")


def transmitted(rows: DataFrame, orbits: DataFrame, antennas: DataFrame | None = None) -> DataFrame:
    """rows (t, sat, code, ...) with the satellite's place sx, sy, sz at transmission, turned with the Earth, and clock sclk.

    Rows and orbits (t, sat, x, y, z, clock) meet by satellite and day, so a task holds one satellite's day; rows without an
    orbit drop out. antennas (serial, frequency, offset): adds the antenna's place, which the orbit's centre of mass lacks.
    """
    names = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sx double, sy double, sz double, sclk double"
    o = _by_day(orbits.where("clock is not null").select("t", "sat", "x", "y", "z", "clock"))
    if antennas is not None:
        a = antennas.where("offset is not null").groupBy(F.col("serial").alias("sat")).agg(F.map_from_entries(F.collect_list(F.struct("frequency", "offset"))).alias("_off"))
        o = o.join(a, "sat", "left")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*names, "sx", "sy", "sz", "sclk"])
        right = right.drop_duplicates("t").sort_values("t")
        ts, xyz, clk = right["t"].to_numpy(float), right[["x", "y", "z"]].to_numpy(float), right["clock"].to_numpy(float)
        off = right["_off"].iloc[0] if "_off" in right else None
        pco = antenna_offset(dict(off), str(left["sat"].iloc[0])[0]) if off is not None else None
        out = []
        for t, code in zip(left["t"], left["code"], strict=True):
            got = precise_position(ts, xyz, clk, t - code / C)
            if got is None:
                out.append((np.nan,) * 4)
                continue
            p = got[0] if pco is None else got[0] + body_axes(got[0], sun_moon(t)[0]).T @ pco
            # a body that moves gains or loses on its clock
            v = (precise_position(ts, xyz, clk, t - code / C + 0.5)[0] - precise_position(ts, xyz, clk, t - code / C - 0.5)[0]) if ts[0] <= t - code / C - 0.5 and t - code / C + 0.5 <= ts[-1] else np.zeros(3)
            out.append((*sagnac(p, code / C), got[1] - 2 * float(got[0] @ v) / C**2))
        return left[names].assign(**dict(zip(("sx", "sy", "sz", "sclk"), np.array(out).T, strict=True)))

    r = rows.withColumn("_day", F.floor(F.col("t") / 86400).cast("bigint"))
    return r.groupBy("sat", "_day").cogroup(o.groupBy("sat", "_day")).applyInPandas(run, schema).where("not isnan(sx)")


def body_axes(sat: np.ndarray, sun: np.ndarray) -> np.ndarray:
    """Rows: the axes of a satellite that points at the Earth and keeps its panels at the Sun."""
    ez = -sat / np.linalg.norm(sat)
    ey = np.cross(ez, sun - sat)
    ey /= np.linalg.norm(ey)
    return np.array([np.cross(ey, ez), ey, ez])


def antenna_offset(offsets: dict[str, list[float]], system: str) -> np.ndarray | None:
    """The offset of the combination without ionosphere, from those on both frequencies."""
    a, b = (offsets.get(n) for n in BANDS.get(system, ("", "")))
    return None if a is None or b is None else np.array([iono_free(x, y, system) for x, y in zip(a, b, strict=True)])


def ppp(obs: DataFrame, orbits: DataFrame, start: tuple[float, float, float], keys: list[str], pairs: dict[str, tuple[str, str, str, str]] | None = None, biases: DataFrame | None = None, antennas: DataFrame | None = None, antenna_neu: tuple[float, float, float] = (0.0, 0.0, 0.0), tides: bool = True, turns: bool = True) -> DataFrame:
    """The precise filter for each station (keys) with orbits and clocks (t, sat, x, y, z, clock).

    Corrections: code biases and satellite antennas if their tables are given, the receiver's antenna (north, east, up, in
    metres), solid tides, and phase wind-up (turns). Satellites are placed by satellite and day; only the filter itself is
    sequential within a station.
    """
    rows = transmitted(combinations(obs, keys, pairs, biases), orbits, antennas)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, out, wound = PppFilter(start), [], {}
        for t, g in pdf.sort_values("t").groupby("t"):
            at = {r.sat: (np.array([r.sx, r.sy, r.sz]), r.sclk) for r in g.itertuples()}
            here = f.x[:3]
            lat, lon, _ = ecef_np(here)
            e, n, u = enu_rotation(lat, lon)
            shift = antenna_neu[0] * n + antenna_neu[1] * e + antenna_neu[2] * u
            if tides:
                shift = shift + solid_tide(here, float(t))
            use = []
            for r in g.sort_values("sat").itertuples():
                phase = r.phase
                if turns:
                    wound[r.sat] = wind_up(at[r.sat][0], here, sun_moon(float(t))[0], wound.get(r.sat))
                    phase -= wound[r.sat] * C / (sum(FREQ[r.sat[0]]) * 1e6)
                use.append((r.sat, r.code, phase, r.gf))
            out.append(f.step(float(t), use, at.get, shift))
        return pd.DataFrame(out).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, *[c.split()[0] for c in PPP.split(", ")]]]

    types = {x.name: x.dataType.simpleString() for x in obs.schema.fields}
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + PPP)


def summary(solutions: DataFrame) -> DataFrame:
    """Mean position, scatter and counts of a set of solutions."""
    ok = solutions.where("x is not null")
    return ok.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "xyz"], *[F.stddev_samp(c).alias(f"sd_{c}") for c in "xyz"], F.avg("n_sats").alias("mean_sats"))


# ---- tides and phase wind-up ---------------------------------------------------------------------------------------


def sun_moon(t: float) -> tuple[np.ndarray, np.ndarray]:
    """Earth-fixed positions of Sun and Moon in metres from low-precision series; t in GPS seconds."""
    jc = ((44244.0 + t / 86400) - 51544.5) / 36525
    eps = math.radians(23.439291 - 0.0130042 * jc)
    ls, ms = 280.4606184 + 36000.77005361 * jc, math.radians(357.5277233 + 35999.05034 * jc)
    lam = math.radians(ls + 1.914666471 * math.sin(ms) + 0.019994643 * math.sin(2 * ms))
    r = 149597870700.0 * (1.000140612 - 0.016708617 * math.cos(ms) - 0.000139589 * math.cos(2 * ms))
    sun = r * np.array([math.cos(lam), math.cos(eps) * math.sin(lam), math.sin(eps) * math.sin(lam)])
    lm = 218.32 + 481267.8813 * jc
    d = lambda a, b: math.radians(a + b * jc)
    lam = math.radians(lm + 6.29 * math.sin(d(134.9, 477198.85)) - 1.27 * math.sin(d(259.2, -413335.38)) + 0.66 * math.sin(d(235.7, 890534.23)) + 0.21 * math.sin(d(269.9, 954397.70)) - 0.19 * math.sin(d(357.5, 35999.05)) - 0.11 * math.sin(d(186.6, 966404.05)))
    phi = math.radians(5.13 * math.sin(d(93.3, 483202.03)) + 0.28 * math.sin(d(228.2, 960400.87)) - 0.28 * math.sin(d(318.3, 6003.18)) - 0.17 * math.sin(d(217.6, -407332.20)))
    par = math.radians(0.9508 + 0.0518 * math.cos(d(134.9, 477198.85)) + 0.0095 * math.cos(d(259.2, -413335.38)) + 0.0078 * math.cos(d(235.7, 890534.23)) + 0.0028 * math.cos(d(269.9, 954397.70)))
    r = 6378137.0 / math.sin(par)
    moon = r * np.array([math.cos(phi) * math.cos(lam), math.cos(eps) * math.cos(phi) * math.sin(lam) - math.sin(eps) * math.sin(phi), math.sin(eps) * math.cos(phi) * math.sin(lam) + math.cos(eps) * math.sin(phi)])
    g = math.radians((280.46061837 + 360.98564736629 * (jc * 36525)) % 360)
    rot = np.array([[math.cos(g), math.sin(g), 0], [-math.sin(g), math.cos(g), 0], [0, 0, 1]])
    return rot @ sun, rot @ moon


def solid_tide(rec: np.ndarray, t: float) -> np.ndarray:
    """Degree-2 displacement of a station by Sun and Moon, with latitude-dependent Love numbers."""
    r = np.linalg.norm(rec)
    u = rec / r
    p2 = (3 * u[2] ** 2 - 1) / 2
    h2, l2 = 0.6078 - 0.0006 * p2, 0.0847 + 0.0002 * p2
    out = np.zeros(3)
    for pos, ratio in zip(sun_moon(t), (332946.0482, 0.0123000371), strict=True):
        d = np.linalg.norm(pos)
        v = pos / d
        c = float(u @ v)
        out += ratio * 6378136.6**4 / d**3 * (h2 * u * (1.5 * c * c - 0.5) + 3 * l2 * c * (v - c * u))
    return out


def wind_up(sat: np.ndarray, rec: np.ndarray, sun: np.ndarray, last: float | None = None) -> float:
    """Carrier phase wind-up in cycles between a nominal satellite attitude and the station; continuous with `last`."""
    k = (rec - sat) / np.linalg.norm(rec - sat)
    ez = -sat / np.linalg.norm(sat)
    es = (sun - sat) / np.linalg.norm(sun - sat)
    ey = np.cross(ez, es)
    ey /= np.linalg.norm(ey)
    ex = np.cross(ey, ez)
    g = ecef_np(rec)
    e, n, _ = enu_rotation(g[0], g[1])
    ds = ex - k * (k @ ex) - np.cross(k, ey)
    dr = n - k * (k @ n) + np.cross(k, -e)
    c = float(ds @ dr / (np.linalg.norm(ds) * np.linalg.norm(dr)))
    phi = math.copysign(math.acos(max(-1.0, min(1.0, c))) / (2 * math.pi), float(k @ np.cross(ds, dr)))
    return phi if last is None else phi + round(last - phi)


def wind_up_arcs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wind-up along each arc (keys) of rows t, sat_pos, rec_pos (arrays); the state is the arc's last value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        out, last = [], None
        for t, s, r in zip(pdf["t"], pdf["sat_pos"], pdf["rec_pos"], strict=True):
            last = wind_up(np.asarray(s, float), np.asarray(r, float), sun_moon(float(t))[0], last)
            out.append(last)
        return pdf.assign(wind_up=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(run, schema + ", wind_up double")

"""Operators against plain restatements and known values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import dist, geodesy, numeric, timefn
from cadenza.operators import cluster, extremes, filters, gaps, gnss, homogeneity, models, multivariate, outliers, regression, relational, resample, spatial, stats
from cadenza.plans.homogenize import HomogenizeConfig, homogenize
from cadenza.schema import ConfigError, DataError

NAN = float("nan")


def series(spark, values, start=51544.0, step=1.0, station="s", component="c"):
    rows = [(station, component, start + i * step, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, component string, mjd double, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("mjd").collect()]


def lcg(n, seed=12345678901, amplitude=0.05):
    out, s = [], seed
    for _ in range(n):
        s = (s * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(((s >> 11) / 2**53 * 2 - 1) * amplitude)
    return np.array(out)


def test_time_scales(spark):
    df = spark.createDataFrame([("2000-01-01 12:00:00.5", 51544.5)], "s string, mjd double")
    r = df.select(timefn.mjd_from_utc(F.col("s")).alias("a"), timefn.gps_from_mjd(F.lit(44244.0)).alias("g0"), timefn.mjd_from_gps(timefn.gps_from_mjd(F.lit(57754.0))).alias("b"), timefn.utc_string(F.col("mjd")).alias("u"), timefn.unix_from_mjd(F.lit(40588.0)).alias("x"), timefn.leap_seconds(F.lit(57754.0)).alias("l")).first()
    assert abs(r.a - (51544.5 + 0.5 / 86400)) < 1e-9 and r.g0 == 0 and abs(r.b - 57754.0) < 1e-9 and r.u.startswith("2000-01-01 12:00:00") and r.x == 86400 and r.l == 18
    bad = spark.createDataFrame([("2000-13-01",), ("x",), ("2000-01-01",)], "s string").select(timefn.mjd_from_utc(F.col("s")).alias("m")).collect()
    assert [r.m for r in bad] == [None, None, 51544.0]


def test_distributions():
    assert abs(dist.normal_cdf(1.96) - 0.9750021) < 1e-6 and abs(dist.normal_quantile(0.975) - 1.959964) < 1e-5
    assert abs(dist.t_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(dist.chi2_quantile(0.95, 3) - 7.814728) < 1e-5
    assert abs(dist.f_cdf(4.9646, 1, 10) - 0.95) < 1e-4 and abs(dist.chi2_cdf(5.991465, 2) - 0.95) < 1e-6
    assert abs(dist.adf_critical(100) - (-2.8621 - 2.738 / 100 - 8.36 / 1e4)) < 1e-12
    with pytest.raises(ConfigError):
        dist.kpss_critical("level", 0.2)


def test_descriptive(spark):
    r = stats.summary(series(spark, [1, 2, 3, 4, 5, NAN])).first()
    assert (r.n, r.n_missing, r.n_valid, r["mean"], r.variance, r["range"], r.median, r.mad, r.skewness) == (6, 1, 5, 3.0, 2.5, 4.0, 3.0, 1.0, 0.0)
    assert stats.modes(series(spark, [1, 2, 2, 3, 3])).first().mode == [2.0, 3.0] and stats.modes(series(spark, [1, 2])).first().mode == []
    x = lcg(60)
    a = {r.lag: r.acf for r in stats.acf(series(spark, x), 3).collect()}
    assert np.allclose([a[k] for k in range(4)], numeric.acf(x, 3))
    with pytest.raises(Exception, match="NaN in series"):
        stats.with_policy(series(spark, [1, NAN]), "throw").collect()


def test_gaps(spark):
    df = series(spark, [1, NAN, NAN, 4, 5]).union(series(spark, [8, 9], 51552.0))
    g = sorted((r.start_index, r.end_index, r.n_missing) for r in gaps.detect(df).collect())
    assert g == [(1, 2, 2), (5, 4, 3)]
    full = gaps.expand(df)
    assert column(gaps.fill_linear(full), "filled") == [1, 2, 3, 4, 5, 5.75, 6.5, 7.25, 8, 9]
    assert column(gaps.fill_forward(full), "filled") == [1, 1, 1, 4, 5, 5, 5, 5, 8, 9]
    short = column(gaps.fill_linear(full, 2), "filled")
    assert short[:5] == [1, 2, 3, 4, 5] and all(math.isnan(v) for v in short[5:8])
    edges = series(spark, [NAN, 2, NAN])
    assert column(gaps.fill_linear(edges), "filled") == [2, 2, 2]
    year = series(spark, np.tile(np.arange(365.0), 6)[: 365 * 6], 51544.0)
    p = gaps.median_year(year, min_years=5)
    assert p.count() in (365, 366) and p.where("n >= 5 and isnan(profile)").count() == 0


def test_filters(spark):
    x = np.sin(np.arange(40) / 3) + lcg(40)
    df = series(spark, x)
    assert column(filters.held_moving_average(series(spark, np.full(20, 7.0)), 5), "filtered") == [7.0] * 20
    got = column(filters.savitzky_golay(df, 7, 2), "filtered")
    h = np.arange(-3, 4)
    want = [np.polyval(np.polyfit(h, x[3 + i - 3 : 3 + i + 4], 2), 0) for i in range(34)]
    assert np.allclose(got[3:-3], want) and np.allclose(got[:3], np.polyval(np.polyfit(h, x[:7], 2), [-3, -2, -1]))
    s, want = x[0], []
    for v in x:
        s = 0.3 * v + 0.7 * s if want else v
        want.append(s)
    assert np.allclose(column(filters.ema(df, 0.3), "filtered"), want)
    line = series(spark, 2 + 3.0 * np.arange(30))
    assert np.allclose(column(filters.loess(line, 0.4), "filtered"), 2 + 3.0 * np.arange(30))
    assert np.allclose(column(filters.spline_filter(line, 4), "filtered"), 2 + 3.0 * np.arange(30))
    assert filters.advise_window(x, "acf_peak") % 2 == 1


def test_outliers(spark):
    x = lcg(60)
    x[20] = 3.0
    df = series(spark, x)
    for fn in (outliers.iqr, outliers.mad, outliers.zscore):
        assert [r.mjd for r in fn(df).where("is_outlier").collect()] == [51564.0]
    assert outliers.zscore(series(spark, [5.0] * 8)).where("is_outlier").count() == 0
    c = column(outliers.clean(df), "cleaned")
    assert abs(c[20] - (x[19] + x[21]) / 2) < 1e-12 and c[19] == x[19]
    assert 51564.0 in [r.mjd - 1 for r in outliers.hat_matrix(df, 2).where("is_outlier").collect()]


def test_change_points(spark):
    x = lcg(300)
    x[150:] += 1.0
    df = series(spark, x)
    for method, kw in (("yao_davis", {}), ("pelt", {"least": 5}), ("bocpd", {}), ("snht", {})):
        if method == "pelt":
            at = homogeneity.pelt_np(x, least=5)
        elif method == "bocpd":
            at = homogeneity.bocpd_np(x)
        else:
            at = [r.global_index for r in homogeneity.change_points(df, method, **kw).collect()]
        assert len(at) == 1 and abs(at[0] - 150) <= 2, method
    assert homogeneity.change_points(series(spark, lcg(300))).count() == 0
    pts = spark.createDataFrame([("s", "c", 51547.0, 2.0)], "station_id string, component string, mjd double, shift double")
    assert column(homogeneity.adjust(series(spark, [10, 11, 12, 13, 14]), pts), "adjusted") == [10, 11, 12, 11, 12]
    assert homogeneity.bocpd_np(x, compat=True) == []


def test_homogenize(spark):
    x = 10 + np.sin(2 * np.pi * np.arange(2400) / 365.25) + lcg(2400)
    x[1200:] += 3.0
    x[100], x[700:705] = 60.0, NAN
    out, points = homogenize(series(spark, x), HomogenizeConfig(deseasonalize="moving_average", window=5, post_outlier=None))
    assert out.count() == 2400
    out, points = homogenize(series(spark, x), HomogenizeConfig(deseasonalize="none", post_outlier=None))
    p = points.collect()
    assert any(abs(r.mjd - (51544 + 1200)) < 3 and 2.5 < r["shift"] < 3.5 for r in p)
    with pytest.raises(ConfigError):
        HomogenizeConfig.from_dict({"fil": "linear"})


def test_regression(spark):
    t = np.arange(200.0)
    x = 3 + 0.5 * t + 2 * np.sin(2 * np.pi * t / 50) + lcg(200)
    df = series(spark, x)
    r = regression.fit(df, "trend", period=50.0).first()
    assert r.error is None and np.allclose(r.coefficients, [3, 0.5, 2, 0], atol=0.05)
    l = regression.linear(df).first()
    assert np.allclose(np.polyfit(t, x, 1), [l.slope, l.intercept])
    y = x.copy()
    y[::20] += 50
    assert abs(regression.fit(series(spark, y - 2 * np.sin(2 * np.pi * t / 50)), "robust").first().coefficients[1] - 0.5) < 0.01
    e = regression.nonlinear(series(spark, 2 * np.exp(0.01 * t)), "exponential").first()
    assert np.allclose(e.coefficients, [2, 0.01], rtol=1e-4)
    p = regression.predict(series(spark, 1 + 2 * t + lcg(200)), [210.0], "linear").first()
    assert p.pred_lower < p.conf_lower < p.predicted < p.conf_upper < p.pred_upper
    a = numeric.polynomial(t, 1)
    loo = regression.cross_validate(t, x, 1)["rmse"]
    want = np.sqrt(np.mean([(a[i] @ np.linalg.lstsq(np.delete(a, i, 0), np.delete(x, i), rcond=None)[0] - x[i]) ** 2 for i in range(200)]))
    assert abs(loo - want) < 1e-9
    d = regression.diagnostics(a, x)
    assert d["f_p"] < 1e-6 and abs(d["leverage"].sum() - 2) < 1e-9
    bad = regression.fit(series(spark, [NAN, NAN]), "linear").first()
    assert bad.error


def test_series_models(spark):
    rng = np.random.default_rng(2)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    assert models.stationarity_np(noise)["stationary"] and not models.stationarity_np(walk)["stationary"]
    x = resample.simulate_arima(3000, [0.6], [], 1.0)
    f = models.arima_fit(x, 1, 0)
    assert abs(f["ar"][0] - 0.6) < 0.05
    fc = models.arima(series(spark, x[:400]), 1, 0, d=0, horizon=3).orderBy("step").collect()
    assert len(fc) == 3 and fc[0].lower95 < fc[0].forecast < fc[0].upper95
    season = np.tile([1.0, 2, 3, 0, -1, -2, -3], 40)
    y = 0.1 * np.arange(280) + season
    for m in ("classical", "stl"):
        d = models.decompose(series(spark, y), 7, m).orderBy("mjd").toPandas()
        assert np.allclose(d.trend + d.seasonal + d.residual, y) and np.abs(d.residual[20:-20]).max() < 0.5, m
    p = models.periodogram(np.sin(2 * np.pi * np.arange(512) / 16), 1.0)
    assert abs(p["frequency"][p["psd"].argmax()] - 1 / 16) < 1e-9
    pk = models.peaks(models.lomb_scargle(series(spark, np.sin(2 * np.pi * np.arange(200) / 20)), 80), 1).first()
    assert abs(pk.period - 20) < 0.5
    comp, share = models.ssa_np(np.sin(np.arange(200) / 5) + 0.01 * np.arange(200), 40, 6)
    assert np.allclose(comp.sum(0), np.sin(np.arange(200) / 5) + 0.01 * np.arange(200), atol=1e-6) and abs(share.sum() - 1) < 1e-9
    k = models.kalman(series(spark, np.cumsum(rng.normal(size=100) * 0.1) + rng.normal(size=100)), "local_level", "em", horizon=2).orderBy("mjd").toPandas()
    assert len(k) == 102 and (k.smoothed_sd[:100] <= k.filtered_sd[:100] + 1e-9).all()


def test_splines():
    x = np.linspace(0, 5, 11)
    s = numeric.cubic_spline(x, x**3)
    assert np.allclose(s([0.3, 2.2, 4.9]), np.array([0.3, 2.2, 4.9]) ** 3) and np.allclose(s([2.2], 1), 3 * 2.2**2) and np.allclose(s([2.2], 2), 6 * 2.2)
    long = np.linspace(0, 50, 600)
    assert np.allclose(numeric.cubic_spline(long, np.sin(long))([10.05]), np.sin(10.05), atol=1e-6)
    assert abs(numeric.lagrange(x, x**4, 1.23) - 1.23**4) < 1e-9
    e, *_ = numeric.bspline_fit(x, np.sin(x), 8)
    assert np.abs(e(x) - np.sin(x)).max() < 0.02 and abs(numeric.bspline_basis([0.37], numeric.bspline_knots(7, 3), 3).sum() - 1) < 1e-12
    p, v, ok = numeric.nelder_mead(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, [0.0, 0.0])
    assert np.allclose(p, [1, -2], atol=1e-4)
    assert 0.3 < numeric.hurst(np.random.default_rng(2).normal(size=2000)) < 0.7


def test_extremes():
    rng = np.random.default_rng(3)
    e = 2.0 * (rng.uniform(size=4000) ** -0.1 - 1) / 0.1
    f = extremes.gpd_fit(e, "mle")
    assert abs(f["xi"] - 0.1) < 0.06 and abs(f["sigma"] - 2) < 0.2
    m = 5 - 2 * np.log(-np.log(rng.uniform(size=3000)))
    g = extremes.gev_fit(m)
    assert abs(g["mu"] - 5) < 0.2 and abs(g["sigma"] - 2) < 0.2 and abs(g["xi"]) < 0.06
    for method in ("profile", "delta", "bootstrap"):
        lo, hi = extremes.gpd_interval(e[:300], 0.0, 1.0, 100.0, extremes.gpd_fit(e[:300], "mle"), method, draws=60)
        assert lo < extremes.gpd_level(0.0, 0.1, 2.0, 1.0, 100.0) * 1.5 and hi > lo


def test_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    assert len(np.unique(cluster.best_kmeans(x, 2, 5, inits=4)[0])) == 3
    spark.sparkContext.setCheckpointDir("/tmp/cadenza-test-checkpoint")
    df = spark.createDataFrame(pd.DataFrame({"id": range(91), "a": [*x[:, 0], 50.0], "b": [*x[:, 1], 50.0]}))
    lab = {r.id: r.cluster for r in cluster.dbscan(df, ["a", "b"], 0.6, 4).collect()}
    assert lab[90] == -1 and len({lab[i] for i in range(30)}) == 1 and len(set(lab.values())) == 4


def test_multivariate(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(300, 2))
    x = np.column_stack([z[:, 0], z[:, 0] + 0.1 * z[:, 1], z[:, 1], -z[:, 1] + 0.1 * rng.normal(size=300)])
    x[0] = [9, -9, 9, 9]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(mjd=np.arange(300.0), label=(z[:, 0] > 0).astype(int)))
    cols = list("abcd")
    p = multivariate.pca(df, cols)
    assert np.allclose(p["variances"], np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 299)
    c = multivariate.cca(df, ["a"], ["b"])
    assert abs(c["correlations"][0] - abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1])) < 1e-9
    m = multivariate.lda(df, cols, "label")
    acc = multivariate.lda_predict(df, cols, m).where("predicted = label").count() / 300
    assert acc > 0.9 and multivariate.lda_predict(df, cols, m, True).where("predicted = label").count() / 300 > 0.5
    assert 0.0 in [r.mjd for r in multivariate.mahalanobis(df, cols, True).where("is_outlier").collect()]
    assert multivariate.manova(df, cols, "label")["p_value"] < 1e-6
    assert multivariate.factor_analysis(df, cols, 2)["loadings"].shape == (4, 2)
    y = np.zeros((300, 2))
    for t in range(1, 300):
        y[t] = [0.5 * y[t - 1, 0] + rng.normal(), 0.8 * y[t - 1, 0] + rng.normal()]
    d2 = spark.createDataFrame(pd.DataFrame(y, columns=["u", "v"]).assign(mjd=np.arange(300.0)))
    g = {(r["cause"], r["effect"]): r["p_value"] for r in multivariate.granger(d2, ["u", "v"], 1)}
    assert g["u", "v"] < 1e-6 and g["v", "u"] > 1e-3
    v = multivariate.var_fit(d2, ["u", "v"], 2)
    assert abs(v["coefficients"][1][0] - 0.8) < 0.15
    assert multivariate.mssa(d2, ["u", "v"], 20, 3).count() == 300 * 2 * 3


def test_joins(spark):
    l, r = series(spark, [1, 2, 3]), series(spark, [10, NAN, 30], 51544.4)
    got = relational.nearest(l, r, 0.45).orderBy("mjd").collect()
    assert got[0].near_value == 10 and math.isnan(got[1].near_value) and got[2].near_value == 30
    tie = relational.nearest(series(spark, [1], 51545.0), series(spark, [1, 2], 51544.5), 0.5).first()
    assert tie.near_value == 2
    o = relational.sync_outer([series(spark, [1, 1, 1], 100.0, 0.4), series(spark, [1], 100.5)], 0.5)
    assert sorted(round(x.mjd, 6) for x in o.collect()) == [round((100.0 + 100.4 + 100.5) / 3, 6), 100.8]
    z = relational.standardise(series(spark, [1, 2, 3, 4]), ["value"])
    assert abs(sum(column(z, "value"))) < 1e-12


def test_space(spark):
    rng = np.random.default_rng(6)
    p = np.column_stack([rng.uniform(0, 10, (60, 2)), np.zeros(60)])
    p[:, 2] = 1 + 2 * p[:, 0] - p[:, 1]
    df = spark.createDataFrame(pd.DataFrame(p, columns=["x", "y", "value"]))
    cells = spatial.grid(spark, 3.0, 5.0, 3.0, 5.0, 1.0)
    for method, kw, tol in (("rbf", {}, 0.05), ("natural_neighbor", {}, 0.05), ("bspline_surface", {"nx": 4, "ny": 4}, 1e-6), ("kriging", {"kind": "universal"}, 0.05)):
        for r in spatial.interpolate(df, cells, method, **kw).collect():
            assert abs(r.value - (1 + 2 * r.x - r.y)) < tol, method
    k = spatial.kriging_model(p[:, :2], p[:, 2], "ordinary", ("spherical", 0.01, 10.0, 8.0))
    e, v = k.loo()
    i = 7
    m = spatial.kriging_model(np.delete(p[:, :2], i, 0), np.delete(p[:, 2], i), "ordinary", ("spherical", 0.01, 10.0, 8.0))(p[i : i + 1, :2])[0]
    assert abs((p[i, 2] - m[0]) - e[i]) < 1e-3
    assert spatial.krige_series(series(spark, np.sin(np.arange(30) / 4)), [51560.5]).where("not is_observed").count() == 1
    z = np.add.outer(np.arange(4.0), 10 * np.arange(5.0))
    assert np.allclose(spatial.bilinear(z, 0, 0, 1.0)(np.array([[1.5, 2.25]])), 17.25)


def test_geodesy(spark):
    df = spark.createDataFrame([(49.5, 15.0, 300.0), (-89.9, -170.0, 10.0), (0.0, 0.0, 0.0)], "lat double, lon double, h double")
    xyz = geodesy.geod_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    b = df.select("*", *[c.alias(n) for c, n in zip(xyz, "xyz", strict=True)])
    r = b.select("*", *[c.alias(n) for c, n in zip(geodesy.ecef_to_geod(F.col("x"), F.col("y"), F.col("z")), ("a", "b", "c"), strict=True)]).collect()
    assert all(abs(q.lat - q.a) < 1e-9 and abs(q.lon - q.b) < 1e-9 and abs(q.h - q.c) < 1e-4 for q in r)
    d = geodesy.vincenty_inverse_np(np.array([50.06632]), np.array([-5.71475]), np.array([58.64402]), np.array([-3.07009]))[0]
    assert abs(d[0] - 969954.166) < 1
    f = geodesy.vincenty_direct_np(np.array([50.06632]), np.array([-5.71475]), d[1:2], d[:1])[0]
    assert abs(f[0] - 58.64402) < 1e-7 and abs(f[1] + 3.07009) < 1e-7
    cov = (np.eye(3) * 0.04).tolist()
    assert geodesy.monte_carlo_check([4e6, 1e6, 4.8e6], cov, "ecef", "enu", 20_000, (49.5, 15.0, 300.0)) < 0.05
    t = spark.createDataFrame([([4e6, 1e6, 4.8e6], cov)], "pos array<double>, cov array<array<double>>").select(geodesy.transform_with_covariance(F.col("pos"), F.col("cov"), "ecef", "sphere").alias("r")).first().r
    assert abs(t.pos[2] - math.sqrt(4e6**2 + 1e6**2 + 4.8e6**2)) < 1e-3 and abs(t.cov[2][2] - 0.04) < 1e-4


def test_resampling(spark):
    x = np.random.default_rng(7).normal(5, 1, 80)
    for m in ("percentile", "bca", "block"):
        c = resample.confidence(spark, x, np.mean, m, 200)
        assert c["lower"] < x.mean() < c["upper"]
    assert resample.permutation_test(spark, "two_sample", x, x + 2, n=99)["p_value"] <= 0.02
    assert resample.permutation_test(spark, "correlation", x, x**2, n=99)["p_value"] <= 0.02
    assert resample.permutation_test(spark, "one_sample", x, mean0=5.0, n=99)["p_value"] > 0.01
    e = resample.envelope(resample.simulate(spark, 20, lambda s: resample.simulate_kalman(10, "local_level", 1.0, 1.0, s))).collect()
    assert len(e) == 10 and all(r.p05 <= r.p50 <= r.p95 for r in e)
    assert np.isnan(resample.inject(x, gaps=1)).any() and not np.isnan(resample.inject(x, gaps=1, compat=True)).any()


def test_positioning():
    truth = np.array([3975472.0, 1050389.0, 4857697.0])
    rng, sats = np.random.default_rng(8), {}
    up = truth / np.linalg.norm(truth)
    while len(sats) < 9:
        v = rng.normal(size=3)
        p = 26.56e6 * v / np.linalg.norm(v)
        if (p - truth) @ up / np.linalg.norm(p - truth) > 0.3:
            sats[f"G{len(sats) + 1:02d}"] = p
    pr = []
    for p in sats.values():
        tau = 0.07
        for _ in range(5):
            rho = np.linalg.norm(gnss.sagnac(p, tau) - truth)
            tau = rho / gnss.C
        _, el = gnss.azimuth_elevation(truth, gnss.sagnac(p, tau))
        g = geodesy.ecef_np(truth)
        pr.append(rho + 1000.0 + sum(gnss.saastamoinen(g[0], g[2])) / max(math.sin(math.radians(el)), 0.05))
    r = gnss.spp_epoch(0.0, list(sats), pr, lambda s, t: (sats[s], 0.0))
    assert r["converged"] and np.linalg.norm(np.array([r["x"], r["y"], r["z"]]) - truth) < 5.0 and r["gdop"] > 0
    assert gnss.spp_epoch(0.0, list(sats)[:3], pr[:3], lambda s, t: (sats[s], 0.0))["converged"] is False
    assert 0 < gnss.klobuchar(50, 15, 90, 30, 50400, [1e-8, 0, 0, 0], [9e4, 0, 0, 0]) < 50
    assert 2.2 < gnss.saastamoinen(50, 0)[0] < 2.4 and abs(gnss.niell(50, 300, 100, 90)[0] - 1) < 1e-3


def test_normality_and_dependence(spark):
    from cadenza.operators import hypothesis, splines

    rng = np.random.default_rng(9)
    x, e = rng.normal(size=300), rng.exponential(size=300)
    for t in ("shapiro_wilk", "kolmogorov_smirnov", "jarque_bera"):
        assert hypothesis.normality(series(spark, e), t).first().rejected and not hypothesis.normality(series(spark, x), t, 0.001).first().rejected
    w, p = hypothesis.shapiro_np(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.79) < 0.01 and p < 0.02
    d = hypothesis.dependence(series(spark, x), 5).first()
    assert d.pacf[0] == 1 and abs(d.pacf[1]) < 0.15 and 0.3 < d.hurst < 0.8
    s = splines.fit(series(spark, np.sin(np.arange(80) / 8) + 0.01 * x[:80]), 14).toPandas()
    assert np.abs(s.residual).max() < 0.06 and (s.ci_lower < s.ci_upper).all()


def test_tides_and_wind_up():
    rec = np.array([3975472.0, 1050389.0, 4857697.0])
    t = 1.3e9
    sun, moon = gnss.sun_moon(t)
    assert 1.46e11 < np.linalg.norm(sun) < 1.53e11 and 3.5e8 < np.linalg.norm(moon) < 4.1e8
    up = [float(gnss.solid_tide(rec, t + h * 3600) @ rec / np.linalg.norm(rec)) for h in range(24)]
    assert 0.05 < max(up) - min(up) < 0.7
    w, last = [], None
    for k in range(50):
        a = 2 * math.pi * k / 40
        last = gnss.wind_up(26.5e6 * np.array([math.cos(a), math.sin(a) * 0.6, math.sin(a) * 0.8]), rec, sun, last)
        w.append(last)
    assert np.abs(np.diff(w)).max() <= 0.5


def test_precise_positions(spark):
    """A station at rest, satellites on circles, observations with clock, troposphere, tide, wind-up and biases."""
    truth = np.array([3975472.0, 1050389.0, 4857697.0])
    lat, lon, h = geodesy.ecef_np(truth)
    rng = np.random.default_rng(12)
    t0 = 2295 * 604800.0 + 40_000.0
    planes = [(rng.uniform(0, 2 * math.pi), rng.uniform(0.7, 1.1), rng.uniform(0, 2 * math.pi)) for _ in range(24)]

    def sat(k, t):
        node, inc, phase = planes[k]
        a = phase + 1.2e-4 * (t - t0)
        p = 26.56e6 * np.array([math.cos(a), math.sin(a) * math.cos(inc), math.sin(a) * math.sin(inc)])
        return np.array([p[0] * math.cos(node) - p[1] * math.sin(node), p[0] * math.sin(node) + p[1] * math.cos(node), p[2]])

    orbits = [(t0 + 300.0 * j, f"G{k + 1:02d}", *map(float, sat(k, t0 + 300.0 * j)), 1e-5 * k) for k in range(24) for j in range(-12, 30)]
    offset = lambda k: [0.2, 0.0, 1.0 + 1.5 * (k % 4)]
    delay = lambda k: 4.0 * (k % 3)  # noqa: E731  nanoseconds of the first code
    zhd, _ = gnss.saastamoinen(lat, h)
    f1, f2 = (f * 1e6 for f in gnss.FREQ["G"])
    rows, wound = [], {}
    for j in range(40):
        t = t0 + 60.0 * j
        sun = gnss.sun_moon(t)[0]
        here = truth + gnss.solid_tide(truth, t)
        for k in range(24):
            tau = 0.07
            for _ in range(6):
                c = sat(k, t - tau)
                rho = float(np.linalg.norm(gnss.sagnac(c + gnss.body_axes(c, sun).T @ offset(k), tau) - here))
                tau = rho / gnss.C
            p = gnss.sagnac(c + gnss.body_axes(c, sun).T @ offset(k), tau)
            _, el = gnss.azimuth_elevation(truth, p)
            if el < 10:
                continue
            v = sat(k, t - tau + 0.5) - sat(k, t - tau - 0.5)
            mh, mw = gnss.niell(lat, h, (t / 86400) % 365.25, el)
            base = rho + 30.0 - gnss.C * (1e-5 * k - 2 * float(c @ v) / gnss.C**2) + zhd * mh + 0.12 * mw
            wound[k] = gnss.wind_up(p, truth, sun, wound.get(k))
            obs = {"C1C": base + delay(k) * gnss.C * 1e-9, "C2W": base, "L1C": (base + 3.0 * gnss.C / f1) * f1 / gnss.C + wound[k], "L2W": (base + 5.0 * gnss.C / f2) * f2 / gnss.C + wound[k]}
            obs = {n: float(x) for n, x in obs.items()}
            rows.append(("st", t, f"G{k + 1:02d}", obs))
    obs = spark.createDataFrame(rows, "station string, t double, sat string, obs map<string,double>")
    orb = spark.createDataFrame(orbits, "t double, sat string, x double, y double, z double, clock double")
    bias = spark.createDataFrame([(f"G{k + 1:02d}", "C1C", delay(k), "ns") for k in range(24)], "sat string, code string, bias double, unit string")
    ant = spark.createDataFrame([(f"G{k + 1:02d}", b, offset(k)) for k in range(24) for b in ("G01", "G02")], "serial string, frequency string, offset array<double>")
    start = tuple(truth + [3.0, -2.0, 4.0])
    last = lambda **kw: gnss.ppp(obs, orb, start, ["station"], **kw).orderBy("t").toPandas().iloc[-1]
    r = last(biases=bias, antennas=ant)
    error = lambda r: float(np.linalg.norm(r[["x", "y", "z"]].to_numpy(float) - truth))
    assert error(r) < 0.1 and r["n_sats"] >= 5
    assert error(last(antennas=ant)) > 3 * error(r) and error(last(biases=bias)) > 1.5 * error(r)


def test_order_without_one_partition(spark):
    from cadenza.operators import ordered

    rng = np.random.default_rng(3)
    t = np.sort(rng.exponential(1, 500)) * 100
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, rng.normal(size=500), strict=True)], "mjd double, v double").repartition(7)
    got = ordered.numbered(df, "mjd", range_rows=40).orderBy("mjd").toPandas()
    assert got["idx"].tolist() == list(range(500)) and got["mjd"].tolist() == t.tolist()
    lead = ordered.with_lead(df, "mjd", ["v"], 2, range_rows=40).orderBy("mjd").toPandas()
    assert len(lead) == 498 and lead["v2"].tolist() == got["v"].tolist()[2:]
    lags = ordered.with_lags(df, "mjd", ["v"], 2, range_rows=40).orderBy("_r").toPandas()
    assert lags["v__2"].tolist()[2:] == got["v"].tolist()[:-2] and lags["v__1"].isna().sum() == 1
    whole = relational.sync_outer([df.select("mjd")], 0.05).orderBy("mjd").toPandas()["mjd"].to_numpy()
    cut = relational.sync_outer([df.select("mjd")], 0.05, range_rows=30).orderBy("mjd").toPandas()["mjd"].to_numpy()
    assert np.allclose(whole, cut)


def test_seasonal_trend_regression(spark):
    """Parts of a series that is made of a trend, a season and little noise come back; a spike does not move them."""
    i = np.arange(240)
    season = np.sin(2 * np.pi * i / 24) + 0.4 * np.cos(4 * np.pi * i / 24)
    x = 5 + 0.02 * i + season + 0.01 * np.random.default_rng(1).normal(size=240)
    s = models.stl_np(x, 24)
    assert np.abs(s["seasonal"] - season).max() < 0.1 and np.abs(s["trend"] - 5 - 0.02 * i).max() < 0.1
    x[100] += 50
    r = models.stl_np(x, 24, outer=10)
    assert np.abs(np.delete(r["seasonal"] - season, 100)).max() < 0.2 and r["residual"][100] > 45
    assert np.allclose(s["trend"] + s["seasonal"] + s["residual"], np.where(i == 100, x - 50, x))
    with pytest.raises(DataError):
        models.stl_np(x[:40], 24)


def test_local_regression_equals_row_by_row():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=90))
    for degree, kernel in ((1, "tricube"), (2, "epanechnikov"), (1, "gaussian")):
        got = filters.loess_fit(x, 0.3, degree, 0, kernel)
        k = math.ceil(0.3 * 90)
        for i in (0, 3, 44, 89):
            lo = min(max(0, i - (k - 1) // 2), 90 - k)
            j = np.arange(lo, lo + k)
            u = np.abs(j - i) / max(i - lo, lo + k - 1 - i)
            w = {"tricube": (1 - u**3) ** 3, "epanechnikov": 1 - u**2, "gaussian": np.exp(-4.5 * u**2)}[kernel]
            a = np.vander(j - i, degree + 1, increasing=True) * np.sqrt(w)[:, None]
            assert abs(np.linalg.lstsq(a, x[j] * np.sqrt(w), rcond=None)[0][0] - got[i]) < 1e-8


def test_singular_values():
    a = np.random.default_rng(1).normal(size=(8, 3)) @ np.random.default_rng(2).normal(size=(3, 5))
    s = numeric.Svd(a)
    assert s.rank() == 3 and np.allclose(s.truncated(3), a) and np.allclose(s.pinv(), np.linalg.pinv(a)) and abs(s.explained().sum() - 1) < 1e-12
    assert numeric.Svd(np.eye(2) * [1, 4]).condition() == 4 and numeric.Svd(np.zeros((2, 2))).condition() == math.inf


def test_log(spark, tmp_path):
    from cadenza.log import logger, report_errors

    at = tmp_path / "run.log"
    log = logger("cadenza.test", file=str(at))
    assert logger("cadenza.test", file=str(at)) is log and len(log.handlers) == 2
    df = spark.createDataFrame([("a", "x", None), ("b", "y", "ValueError: too short"), ("b", "z", "no")], "station_id string, component string, error string")
    assert report_errors(log, df, ["station_id", "component"], 1) == 2
    text = at.read_text()
    assert "b/y: ValueError: too short" in text and "and 1 more series" in text


def test_damaged_files_do_not_stop_the_rest(spark, tmp_path):
    from cadenza.sources import text

    (tmp_path / "a.txt").write_text("% columns: t, v\n51544;1\n51545;2\n")
    (tmp_path / "b.txt").write_text("% nothing\n")
    (tmp_path / "c.txt").write_text("51544;1;9\n51545;x;9\n")
    rows, errors = text.read_each(spark, [str(tmp_path / f"{n}.txt") for n in "abc"] + [str(tmp_path / "none.txt")])
    assert rows.count() == 4 and sorted(e.split(":")[0] for e in errors.values()) == ["AnalysisException", "ParseError"]
    r = text.read_report(spark, str(tmp_path / "c.txt")).first()
    assert (r.n_lines, r.n_data, r.n_read, r.n_skipped) == (2, 2, 1, 1)
    assert text.read_each(spark, [str(tmp_path / "b.txt")])[0] is None


def test_sliding_seasonal_regression_equals_place_by_place():
    rng = np.random.default_rng(4)
    y, w = rng.normal(size=400).cumsum(), rng.uniform(0, 1, 400)
    w[100:140] = 0
    for width in (7, 46, 151, 152, 900):
        at = np.arange(-1, 401)
        assert np.allclose(models._stl_loess(y, w, width, at), models._loess_at(y, w, width, at), atol=1e-6), width


def test_local_level_equals_matrices():
    y = np.random.default_rng(5).normal(size=60).cumsum()
    y[20:24] = NAN
    m = models.kalman_model("local_level", 0.3, 2.0)
    k = models.kalman_np(y, m)
    x, p, ll = y[0], m["p0"][0, 0], 0.0
    for i, v in enumerate(y):
        p += 0.3
        if not np.isnan(v):
            s, e = p + 2.0, v - x
            x, p, ll = x + p / s * e, p * 2.0 / s, ll - 0.5 * (math.log(2 * math.pi * s) + e * e / s)
        assert abs(k["x"][i, 0] - x) < 1e-9 and abs(k["p"][i, 0, 0] - p) < 1e-9
    assert abs(k["loglik"] - ll) < 1e-8
    s = models.rts_np(k, m)
    n = len(y)  # the smoothed states minimise the sum of squares
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] += 1 / (m["p0"][0, 0] + 0.3)
    b[0] += y[0] / (m["p0"][0, 0] + 0.3)
    for i in range(n):
        if not np.isnan(y[i]):
            a[i, i] += 1 / 2.0
            b[i] += y[i] / 2.0
        if i:
            a[i - 1 : i + 1, i - 1 : i + 1] += np.array([[1, -1], [-1, 1]]) / 0.3
    assert np.allclose(s["x"][:, 0], np.linalg.solve(a, b)) and np.allclose(s["p"][:, 0, 0], np.diag(np.linalg.inv(a)))
    assert np.allclose(s["lag"][1:, 0, 0], np.diag(np.linalg.inv(a), -1))
    q, r = models.kalman_em(np.random.default_rng(6).normal(size=800).cumsum() * 0.5 + np.random.default_rng(7).normal(size=800), "local_level", 1.0, 1.0)
    assert abs(q - 0.25) < 0.12 and abs(r - 1) < 0.3

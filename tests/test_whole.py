"""Registered queries do the whole job: every row, frequency and coordinate of their tables."""

import numpy as np
import pytest

from cadenza.operators import filters, models
from cadenza.plans import catalog
from cadenza.plans import fixtures as fx


def test_loess_smooths_every_day(spark, sf):
    days = fx.orders_daily(spark, sf).orderBy("mjd").toPandas()
    got = catalog.QUERIES["loess"](spark, sf).orderBy("mjd").toPandas()
    assert got["mjd"].tolist() == days["mjd"].tolist()
    assert np.allclose(got["filtered"], filters.loess_fit(days["value"].to_numpy(), 0.2))


def powers(t, x, oversampling=4.0):
    """Frequencies to 1/(2 median step) and their normalised power."""
    span = t[-1] - t[0]
    f = np.arange(1, int(span * oversampling / (2 * np.median(np.diff(t))) + 1e-6) + 1) / (span * oversampling)
    a, c = 2 * np.pi * np.outer(f, t - t[0]), x - x.mean()
    tau = np.arctan2(np.sin(2 * a).sum(1), np.cos(2 * a).sum(1)) / 2
    co, si = np.cos(a - tau[:, None]), np.sin(a - tau[:, None])
    part = lambda b: np.where((b * b).sum(1) > 1e-10 * len(t), (b @ c) ** 2 / np.maximum((b * b).sum(1), 1e-300), 0)
    return f, 0.5 * (part(co) + part(si)) / ((c @ c) / (len(t) - 1))


def test_spectral_peaks_see_every_frequency(spark, sf):
    hourly = fx.events_hourly(spark, sf).orderBy("mjd").toPandas()
    got = catalog.QUERIES["spectral_peaks"](spark, sf).orderBy("rank").toPandas()
    for name, s in hourly.groupby("component"):
        f, p = powers(s["mjd"].to_numpy(), s["value"].to_numpy())
        top = 1 + np.flatnonzero((p[1:-1] > p[:-2]) & (p[1:-1] > p[2:]) & (p[1:-1] > np.median(p)))
        top = top[np.argsort(-p[top])][:5]
        mine = got[got["component"] == name]
        assert np.allclose(mine["frequency"], f[top]) and np.allclose(mine["power"], p[top])


@pytest.mark.parametrize("step", [1.0, 0.25])
def test_lomb_scargle_grid_ends_at_half_the_sampling_rate(spark, step):
    t = 51544 + step * np.arange(60)
    x = np.sin(2 * np.pi * np.arange(60) / 2.5) + 0.1 * np.cos(np.arange(60))
    rows = spark.createDataFrame([("s", "c", float(a), float(b)) for a, b in zip(t, x, strict=True)], "station_id string, component string, mjd double, value double")
    got = models.lomb_scargle(rows).orderBy("k").toPandas()
    f, p = powers(t, x)
    assert len(got) == 118 and np.isclose(got["frequency"].iloc[-1], 1 / (2 * step))
    assert np.allclose(got["frequency"], f) and np.allclose(got["power"], p) and np.allclose(got["fap"], np.minimum(1, 118 * np.exp(-p)))
    assert np.isclose(models.peaks(models.lomb_scargle(rows), 1).first().period, 2.5 * step, rtol=0.02)


def test_embedding_queries_use_every_coordinate(spark, sf):
    e = fx.read(spark, sf, "embeddings").orderBy("vec_id").toPandas()
    x = np.stack(e["embedding"].to_numpy()).astype(float)
    x = x - x.mean(0)
    run = lambda name: catalog.QUERIES[name](spark, sf).orderBy("mjd").toPandas()
    inv = np.linalg.inv(np.cov(x.T))
    assert np.allclose(run("mahalanobis")["distance"], np.sqrt(((x @ inv) * x).sum(1)))
    pc = np.linalg.svd(x, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(run("pca_scores")[["pc1", "pc2"]]), np.abs(x @ pc.T), atol=1e-6)
    half = x.shape[1] // 2
    q = [np.linalg.qr(v)[0] for v in (x[:, :half], x[:, half:])]
    assert np.allclose(catalog.QUERIES["cca"](spark, sf).first()["correlations"], np.linalg.svd(q[0].T @ q[1], compute_uv=False))
    assert catalog.QUERIES["manova"](spark, sf).first()["df1"] == x.shape[1] * (e["label"].nunique() - 1)
    groups = [x[e["label"] == k] for k in sorted(e["label"].unique())]
    sw = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups)
    d = np.stack([np.einsum("ij,jk,ik->i", x - g.mean(0), np.linalg.inv(sw), x - g.mean(0)) for g in groups], 1)
    assert (run("lda_predict")["predicted"] == np.array(sorted(e["label"].unique()))[d.argmin(1)]).mean() > 0.99
    c = run("kmeans")["cluster"].to_numpy()
    centres = np.stack([x[c == k].mean(0) for k in np.unique(c)])
    near = np.unique(c)[((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)]
    assert len(c) == len(x) and (near == c).mean() > 0.9

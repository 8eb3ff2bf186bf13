"""Findings of round 2: larger tables, equal places and odd instants."""

import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import timefn
from cadenza.functions.panels import PanelLU
from cadenza.operators import cluster, multivariate, spatial
from cadenza.plans import catalog, more
from cadenza.schema import SingularMatrix


def plain_dbscan(x, ids, eps, least, metric):
    """Labels by all pairs."""
    diff = x[:, None] - x[None]
    d = np.sqrt((diff**2).sum(-1)) if metric == "euclidean" else np.abs(diff).sum(-1)
    near, core = d <= eps, (d <= eps).sum(1) >= least
    lab = np.where(core, ids, -1)
    while True:
        new = np.array([min(lab[near[i] & core]) if core[i] else -1 for i in range(len(x))])
        if (new == lab).all():
            break
        lab = new
    for i in np.flatnonzero(~core & (near & core).any(1)):
        j = min(np.flatnonzero(near[i] & core), key=lambda j: (d[i, j], ids[j]))
        lab[i] = lab[j]
    return lab


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("least", [3, 6])
def test_f1_dbscan_equals_all_pairs(spark, metric, least):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.integers(0, 40, (150, 2)), rng.normal(60, 3, (60, 2))]).astype(float)
    x = np.vstack([x, x[:40], x[:20]])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "a": x[:, 0], "b": x[:, 1], "more": ids * 2}))
    got = cluster.dbscan(df, ["a", "b"], 2.5, least, metric).toPandas().set_index("id").loc[ids]
    assert (got["cluster"].to_numpy() == plain_dbscan(x, ids, 2.5, least, metric)).all() and (got["more"] == ids * 2).all()


def test_f1_dbscan_of_many_copies_needs_no_pairs_of_copies(spark):
    began = time.time()
    n = 60_000
    df = spark.range(n).selectExpr("id", "cast(id % 3 * 10 as double) a", "cast(0 as double) b")
    got = cluster.dbscan(df, ["a", "b"], 1.0, 3).groupBy("cluster").count().orderBy("cluster").collect()
    assert [tuple(r) for r in got] == [(0, n // 3), (1, n // 3), (2, n // 3)]
    assert time.time() - began < 60  # the pairs of copies alone would be 1.2 billion


def lattice(spark, n, copies=1):
    """n places as those of the suppliers, each with `copies` values about its own."""
    k = np.tile(np.arange(n), copies)
    x, y = (k * 37 % 101).astype(float), (k * 53 % 97).astype(float)
    off = np.repeat(np.arange(copies) - (copies - 1) / 2, n)
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "value": np.sin(x / 9) + np.cos(y / 7) + off})), np.column_stack([x, y])[:n]


def test_f2_natural_neighbours_take_any_number_of_points(spark):
    df, xy = lattice(spark, 6000, 2)
    cells = spatial.grid(spark, 0.0, 100.0, 0.0, 100.0, 12.5)
    got = spatial.interpolate(df, cells, "natural_neighbor").toPandas()
    assert len(got) == cells.count() and got["value"].notna().all()
    inner = got[(got["x"] > 0) & (got["x"] < 100) & (got["y"] > 0) & (got["y"] < 95)]
    assert np.abs(inner["value"] - np.sin(inner["x"] / 9) - np.cos(inner["y"] / 7)).max() < 0.05
    few = spatial.natural(df, cells, block=500, most=10).toPandas()  # blocks and groups change nothing
    assert np.allclose(few.sort_values(["x", "y"])["value"], got.sort_values(["x", "y"])["value"], atol=1e-12)


def test_f2_natural_neighbours_on_the_rim():
    p = np.array([[0, 0, 1.0], [0, 10, 3.0], [10, 0, 5.0], [10, 10, 7.0], [4, 6, 9.0]])
    at = spatial.natural_model(p)(np.array([[0.0, 2.5], [10.0, 5.0], [-3.0, 9.0], [4.0, 6.0]]))
    assert np.allclose(at, [1.5, 6.0, 3.0, 9.0])


def test_f7_natural_neighbours_give_a_plane_back(spark):
    df, _ = lattice(spark, 6000)
    plane = df.selectExpr("x", "y", "2 + 0.5 * x - 0.25 * y AS value")
    got = spatial.interpolate(plane, spatial.grid(spark, 30.0, 55.0, 30.0, 55.0, 2.5), "natural_neighbor").toPandas()
    assert np.abs(got["value"] - 2 - 0.5 * got["x"] + 0.25 * got["y"]).max() < 1e-9


def test_f6_surface_takes_every_point(spark):
    """The least squares of all rows, as one system gives them; points that do not determine a surface are refused."""
    df, xy = lattice(spark, 6000, 2)
    p = df.toPandas().to_numpy()
    m = spatial.surface_model(p[:, :2].min(0), p[:, :2].max(0), 5, 4)
    c = np.linalg.lstsq(m.design(p[:, :2]), p[:, 2], rcond=None)[0]
    got = spatial.interpolate(df.repartition(5), spatial.grid(spark, 30.0, 55.0, 30.0, 55.0, 5.0), "bspline_surface", nx=5, ny=4).toPandas()
    assert np.allclose(got["value"], m.design(got[["x", "y"]].to_numpy()) @ c, atol=1e-9)
    with pytest.raises(SingularMatrix):
        spatial.surface(df.where("x = 3"), nx=5, ny=4)


def test_f3_panels_solve_as_a_whole_matrix_does():
    rng = np.random.default_rng(9)
    for n, width in ((1, 4), (40, 40), (130, 24)):
        a, b = rng.normal(size=(n, n)), rng.normal(size=(n, 2))
        a[0, 0] = 0 if n > 1 else 1
        lu = PanelLU(n, lambda lo, hi, a=a: a[:, lo:hi].copy(), width)
        assert np.allclose(lu.solve(b), np.linalg.solve(a, b)) and np.allclose(lu.solve(b[:, 0]), np.linalg.solve(a, b[:, 0]))
    with pytest.raises(SingularMatrix):
        PanelLU(9, lambda lo, hi: np.ones((9, hi - lo)), 4)


@pytest.mark.parametrize("kind", ["simple", "ordinary", "universal"])
def test_f3_kriging_by_panels_equals_kriging_in_memory(monkeypatch, kind):
    rng = np.random.default_rng(10)
    p, q = rng.uniform(0, 10, (90, 3)), rng.uniform(0, 10, (20, 2))
    make = lambda: spatial.kriging_model(p[:, :2], p[:, 2], kind, ("spherical", 0.01, 0.1, 6.0), spatial.drift_2d(1))
    whole = make()
    monkeypatch.setattr(spatial, "IN_MEMORY", 50)
    parts = make()
    assert parts.inv is None and np.allclose(parts(q), whole(q), atol=1e-9)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(parts.loo(), whole.loo(), strict=True))


def test_f3_universal_kriging_gives_a_plane_back(spark):
    plane = lattice(spark, 5100)[0].selectExpr("x", "y", "2 + 0.5 * x - 0.25 * y AS value")
    got = spatial.interpolate(plane, spatial.grid(spark, 30.0, 55.0, 30.0, 55.0, 5.0), "kriging", kind="universal").toPandas()
    assert len(got) == 36 and np.abs(got["value"] - 2 - 0.5 * got["x"] + 0.25 * got["y"]).max() < 1e-4


def values_of(p, counts):
    """Rows at the places p (x, y, value): counts[i] values about the i-th, whose mean it is."""
    rows = np.repeat(p, counts, axis=0)
    for i, n in enumerate(counts):
        rows[sum(counts[:i]) : sum(counts[:i]) + n, 2] += 0.3 * (np.arange(n) - (n - 1) / 2)
    return rows


def test_f4_radial_functions_take_any_number_of_points(spark):
    df, xy = lattice(spark, 5100)
    got = spatial.interpolate(df, spatial.grid(spark, 10.0, 90.0, 10.0, 90.0, 20.0), "rbf").toPandas()
    assert len(got) == 25 and np.abs(got["value"] - np.sin(got["x"] / 9) - np.cos(got["y"] / 7)).max() < 0.05


def test_f4_radial_functions_of_copies(spark, monkeypatch):
    """Values at one place are one row of the system, with the same result as a row each; by panels too."""
    rng = np.random.default_rng(11)
    rows = values_of(rng.uniform(0, 10, (60, 3)), [1, 2, 3] * 20)
    df, cells = spark.createDataFrame(pd.DataFrame(rows, columns=["x", "y", "value"])), spatial.grid(spark, 1.0, 9.0, 1.0, 9.0, 2.0)
    want = spatial.rbf_model(rows)
    for most in (2000, 20):
        monkeypatch.setattr(spatial, "IN_MEMORY", most)
        got = spatial.interpolate(df, cells, "rbf").toPandas()
        assert np.allclose(got["value"], want(got[["x", "y"]].to_numpy()), atol=1e-6)


def test_f5_kriging_takes_any_number_of_points(spark):
    df, xy = lattice(spark, 5100)
    got = spatial.interpolate(df, spatial.grid(spark, 10.0, 90.0, 10.0, 90.0, 20.0), "kriging").toPandas()
    assert len(got) == 25 and np.abs(got["value"] - np.sin(got["x"] / 9) - np.cos(got["y"] / 7)).max() < 0.05 and (got["variance"] >= 0).all()


def test_f5_variogram_of_copies_is_that_of_all_pairs():
    rng = np.random.default_rng(12)
    p, counts = rng.uniform(0, 10, (60, 3)), [1, 2, 3] * 20
    rows = values_of(p, counts)
    i, j = np.triu_indices(len(rows), 1)
    h, g = np.hypot(*(rows[i, :2] - rows[j, :2]).T), 0.5 * (rows[i, 2] - rows[j, 2]) ** 2
    b = np.minimum((h / (h.max() / 2) * 15).astype(int), 15)
    n = np.bincount(b, minlength=16)[:15]
    spread = [(0.3 * (np.arange(c) - (c - 1) / 2) @ (0.3 * (np.arange(c) - (c - 1) / 2))) for c in counts]
    lag, gamma, count = spatial.empirical(np.column_stack([p, counts, spread]), 15)
    assert np.allclose(count, n) and np.allclose(lag, np.bincount(b, h, 16)[:15] / n) and np.allclose(gamma, np.bincount(b, g, 16)[:15] / n)


def events_of(spark, tmp_path, micros):
    """A table of events at some microseconds since 1970."""
    rows = spark.createDataFrame(list(enumerate(micros)), "event_id bigint, us bigint").selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) as ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_f8_calendar_fields_stay_within_their_second(spark, tmp_path):
    at = [datetime(2024, 2, 4, 12, 7, 36, 999_999), datetime(2024, 12, 31, 23, 59, 59, 999_999), datetime(2025, 1, 1), datetime(2027, 6, 1, 0, 0, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999_998)]
    sf = events_of(spark, tmp_path, [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in at])
    got = more.calendar_fields(spark, sf).orderBy("event_id").collect()
    assert [(r.doy, r.utc) for r in got] == [(t.timetuple().tm_yday, t.strftime("%Y-%m-%d %H:%M:%S")) for t in at]


def test_f9_gps_seconds_of_week_are_those_of_the_instant(spark, tmp_path):
    """Around the 50 microseconds before a full second that count to the next, as the SQL's numbers have it; and at a leap second."""
    first = (datetime(2025, 3, 4, 5, 6, 7) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    micros = [first + k * 97_000_000 + 999_940 + j for k in range(300) for j in range(20)]
    sf = events_of(spark, tmp_path, micros)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    want = c.sql(f"{catalog.ORACLES['gps_leap_lookup']} ORDER BY event_id").fetchall()
    assert [tuple(r) for r in catalog.gps_leap_lookup(spark, sf).orderBy("event_id").collect()] == want
    us = (datetime(2016, 12, 31, 23, 59, 59, 999_999) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    leap = spark.range(2).select(timefn.leap_seconds(timefn.day_from_timestamp(F.timestamp_micros(F.col("id") + us))).alias("n")).collect()
    assert sorted(r.n for r in leap) == [17, 18]


def test_f10_discriminants_have_no_ridge_where_none_is_needed(spark):
    """Points within the strip by which a ridge of 1e-8 would move the border between two classes; a flat scatter needs the ridge."""
    rng = np.random.default_rng(13)
    x = np.column_stack([rng.normal(0, 1, 200), rng.normal(0, 30, 200)])
    label = np.arange(200) % 2
    x[label == 1] += [0.02, 0.5]
    frame = lambda v, l: spark.createDataFrame(pd.DataFrame({"x": v[:, 0], "y": v[:, 1], "label": l}))
    df, cols = frame(x, label), ["x", "y"]
    means = np.array([x[label == k].mean(0) for k in (0, 1)])
    pooled = sum((x[label == k] - means[k]).T @ (x[label == k] - means[k]) for k in (0, 1))

    def border(ridge, at):
        w = np.linalg.solve(pooled + ridge * np.trace(pooled) / 2 * np.eye(2), means[1] - means[0])
        mid = means.mean(0)
        return mid[0] - w[1] * (at - mid[1]) / w[0], w

    at = np.array([-300.0, -100.0, 200.0, 400.0])
    (a, w), (b, _) = border(0, at), border(1e-8, at)
    asked = np.column_stack([(a + b) / 2, at])
    want = ((asked - means.mean(0)) @ w > 0).astype(int)
    got = {r.y: r.predicted for r in multivariate.lda_predict(frame(asked, want), cols, multivariate.lda(df, cols, "label")).collect()}
    assert [got[y] for y in at] == want.tolist()
    old = {r.y: r.predicted for r in multivariate.lda_predict(frame(asked, want), cols, multivariate.lda(df, cols, "label", compat=True)).collect()}
    assert [old[y] for y in at] == (1 - want).tolist()
    flat = df.withColumn("y", F.col("x") * 2)
    assert multivariate.lda_predict(flat, cols, multivariate.lda(flat, cols, "label")).where("predicted is null").count() == 0


def with_rows_without_a_place(df):
    """The same points and, far from their values, rows whose coordinates are missing or endless."""
    bad = [(None, 5.0, 1e3), (5.0, None, -1e3), (float("nan"), 5.0, 1e3), (5.0, float("inf"), -1e3), (None, None, 1e3)]
    return df.unionByName(df.sparkSession.createDataFrame(bad, "x double, y double, value double"))


def equal_without_a_place(spark, method, n, **kw):
    """The values over a grid, once they are those of the points alone."""
    df, cells = lattice(spark, n)[0], spatial.grid(spark, 10.0, 90.0, 10.0, 90.0, 20.0)
    got, want = (spatial.interpolate(p, cells, method, **kw).toPandas().sort_values(["x", "y"]).to_numpy() for p in (with_rows_without_a_place(df), df))
    assert len(got) == 25 and np.allclose(got, want, atol=1e-9)
    return got


@pytest.mark.parametrize("n", [300, 2500])
def test_f5_kriging_leaves_out_rows_without_a_place(spark, n):
    """In memory and by panels; they used to stop it as if there were no two places."""
    assert (equal_without_a_place(spark, "kriging", n)[:, 3] >= 0).all()


@pytest.mark.parametrize("n", [300, 2500])
def test_f4_radial_functions_leave_out_rows_without_a_place(spark, n):
    """One such row used to make every value of the grid NaN."""
    assert not np.isnan(equal_without_a_place(spark, "rbf", n)).any()


def test_f7_natural_neighbours_leave_out_rows_without_a_place(spark):
    equal_without_a_place(spark, "natural_neighbor", 300)

"""Sources, sinks and streams on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import filters, models
from cadenza.schema import ConfigError, FileNotFound
from cadenza.sources import gnss, sinks, text
from cadenza.streaming import online


def test_delimited_series(spark, tmp_path):
    (tmp_path / "a.csv").write_text("% columns: time, temp [C], hum\n\n51544.0;1.5;7\n51545.0;x;8\n51546.0;2.5;9;\n51547.0;3\n")
    (tmp_path / ".hidden").write_text("51544.0;9;9\n")
    df = text.read_series(spark, str(tmp_path / "a.csv"))
    assert [(r.component, r.unit, r.mjd, r.value) for r in df.orderBy("component", "mjd").collect()] == [("hum", "-", 51544.0, 7.0), ("hum", "-", 51546.0, 9.0), ("temp", "C", 51544.0, 1.5), ("temp", "C", 51546.0, 2.5)]
    assert text.read_series(spark, str(tmp_path / "a.csv"), columns=[2]).count() == 3
    assert text.scan_directory(spark, str(tmp_path)).count() == 4
    with pytest.raises(ConfigError):
        text.read_series(spark, str(tmp_path / "a.csv"), delimiter="::")
    (tmp_path / "sub").mkdir()
    with pytest.raises(FileNotFound):
        text.scan_directory(spark, str(tmp_path / "sub"))


def test_points_and_positions(spark, tmp_path):
    (tmp_path / "p.dat").write_text("# area\n1 2   3\n4 5 -999.99\nx 1 1\n")
    assert [tuple(r) for r in text.read_points(spark, str(tmp_path / "p.dat"), mark=-999.99).collect()] == [("col_2", 1.0, 2.0, 3.0)]
    (tmp_path / "q.csv").write_text("1;2;3;11;12;13;22;23;33\n")
    r = text.read_positions(spark, str(tmp_path / "q.csv")).first()
    assert r.pos == [1, 2, 3] and r.cov == [[11, 12, 13], [12, 22, 23], [13, 23, 33]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "c", 1.0, 2.0), ("s", "c", 0.0, 3.0)], "station_id string, component string, mjd double, filtered double")
    at = str(tmp_path / "out")
    sinks.write(df, at, "filter", rename={"time_mjd": "mjd"})
    back = spark.read.option("sep", ";").option("header", True).csv(at)
    assert back.columns == ["time_mjd", "original", "filtered", "residual", "station_id", "component"] and back.count() == 2
    assert "filtered: 2.0" in sinks.protocol(df).where("mjd = 1").first().protocol


def test_navigation_records():
    head = ["     3.04           N: GNSS NAV DATA    G: GPS              RINEX VERSION / TYPE", "                                                            END OF HEADER"]
    num = lambda v: f"{v:19.12E}".replace("E", "D")
    rec = ["G01 2024 01 01 00 00 00" + num(1e-4) + num(0) + num(0)] + ["    " + "".join(num(v) for v in row) for row in ([1, 2, 3, 0.5], [0, 0.01, 0, 5153.7], [86400, 0, 1, 0], [0.95, 200, 0.3, -8e-9], [0, 1, 2295, 0], [2, 0, 1e-8, 1], [0, 4, 0, 0])]
    r = gnss.parse_nav(head + rec)
    assert len(r) == 1 and r[0]["sat"] == "G01" and r[0]["sqrt_a"] == 5153.7 and r[0]["week"] == 2295 and r[0]["af0"] == 1e-4
    from cadenza.operators.gnss import kepler

    p, clk = kepler(r[0], 2295 * 604800.0 + 86400.0)
    assert 2.5e7 < np.linalg.norm(p) < 2.8e7 and abs(clk) < 1e-3
    obs = ["G    2 C1C L1C                                              SYS / # / OBS TYPES", "                                                            END OF HEADER", "> 2024 01 01 00 00  0.0000000  0  1", "G05  22000000.123   115000000.456  "]
    o = gnss.parse_obs(obs)
    assert o[0]["sat"] == "G05" and o[0]["obs"]["C1C"] == 22000000.123 and o[0]["t"] == gnss.gps_seconds(2024, 1, 1)
    s = gnss.parse_sp3(["*  2024  1  1  0  0  0.00000000", "PG01  10000.000000 -20000.000000  15000.000000    123.456789"])
    assert s[0]["x"] == 1e7 and abs(s[0]["clock"] - 123.456789e-6) < 1e-15


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("s", c, 51544.0 + i, float(v)) for c in "ab" for i, v in enumerate(rng.normal(size=20))]
    schema = "station_id string, component string, mjd double, value double"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))

    def drained(make, name):
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    key = lambda df, c: [(r.component, r.mjd, round(r[c], 9)) for r in df.orderBy("component", "mjd").collect()]
    assert key(drained(lambda s: online.ema(s, 0.3), "ema"), "filtered") == key(filters.ema(batch, 0.3), "filtered")
    m = models.kalman_model("local_level", 0.1, 1.0)
    got = key(drained(lambda s: online.kalman(s, "local_level", 0.1, 1.0), "kal"), "filtered")
    want = []
    for c in "ab":
        y = np.array([r[3] for r in rows if r[1] == c])
        want += [round(float(v), 9) for v in models.kalman_np(y, m)["x"][:, 0]]
    assert [g[2] for g in got] == want
    qc = online.windowed_qc(batch.withColumn("t", F.timestamp_seconds((F.col("mjd") - 40587) * 86400)), "5 days")
    assert sum(r.n for r in qc.collect()) == 40

"""Further registered queries: files written and read back, sets and joins on time, fits, spectra, navigation, clusters.

Where an operator's result has no closed form, its input is made from a known answer (a polynomial, a planted step, a
cubic, two blobs), so that SQL can state what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import dist, numeric
from cadenza.functions import geodesy as geo
from cadenza.functions import timefn as tf
from cadenza.operators import cluster, extremes, filters, gaps, gnss, homogeneity, hypothesis, models, multivariate, ordered, regression, relational, resample, spatial, splines, stats
from cadenza.operators.series import reduce_series
from cadenza.plans import fixtures as fx
from cadenza.plans.catalog import ORACLES, QUERIES, K, POINTS, W, WO, _with, customer_points, query, rounded
from cadenza.plans.fixtures import KEY, SQL_EVENTS, SQL_GAPPY, SQL_ORDERS, SQL_SHIP
from cadenza.session import scratch
from cadenza.sources import gnss as files
from cadenza.sources import sinks, text
from cadenza.streaming import online


def file_of(df: DataFrame, name: str) -> str:
    """The rows of df (n, line) as one text file, in the order of n; its folder."""
    at = scratch(df.sparkSession, name)
    df.coalesce(1).sortWithinPartitions("n").select("line").write.text(at)
    return at


def number(c: str):
    """A number as text that reads back the same."""
    return F.col(c).cast("string")


# ---- sources -------------------------------------------------------------------------------------------------------


def noisy_file(spark, sf) -> str:
    """Daily revenue as a file with a header, comments, blank lines and lines that cannot be read."""
    o = fx.orders_daily(spark, sf).select((F.col("mjd") * 10 + 5).alias("n"), F.concat_ws(";", number("mjd"), number("value")).alias("line"), "mjd")
    d = F.col("mjd").cast("bigint")
    bad = F.array(
        F.when(d % 50 == 0, F.struct(F.lit(1.0).alias("k"), F.lit("% a note").alias("line"))), F.when(d % 70 == 0, F.struct(F.lit(2.0).alias("k"), F.lit("  ").alias("line"))),
        F.when(d % 90 == 0, F.struct(F.lit(3.0).alias("k"), F.lit("51544.0;x").alias("line"))), F.when(d % 110 == 0, F.struct(F.lit(4.0).alias("k"), F.lit("51544.5").alias("line"))),
    )
    noise = o.select("n", F.explode(F.array_compact(bad)).alias("e")).select((F.col("n") + F.col("e.k")).alias("n"), "e.line")
    head = spark.createDataFrame([(-2.0, "% daily revenue"), (-1.0, "% Columns: time, revenue [cent]")], "n double, line string")
    return file_of(head.unionByName(o.select("n", "line")).unionByName(noise), "scan")


@query("scan_series", _with(SQL_ORDERS) + "SELECT 'orders' AS station_id, 'revenue' AS component, 'cent' AS unit, mjd, value FROM orders_daily")
def scan_series(spark, sf):
    return text.read_series(spark, noisy_file(spark, sf), station="orders").select("station_id", "component", "unit", "mjd", "value")


@query("scan_report", _with(SQL_ORDERS) + """, c AS (SELECT count(*) AS n, sum((mjd::BIGINT % 50 = 0)::INT) AS a, sum((mjd::BIGINT % 70 = 0)::INT) AS b, sum((mjd::BIGINT % 90 = 0)::INT) AS c, sum((mjd::BIGINT % 110 = 0)::INT) AS d FROM orders_daily)
    SELECT 2 + n + a + b + c + d AS n_lines, b AS n_blank, 2 + a AS n_comment, n + c + d AS n_data, n AS n_read, c + d AS n_skipped FROM c""")
def scan_report(spark, sf):
    return text.read_report(spark, noisy_file(spark, sf)).drop("path")


@query("scan_files", _with(SQL_ORDERS, SQL_SHIP) + """SELECT 'good' AS outcome, 'revenue' AS component, count(*) AS n FROM orders_daily UNION ALL SELECT 'good', 'col_2', count(*) FROM ship_daily
    UNION ALL SELECT 'ParseError', '-', 1 UNION ALL SELECT 'AnalysisException', '-', 1""")
def scan_files(spark, sf):
    """Two good files of unlike layouts, one without data and one that is not there: the good ones are read."""
    ship = fx.ship_daily(spark, sf).select(F.col("mjd").alias("n"), F.concat_ws(";", number("mjd"), number("value")).alias("line"))
    empty = spark.createDataFrame([(0.0, "% nothing")], "n double, line string")
    paths = [noisy_file(spark, sf), file_of(ship, "ship"), file_of(empty, "empty"), scratch(spark, "absent")]
    rows, errors = text.read_each(spark, paths)
    bad = spark.createDataFrame([(e.split(":")[0], "-", 1) for e in errors.values()], "outcome string, component string, n bigint")
    return rows.groupBy(F.lit("good").alias("outcome"), "component").agg(F.count("*").alias("n")).unionByName(bad)


@query("scan_times", """SELECT event_id, epoch_us(ts) / 8.64e10 + 40587 AS m, round(epoch_us(ts) / 8.64e10 + 40587, 8) AS mjd, round(epoch_us(ts) / 8.64e10 + 40587, 8) AS utc, round(epoch_us(ts) / 8.64e10 + 40587, 8) AS unix,
    round(epoch_us(ts) / 8.64e10 + 40587, 8) AS gps, round(epoch_us(ts) / 8.64e10 + 40587, 8) AS week FROM events""".replace("epoch_us(ts) / 8.64e10 + 40587 AS m, ", ""))
def scan_times(spark, sf):
    """Each event's time written in five ways and parsed back."""
    e = fx.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("t")).withColumn("m", tf.mjd_from_timestamp(F.col("t")))
    s = F.unix_micros("t")
    total = F.floor(s / 1000000) - 315964800 + 18
    frac = F.lpad((s % 1000000).cast("string"), 6, "0")
    texts = {
        "mjd": ("mjd", [F.col("m").cast("string")]),
        "utc": ("utc", [F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "HH:mm:ss.SSSSSS")]),
        "unix": ("unix", [F.concat(F.floor(s / 1000000).cast("string"), F.lit("."), frac)]),
        "gps": ("gps_total_seconds", [F.concat(total.cast("string"), F.lit("."), frac)]),
        "week": ("gps_week_sow", [F.floor(total / 604800).cast("string"), F.concat((total % 604800).cast("string"), F.lit("."), frac)]),
    }
    return e.select("event_id", *[F.round(tf.parse_time(f, x), 8).alias(n) for n, (f, x) in texts.items()])


@query("scan_points", "SELECT 'balance' AS var, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y, s_acctbal AS value FROM supplier WHERE s_suppkey % 13 <> 0")
def scan_points(spark, sf):
    """A table of points by white space, with no-data marks and lines that are no points."""
    s = fx.read(spark, sf, "supplier").withColumns({"x": F.col("s_suppkey") * 37 % 101, "y": F.col("s_suppkey") * 53 % 97, "v": F.when(F.col("s_suppkey") % 13 == 0, F.lit("-999.9912")).otherwise(number("s_acctbal"))})
    rows = s.select(F.col("s_suppkey").cast("double").alias("n"), F.concat_ws("   ", F.col("x").cast("string"), F.col("y").cast("string"), "v").alias("line"))
    head = spark.createDataFrame([(-5.0, "# points"), (-4.0, "# 3"), (-3.0, "# balance"), (1e9, "x y z")], "n double, line string")
    return text.read_points(spark, file_of(head.unionByName(rows), "points"), mark=-999.99).withColumn("var", F.regexp_replace("var", "^col_2$", "balance"))


@query("scan_positions", f"WITH {POINTS} SELECT lat AS x, lon AS y, h AS z, 4.0::DOUBLE AS xx, 0.5::DOUBLE AS xz, 9.0::DOUBLE AS zz FROM p")
def scan_positions(spark, sf):
    c = customer_points(spark, sf)
    rows = c.select(F.col("c_custkey").cast("double").alias("n"), F.concat_ws(";", number("lat"), number("lon"), number("h"), F.lit("4.0;0.1;0.5;1.0;0.2;9.0")).alias("line"))
    p = text.read_positions(spark, file_of(rows, "positions"))
    return p.select(*[F.col("pos")[i].alias(n) for i, n in enumerate("xyz")], F.col("cov")[0][0].alias("xx"), F.col("cov")[2][0].alias("xz"), F.col("cov")[2][2].alias("zz"))


# ---- sinks ---------------------------------------------------------------------------------------------------------


def written(spark, df: DataFrame, layout: str, rename: dict[str, str] | None = None, fmt: str = "csv") -> DataFrame:
    """df through a sink and back, with the types that it had."""
    at = scratch(spark, layout)
    sinks.write(df, at, layout, fmt, rename)
    want = sinks.shaped(df, layout, rename)
    back = spark.read.option("sep", ";").option("header", True).csv(at) if fmt == "csv" else spark.read.parquet(at)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.schema.fields])


@query("sink_filter", _with(SQL_ORDERS) + f""", f AS (SELECT *, avg(value) OVER ({WO} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS a, count(*) OVER ({WO} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM orders_daily)
    SELECT {K}, mjd AS time_mjd, value AS original, CASE WHEN n = 11 THEN round(a, 4) END AS filtered, CASE WHEN n = 11 THEN round(value - a, 4) END AS residual FROM f""")
def sink_filter(spark, sf):
    x = filters.moving_average(fx.orders_daily(spark, sf), 11)
    x = x.withColumns({"original": F.col("value"), "filtered": F.when(~F.isnan("filtered"), F.col("filtered"))}).withColumn("residual", F.round(F.col("value") - F.col("filtered"), 4) + 0.0)
    return written(spark, x.withColumn("filtered", F.round("filtered", 4)), "filter", {"time_mjd": "mjd"})


@query("sink_qc", _with(SQL_ORDERS) + f"SELECT {K}, mjd, value, (mjd::BIGINT % 4)::DOUBLE AS qc_flag FROM orders_daily")
def sink_qc(spark, sf):
    return written(spark, fx.orders_daily(spark, sf).withColumn("qc_flag", (F.col("mjd").cast("bigint") % 4).cast("double")), "qc")


@query("sink_spatial_parquet", "SELECT (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y, s_acctbal AS value, NULL::DOUBLE AS variance, NULL::DOUBLE AS ci_lower, NULL::DOUBLE AS ci_upper FROM supplier")
def sink_spatial_parquet(spark, sf):
    return written(spark, plane(spark, sf), "spatial", fmt="parquet")


def layout_sql(name: str) -> str:
    """A row a key of every column of a layout, numbered, as SQL."""
    cols = sinks.LAYOUTS[name]
    return _with(SQL_ORDERS) + f"SELECT {K}, " + ", ".join(f"round(mjd + {i}, 3) AS \"{c}\"" for i, c in enumerate(cols)) + " FROM orders_daily"


def layout_query(name: str):
    def run(spark, sf):
        df = fx.orders_daily(spark, sf).select(*KEY, *[F.round(F.col("mjd") + i, 3).alias(c) for i, c in enumerate(sinks.LAYOUTS[name])])
        return written(spark, df, name)

    return run


for _name in sinks.LAYOUTS:
    if f"sink_{_name}" not in QUERIES:
        query(f"sink_{_name}", layout_sql(_name))(layout_query(_name))


@query("protocol_text", _with(SQL_ORDERS) + f"SELECT {K}, 'n: ' || count(*) || chr(10) || 'first: ' || min(mjd)::BIGINT || chr(10) || 'none: -' AS protocol FROM orders_daily GROUP BY {K}")
def protocol_text(spark, sf):
    s = fx.orders_daily(spark, sf).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("mjd").cast("bigint").alias("first"), F.lit(None).cast("double").alias("none"))
    return sinks.protocol(s)


@query("protocol_of_summary", _with(SQL_EVENTS) + f"""SELECT {K}, 'Quality control' || chr(10) || '===============' || chr(10) || 'station_id: ' || station_id || chr(10) || 'component: ' || component || chr(10) || 'rows: ' || count(*) || chr(10) || 'missing: 0' || chr(10) || 'other: 7' AS protocol FROM events_hourly GROUP BY {K}""")
def protocol_of_summary(spark, sf):
    s = fx.events_hourly(spark, sf).groupBy(*KEY).agg(F.lit(7).alias("other"), F.count_if(F.isnan("value")).alias("n_missing"), F.count("*").alias("n"))
    return sinks.protocol(s, kind="qc")


# ---- sets, look-ups and joins on time ------------------------------------------------------------------------------


@query("at_time", _with(SQL_ORDERS) + f"SELECT {K}, mjd, value FROM orders_daily ORDER BY abs(mjd - 50000.3), mjd DESC LIMIT 1")
def at_time(spark, sf):
    return relational.at_time(fx.orders_daily(spark, sf), 50000.3, 40.0)


@query("series_ends", _with(SQL_EVENTS) + f"SELECT {K}, count(*) AS n, min(mjd) AS first_mjd, arg_min(value, mjd) AS first_value, max(mjd) AS last_mjd, arg_max(value, mjd) AS last_value FROM events_hourly GROUP BY {K}")
def series_ends(spark, sf):
    return relational.ends(fx.events_hourly(spark, sf))


@query("derived_names", _with(SQL_ORDERS) + f"SELECT station_id, component || '_diff' AS component, mjd, round(value - lag(value) OVER ({WO}), 2) AS value FROM orders_daily QUALIFY value IS NOT NULL AND row_number() OVER ({WO}) > 1")
def derived_names(spark, sf):
    return rounded(relational.derived(stats.lagged_diff(fx.orders_daily(spark, sf)), "difference", "diff"), 2, "value").select(*KEY, "mjd", "value")


@query("nan_policy", _with(SQL_ORDERS, SQL_GAPPY) + f"SELECT 'skip' AS policy, {K}, count(value) AS n, round(avg(value), 6) AS mean FROM gappy GROUP BY {K} UNION ALL SELECT 'propagate', {K}, 0, NULL FROM gappy GROUP BY {K}")
def nan_policy(spark, sf):
    g = fx.gappy(fx.orders_daily(spark, sf))
    out = None
    for p in ("skip", "propagate"):
        one = stats.with_policy(g, p).groupBy(F.lit(p).alias("policy"), *KEY).agg(F.count_if(~F.isnan("value")).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("mean", F.when(~F.isnan("mean"), F.col("mean")))


@query("standardise_channels", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 8) AS q, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 8) AS p FROM lineitem")
def standardise_channels(spark, sf):
    l = fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return rounded(relational.standardise(l, ["q", "p"]), 8, "q", "p")


SHIFTED = "s AS (SELECT mjd + 0.25 * (1 + mjd::BIGINT % 3) AS mjd, value FROM ship_daily)"


def shifted_ship(spark, sf) -> DataFrame:
    return fx.ship_daily(spark, sf).withColumn("mjd", F.col("mjd") + 0.25 * (1 + F.col("mjd").cast("bigint") % 3))


@query("sync_outer_greedy", "WITH RECURSIVE " + ", ".join([SQL_ORDERS, SQL_SHIP, SHIFTED]) + """, u AS (SELECT mjd, row_number() OVER (ORDER BY mjd) AS i FROM (SELECT mjd FROM orders_daily UNION ALL SELECT mjd FROM s)),
    g AS (SELECT i, mjd, mjd AS head FROM u WHERE i = 1 UNION ALL SELECT u.i, u.mjd, CASE WHEN u.mjd - g.head <= 0.4 THEN g.head ELSE u.mjd END FROM g JOIN u ON u.i = g.i + 1)
    SELECT round(avg(mjd), 9) AS mjd FROM g GROUP BY head""")
def sync_outer_greedy(spark, sf):
    return relational.sync_outer([fx.orders_daily(spark, sf), shifted_ship(spark, sf)], 0.4, range_rows=700).select(F.round("mjd", 9).alias("mjd"))


@query("assemble_channels", _with(SQL_ORDERS, SQL_SHIP, SHIFTED) + """, a AS (SELECT mjd FROM orders_daily o WHERE EXISTS (SELECT 1 FROM s WHERE abs(s.mjd - o.mjd) <= 0.6)),
    j AS (SELECT a.mjd, o.value AS revenue, s.value AS quantity, row_number() OVER (PARTITION BY a.mjd ORDER BY abs(s.mjd - a.mjd), s.mjd DESC) AS k FROM a JOIN orders_daily o ON o.mjd = a.mjd JOIN s ON abs(s.mjd - a.mjd) <= 0.6)
    SELECT mjd, round((revenue - avg(revenue) OVER ()) / stddev_pop(revenue) OVER (), 8) AS revenue, round((quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER (), 8) AS quantity FROM j WHERE k = 1""")
def assemble_channels(spark, sf):
    x = relational.assemble({"revenue": fx.orders_daily(spark, sf), "quantity": shifted_ship(spark, sf)}, 0.6, z_scores=True)
    return rounded(x, 8, "revenue", "quantity")


@query("dbscan_suppliers", """WITH RECURSIVE p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y FROM supplier),
    n AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 7.5),
    c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3), e AS (SELECT n.a, n.b FROM n JOIN c ON n.a = c.a JOIN c c2 ON n.b = c2.a),
    r AS (SELECT a, a AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a),
    o AS (SELECT n.a AS id, arg_min(l.cluster, n.d * 1e9 + n.b) AS border FROM n JOIN l ON n.b = l.id GROUP BY n.a)
    SELECT p.id, coalesce(l.cluster, o.border, -1) AS cluster FROM p LEFT JOIN l ON p.id = l.id LEFT JOIN o ON p.id = o.id""")
def dbscan_suppliers(spark, sf):
    p = plane(spark, sf, "s_suppkey").select(F.col("s_suppkey").alias("id"), "x", "y")
    return cluster.dbscan(p, ["x", "y"], 7.5, 3).select("id", "cluster")


def plane(spark, sf, *more: str) -> DataFrame:
    s = fx.read(spark, sf, "supplier")
    return s.select(*more, (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 97).cast("double").alias("y"), F.col("s_acctbal").alias("value"))


# ---- distributions: the oracle integrates densities by Simpson's rule in 2000 steps ---------------------------------


@query("distribution_functions", """WITH t AS (SELECT unnest(['normal', 'normal', 't', 't', 'chi2', 'chi2', 'f']) AS d, unnest([1.3, -0.4, 2.1, -1.7, 6.5, 3.2, 1.9]) AS x, unnest([0.0, 0, 7, 4, 5, 8, 6]) AS a, unnest([0.0, 0, 0, 0, 0, 0, 9]) AS b),
    g AS (SELECT d, x, a, b, i, x * i / 2000.0 AS u FROM t CROSS JOIN (SELECT unnest(range(0, 2001)) AS i)),
    f AS (SELECT *, CASE d WHEN 'normal' THEN exp(-u * u / 2) / sqrt(2 * pi()) WHEN 't' THEN exp(lgamma((a + 1) / 2) - lgamma(greatest(a, 1) / 2)) / sqrt(greatest(a, 1) * pi()) * pow(1 + u * u / greatest(a, 1), -(a + 1) / 2)
        WHEN 'chi2' THEN pow(u, a / 2 - 1) * exp(-u / 2) / (pow(2, a / 2) * exp(lgamma(greatest(a, 1) / 2)))
        ELSE exp(lgamma((a + b) / 2) - lgamma(greatest(a, 1) / 2) - lgamma(greatest(b, 1) / 2)) * pow(greatest(a, 1) / greatest(b, 1), a / 2) * pow(u, a / 2 - 1) * pow(1 + a * u / greatest(b, 1), -(a + b) / 2) END AS f FROM g)
    SELECT d, x, round(sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * f) * x / 6000 + CASE WHEN d IN ('normal', 't') THEN 0.5 ELSE 0 END, 6) AS p FROM f GROUP BY d, x, a, b""")
def distribution_functions(spark, sf):
    t = spark.createDataFrame([("normal", 1.3, 0.0, 0.0), ("normal", -0.4, 0.0, 0.0), ("t", 2.1, 7.0, 0.0), ("t", -1.7, 4.0, 0.0), ("chi2", 6.5, 5.0, 0.0), ("chi2", 3.2, 8.0, 0.0), ("f", 1.9, 6.0, 9.0)], "d string, x double, a double, b double")
    one = lambda c: F.greatest(F.col(c), F.lit(1.0))
    p = F.when(F.col("d") == "normal", dist.normal_cdf_col(F.col("x"))).when(F.col("d") == "t", dist.t_cdf_col(F.col("x"), one("a"))).when(F.col("d") == "chi2", dist.chi2_cdf_col(F.col("x"), one("a"))).otherwise(dist.f_cdf_col(F.col("x"), one("a"), one("b")))
    return t.select("d", "x", F.round(p, 6).alias("p"))


@query("distribution_quantiles", """SELECT p, round(tan(pi() * (p - 0.5)), 8) AS t1, round((2 * p - 1) * sqrt(2 / (4 * p * (1 - p))), 8) AS t2, round(-2 * ln(1 - p), 8) AS chi2, p AS normal_back FROM (SELECT unnest([0.05, 0.25, 0.5, 0.9, 0.975, 0.999]) AS p)""")
def distribution_quantiles(spark, sf):
    """Closed forms of one and two degrees of freedom; the normal quantile by its distribution function."""
    rows = [(p, round(float(dist.t_quantile(p, 1)), 8) + 0.0, round(float(dist.t_quantile(p, 2)), 8) + 0.0, round(float(dist.chi2_quantile(p, 2)), 8), round(float(dist.normal_cdf(dist.normal_quantile(p))), 6)) for p in (0.05, 0.25, 0.5, 0.9, 0.975, 0.999)]
    return spark.createDataFrame(rows, "p double, t1 double, t2 double, chi2 double, normal_back double")


# ---- fits ----------------------------------------------------------------------------------------------------------

MOMENTS = "m AS (SELECT count(*) AS n, sum(x) AS x1, sum(x * x) AS x2, sum(pow(x, 3)) AS x3, sum(pow(x, 4)) AS x4, sum(value) AS y0, sum(x * value) AS y1, sum(x * x * value) AS y2 FROM c)"


@query("quadratic_fit", _with(SQL_ORDERS) + f""", c AS (SELECT {K}, (mjd - min(mjd) OVER ()) / 1000 AS x, value FROM orders_daily), {MOMENTS}, d AS (SELECT *, n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2) AS det FROM m)
    SELECT 'orders' AS station_id, 'revenue' AS component, round((y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - y2 * x3) + x2 * (y1 * x3 - y2 * x2)) / det, 2) AS c0,
    round((n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1)) / det, 2) AS c1, round((n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)) / det, 2) AS c2 FROM d""")
def quadratic_fit(spark, sf):
    f = regression.fit(fx.orders_daily(spark, sf), "polynomial", degree=2)
    c = F.col("coefficients")
    return f.select(*KEY, (F.round(c[0], 2) + 0.0).alias("c0"), (F.round(c[1] * 1000, 2) + 0.0).alias("c1"), (F.round(c[2] * 1e6, 2) + 0.0).alias("c2"))


def known_series(spark, n: int, value, step: float = 1.0) -> DataFrame:
    """A series of n rows from MJD 60000 whose value is an expression of i."""
    i = F.col("id").cast("double")
    return spark.range(n).select(F.lit("made").alias("station_id"), F.lit("x").alias("component"), (60000 + i * step).alias("mjd"), value(i).cast("double").alias("value"))


@query("robust_fit_known", "SELECT 'made' AS station_id, 'x' AS component, 3.0::DOUBLE AS c0, 0.25::DOUBLE AS c1")
def robust_fit_known(spark, sf):
    """A line with one value in twenty far off: the weights of those vanish."""
    x = known_series(spark, 200, lambda i: 3 + 0.25 * i + F.when(i % 20 == 7, 500.0).otherwise(0.0) + 1e-3 * F.sin(i * 1.7))
    f = regression.fit(x, "robust", robust="bisquare")
    return f.select(*KEY, (F.round(F.col("coefficients")[0], 2) + 0.0).alias("c0"), (F.round(F.col("coefficients")[1], 4) + 0.0).alias("c1"))


@query("spline_fill_known", "SELECT 'made' AS station_id, 'x' AS component, 60000.0 + i AS mjd, round(5 + 2 * i - 0.03 * i * i + 0.0004 * pow(i, 3), 6) AS filled FROM (SELECT unnest(range(0, 120)) AS i)")
def spline_fill_known(spark, sf):
    """Gaps in a cubic, which a spline through the other rows gives back."""
    cubic = lambda i: 5 + 2 * i - 0.03 * i * i + 0.0004 * i * i * i
    x = known_series(spark, 120, lambda i: F.when((i > 5) & (i < 114) & (i % 9).isin(3, 4, 5), F.lit(float("nan"))).otherwise(cubic(i)))
    return rounded(gaps.fill(x, "spline"), 6, "filled").select(*KEY, "mjd", "filled")




def planted(spark) -> DataFrame:
    """Levels 0, 5 and -2 with a small regular disturbance. Binary segmentation first splits at the larger step, whose shift
    is from the mean of both levels before it; one pass over all segments measures from level to level."""
    return known_series(spark, 300, lambda i: F.when(i < 100, 0.0).when(i < 200, 5.0).otherwise(-2.0) + 0.05 * F.sin(i * 2.399) + 0.03 * F.cos(i * 5.1))


for _name in ("yao_davis", "snht", "pelt", "bocpd"):

    @query(f"planted_steps_{_name}", f"SELECT 'made' AS station_id, 'x' AS component, unnest([100, 200])::BIGINT AS global_index, unnest([60100.0, 60200.0])::DOUBLE AS mjd, unnest([5.0, {-4.5 if _name in ('yao_davis', 'snht') else -7.0}])::DOUBLE AS shift")
    def _planted(spark, sf, method=_name):
        kw = {"pelt": {"least": 10}}.get(method, {})
        return rounded(homogeneity.change_points(planted(spark), method, **kw), 1, "shift").select(*KEY, "global_index", "mjd", "shift")


@query("change_point_interval", "SELECT 'made' AS station_id, 'x' AS component, 60100.0::DOUBLE AS mjd, true AS inside")
def change_point_interval(spark, sf):
    x = planted(spark).where("mjd < 60200")
    return homogeneity.change_points(x).select(*KEY, "mjd", ((F.col("mjd_low") <= F.col("mjd")) & (F.col("mjd") <= F.col("mjd_high")) & (F.col("mjd_high") - F.col("mjd_low") <= 4)).alias("inside"))


@query("nonlinear_known", "SELECT 'made' AS station_id, 'x' AS component, 4.0::DOUBLE AS a, 0.03::DOUBLE AS b")
def nonlinear_known(spark, sf):
    """Levenberg-Marquardt on values of a known curve."""
    import numpy as np

    x = known_series(spark, 100, lambda i: 4 * F.exp(-0.03 * i))
    f = regression.nonlinear(x, lambda t, p: p[0] * np.exp(-p[1] * t), [1.0, 0.1])
    return f.select(*KEY, F.round(F.col("coefficients")[0], 6).alias("a"), F.round(F.col("coefficients")[1], 8).alias("b"))


@query("var_two_channels", _with(SQL_ORDERS, SQL_SHIP) + """, x AS (SELECT o.mjd, (o.value - avg(o.value) OVER ()) / 1e6 AS a, (s.value - avg(s.value) OVER ()) / 1e3 AS b FROM orders_daily o JOIN ship_daily s ON o.mjd = s.mjd),
    l AS (SELECT a, b, lag(a) OVER (ORDER BY mjd) AS a1, lag(b) OVER (ORDER BY mjd) AS b1 FROM x), m AS (SELECT sum(a1 * a1) AS aa, sum(a1 * b1) AS ab, sum(b1 * b1) AS bb, sum(a * a1) AS ya, sum(a * b1) AS yb, sum(b * a1) AS za, sum(b * b1) AS zb FROM l WHERE a1 IS NOT NULL)
    SELECT round((ya * bb - yb * ab) / (aa * bb - ab * ab), 6) AS aa, round((yb * aa - ya * ab) / (aa * bb - ab * ab), 6) AS ab, round((za * bb - zb * ab) / (aa * bb - ab * ab), 6) AS ba, round((zb * aa - za * ab) / (aa * bb - ab * ab), 6) AS bb FROM m""")
def var_two_channels(spark, sf):
    c = multivariate.var_fit(two_channels(spark, sf), ["a", "b"], 1)["coefficients"]
    return spark.createDataFrame([[round(float(v), 6) + 0.0 for v in c[:2, :2].ravel()]], "aa double, ab double, ba double, bb double")


def two_channels(spark, sf) -> DataFrame:
    x = fx.orders_daily(spark, sf).select("mjd", F.col("value").alias("a")).join(fx.ship_daily(spark, sf).select("mjd", F.col("value").alias("b")), "mjd")
    m = x.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb")).first()
    return x.select("mjd", ((F.col("a") - m.ma) / 1e6).alias("a"), ((F.col("b") - m.mb) / 1e3).alias("b"))


@query("granger_two_channels", _with(SQL_ORDERS, SQL_SHIP) + """, x AS (SELECT o.mjd, (o.value - avg(o.value) OVER ()) / 1e6 AS a, (s.value - avg(s.value) OVER ()) / 1e3 AS b FROM orders_daily o JOIN ship_daily s ON o.mjd = s.mjd),
    l AS (SELECT a, b, lag(a) OVER (ORDER BY mjd) AS a1, lag(b) OVER (ORDER BY mjd) AS b1 FROM x), m AS (SELECT count(*) AS n, sum(a1 * a1) AS aa, sum(a1 * b1) AS ab, sum(b1 * b1) AS bb, sum(a * a1) AS ya, sum(a * b1) AS yb, sum(b * a1) AS za, sum(b * b1) AS zb, sum(a * a) AS yy, sum(b * b) AS zz FROM l WHERE a1 IS NOT NULL),
    r AS (SELECT n, yy - ya * ya / aa AS ra, yy - (ya * (ya * bb - yb * ab) + yb * (yb * aa - ya * ab)) / (aa * bb - ab * ab) AS ua, zz - zb * zb / bb AS rb, zz - (za * (za * bb - zb * ab) + zb * (zb * aa - za * ab)) / (aa * bb - ab * ab) AS ub FROM m)
    SELECT 'b' AS cause, 'a' AS effect, round((ra - ua) / (ua / (n - 2)), 5) AS f FROM r UNION ALL SELECT 'a', 'b', round((rb - ub) / (ub / (n - 2)), 5) FROM r""")
def granger_two_channels(spark, sf):
    g = multivariate.analyze(two_channels(spark, sf), "granger", ["a", "b"], lag=1)
    return spark.createDataFrame([(r["cause"], r["effect"], round(float(r["f"]), 5)) for r in g], "cause string, effect string, f double")


# ---- spectra -------------------------------------------------------------------------------------------------------


@query("kalman_recursion", "WITH RECURSIVE " + SQL_EVENTS + f""", y AS (SELECT {K}, mjd, value, row_number() OVER ({WO}) AS i FROM events_hourly),
    r AS (SELECT {K}, mjd, i, value AS x0, 20.1 * 2.0::DOUBLE / 22.1 AS p, value AS x FROM y WHERE i = 1
      UNION ALL SELECT y.station_id, y.component, y.mjd, y.i, y.value, (r.p + 0.1) * 2.0 / (r.p + 0.1 + 2.0), r.x + (r.p + 0.1) / (r.p + 0.1 + 2.0) * (y.value - r.x) FROM r JOIN y ON y.i = r.i + 1 AND y.component = r.component)
    SELECT {K}, mjd, round(x, 5) AS filtered FROM r""")
def kalman_recursion(spark, sf):
    """A local level with given noise."""
    k = models.kalman(fx.events_hourly(spark, sf), "local_level", "manual", 0.1, 2.0)
    return rounded(k.select(*KEY, "mjd", "filtered"), 5, "filtered")


@query("periodogram_sums", _with(SQL_EVENTS) + f""", x AS (SELECT {K}, row_number() OVER ({WO}) - 1 AS i, count(*) OVER ({W}) AS n, value - avg(value) OVER ({W}) AS c FROM events_hourly),
    m AS (SELECT *, pow(2, ceil(log2(n))) AS m FROM x), f AS (SELECT {K}, k, n, sum(c * cos(2 * pi() * k * i / m)) AS a, sum(c * sin(2 * pi() * k * i / m)) AS b FROM m CROSS JOIN (SELECT unnest(range(1, 200)) AS k) GROUP BY {K}, k, n)
    SELECT {K}, k, round(2 * (a * a + b * b) / 24 / n, 5) AS psd FROM f""")
def periodogram_sums(spark, sf):
    """The transform of each hourly series at its first 199 frequencies, without a window."""
    p = models.spectrum(fx.events_hourly(spark, sf), window="rectangular")
    w = Window.partitionBy(*KEY).orderBy("frequency")
    return p.withColumn("k", (F.row_number().over(w) - 1).cast("bigint")).where("k between 1 and 199").select(*KEY, "k", (F.round("psd", 5) + 0.0).alias("psd"))


# ---- several channels ----------------------------------------------------------------------------------------------

LINES = "c AS (SELECT l_returnflag AS label, l_quantity::DOUBLE AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem)"


def lines_of(spark, sf) -> DataFrame:
    l = fx.read(spark, sf, "lineitem")
    return l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("mjd"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))


@query("pca_two_channels", f"""WITH {LINES}, m AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM c), e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS l1, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c) AS l2 FROM m)
    SELECT round(l1, 5) AS l1, round(l2, 6) AS l2, round(l1 / (l1 + l2), 8) AS share, round(abs(c / sqrt(c * c + pow(l1 - a, 2))), 7) AS w1, round(abs((l1 - a) / sqrt(c * c + pow(l1 - a, 2))), 7) AS w2 FROM e""")
def pca_two_channels(spark, sf):
    m = multivariate.analyze(lines_of(spark, sf), "pca", ["x", "y"])
    v, l = m["variances"], abs(m["loadings"][:, 0])
    return spark.createDataFrame([[round(float(v[0]), 5), round(float(v[1]), 6), round(float(m["shares"][0]), 8), round(float(l[0]), 7), round(float(l[1]), 7)]], "l1 double, l2 double, share double, w1 double, w2 double")


@query("mahalanobis_two_channels", f"""WITH {LINES}, m AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c, avg(x) AS mx, avg(y) AS my FROM c)
    SELECT round(sqrt((b * pow(x - mx, 2) - 2 * c * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * b - c * c)), 6) AS distance FROM c, m""")
def mahalanobis_two_channels(spark, sf):
    return rounded(multivariate.mahalanobis(lines_of(spark, sf), ["x", "y"]).select("distance"), 6, "distance")


@query("manova_two_channels", f"""WITH {LINES}, g AS (SELECT label, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM c GROUP BY label), w AS (SELECT sum(n * a) AS a, sum(n * b) AS b, sum(n * c) AS c FROM g),
    t AS (SELECT count(*) * var_pop(x) AS a, count(*) * var_pop(y) AS b, count(*) * covar_pop(x, y) AS c FROM c) SELECT round((w.a * w.b - w.c * w.c) / (t.a * t.b - t.c * t.c), 9) AS wilks FROM w, t""")
def manova_two_channels(spark, sf):
    return spark.createDataFrame([(round(float(multivariate.manova(lines_of(spark, sf), ["x", "y"], "label")["wilks"]), 9),)], "wilks double")


@query("cca_one_against_one", f"WITH {LINES} SELECT round(abs(corr(x, y)), 8) AS r FROM c")
def cca_one_against_one(spark, sf):
    return spark.createDataFrame([(round(float(multivariate.cca(lines_of(spark, sf), ["x"], ["y"])["correlations"][0]), 8),)], "r double")


@query("lda_two_channels", f"""WITH {LINES}, g AS (SELECT label, avg(x) AS mx, avg(y) AS my, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM c GROUP BY label), w AS (SELECT sum(n * a) AS a, sum(n * b) AS b, sum(n * c) AS c FROM g),
    s AS (SELECT x, y, c.label, g.label AS predicted, w.b * pow(x - mx, 2) - 2 * w.c * (x - mx) * (y - my) + w.a * pow(y - my, 2) AS d FROM (SELECT DISTINCT * FROM c) c, g, w),
    p AS (SELECT x, y, label, arg_min(predicted, d) AS predicted FROM s GROUP BY x, y, label) SELECT label, predicted, count(*) AS n FROM p GROUP BY label, predicted""")
def lda_two_channels(spark, sf):
    """How often distinct points of each class are given to each class: the nearest mean under the pooled covariance."""
    x = lines_of(spark, sf)
    p = multivariate.lda_predict(x, ["x", "y"], multivariate.lda(x, ["x", "y"], "label"))
    return p.select("x", "y", "label", "predicted").distinct().groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query("kmeans_two_blobs", "SELECT i::DOUBLE AS mjd, (i % 2)::INT AS side FROM (SELECT unnest(range(0, 400)) AS i)")
def kmeans_two_blobs(spark, sf):
    """Two clouds far apart; clusters are told by the cloud of their members."""
    i = F.col("id")
    x = spark.range(400).select(i.cast("double").alias("mjd"), (F.when(i % 2 == 0, 0.0).otherwise(50.0) + F.sin(i * 1.3)).alias("a"), (F.when(i % 2 == 0, 0.0).otherwise(-50.0) + F.cos(i * 2.1)).alias("b"))
    k = cluster.kmeans(x, ["a", "b"], 2)
    side = k.groupBy("cluster").agg((F.avg("a") > 25).cast("int").alias("side"))
    return k.join(side, "cluster").select("mjd", "side")


# ---- geodesy -------------------------------------------------------------------------------------------------------

ELLIPSOIDS = {"wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "bessel": (6377397.155, 299.1528128), "krasovsky": (6378245.0, 298.3), "clarke1866": (6378206.4, 294.978698214)}


@query("ellipsoids", f"WITH {POINTS}, e(name, a, rf) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {r}::DOUBLE)" for k, (a, r) in ELLIPSOIDS.items()) + """), n AS (SELECT *, (2 - 1 / rf) / rf AS e2, a / sqrt(1 - (2 - 1 / rf) / rf * pow(sin(radians(lat)), 2)) AS n FROM p, e)
    SELECT c_custkey, name, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round((n * (1 - e2) + h) * sin(radians(lat)), 3) AS z FROM n""")
def ellipsoids(spark, sf):
    c, out = customer_points(spark, sf), None
    for name, e in {"wgs84": geo.WGS84, "grs80": geo.GRS80, "bessel": geo.BESSEL, "krasovsky": geo.KRASOVSKY, "clarke1866": geo.CLARKE1866}.items():
        x, _, z = geo.geod_to_ecef(F.col("lat"), F.col("lon"), F.col("h"), e)
        one = c.select("c_custkey", F.lit(name).alias("name"), x.alias("x"), z.alias("z"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 3, "x", "z")


@query("sphere_and_slant", f"""WITH {POINTS}, x AS (SELECT c_custkey, (6371000 + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (6371000 + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (6371000 + h) * sin(radians(lat)) AS z FROM p)
    SELECT c_custkey, round(sqrt(x * x + y * y + z * z), 4) AS r, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 8) AS lat, round(degrees(atan2(z, sqrt(x * x + y * y))), 7) AS elevation, round(sqrt(x * x + y * y + z * z), 3) AS slant FROM x""")
def sphere_and_slant(spark, sf):
    c = customer_points(spark, sf)
    x, y, z = geo.sphere_to_ecef(F.col("lat"), F.col("lon"), F.col("h") + 6371000.0)
    e = c.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, _, r = geo.ecef_to_sphere(F.col("x"), F.col("y"), F.col("z"))
    _, el, s = geo.enu_to_aes(F.col("x"), F.col("y"), F.col("z"))
    return e.select("c_custkey", (F.round(r, 4) + 0.0).alias("r"), (F.round(lat, 8) + 0.0).alias("lat"), (F.round(el, 7) + 0.0).alias("elevation"), (F.round(s, 3) + 0.0).alias("slant"))


@query("covariance_turned", f"""WITH {POINTS}, r AS (SELECT -sin(radians(15.0)) AS ex, cos(radians(15.0)) AS ey, cos(radians(49.5)) * cos(radians(15.0)) AS ux, cos(radians(49.5)) * sin(radians(15.0)) AS uy, sin(radians(49.5)) AS uz)
    SELECT c_custkey, round((4 + abs(h) / 1000) * ex * ex + 9 * ey * ey + 2 * 0.5 * ex * ey, 4) AS ee, round((4 + abs(h) / 1000) * ux * ux + 9 * uy * uy + 16 * uz * uz + 2 * 0.5 * ux * uy, 4) AS uu FROM p, r""")
def covariance_turned(spark, sf):
    """Covariances of points in the horizon of one origin, by the propagation of Earth-fixed ones."""
    x, y, z = geo.geod_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    row = lambda *v: F.array(*[F.lit(float(k)) if not hasattr(k, "alias") else k for k in v])
    c = customer_points(spark, sf).select("c_custkey", F.array(x, y, z).alias("pos"), F.array(row(4.0 + F.abs("h") / 1000, 0.5, 0.0), row(0.5, 9.0, 0.0), row(0.0, 0.0, 16.0)).alias("cov"))
    t = c.select("c_custkey", geo.transform_with_covariance(F.col("pos"), F.col("cov"), "ecef", "enu", (49.5, 15.0, 300.0)).alias("r"))
    return t.select("c_custkey", (F.round(F.col("r.cov")[0][0], 4) + 0.0).alias("ee"), (F.round(F.col("r.cov")[2][2], 4) + 0.0).alias("uu"))


@query("vincenty_consecutive", f"""WITH RECURSIVE {POINTS}, q AS (SELECT *, lead(lat) OVER (ORDER BY c_custkey) AS lat2, lead(lon) OVER (ORDER BY c_custkey) AS lon2 FROM p),
    u AS (SELECT c_custkey, 1 / 298.257223563 AS f, atan((1 - 1 / 298.257223563) * tan(radians(lat))) AS u1, atan((1 - 1 / 298.257223563) * tan(radians(lat2))) AS u2, radians(lon2 - lon) AS l FROM q WHERE lat2 IS NOT NULL),
    i AS (SELECT c_custkey, f, u1, u2, l, l AS lam, 0 AS k, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS cs, 0.0::DOUBLE AS sg, 0.0::DOUBLE AS c2a, 0.0::DOUBLE AS c2m FROM u
      UNION ALL SELECT c_custkey, f, u1, u2, l, l + (1 - cc) * f * sa * (sg + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))), k + 1, ss, cs, sg, c2a, c2m FROM (
        SELECT *, f / 16 * c2a * (4 + f * (4 - 3 * c2a)) AS cc FROM (SELECT *, CASE WHEN c2a > 0 THEN cs - 2 * sin(u1) * sin(u2) / c2a ELSE 0 END AS c2m FROM (SELECT *, 1 - sa * sa AS c2a FROM (
          SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM (
            SELECT c_custkey, f, u1, u2, l, lam, k, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM i WHERE k < 30))))) t
    ), e AS (SELECT *, c2a * (pow(6378137.0, 2) - pow(6378137.0 * (1 - f), 2)) / pow(6378137.0 * (1 - f), 2) AS kk FROM i WHERE k = 30), b AS (SELECT *, 1 + kk / 16384 * (4096 + kk * (-768 + kk * (320 - 175 * kk))) AS ba, kk / 1024 * (256 + kk * (-128 + kk * (74 - 47 * kk))) AS bb FROM e)
    SELECT c_custkey, round(6378137.0 * (1 - f) * ba * (sg - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))), 3) AS distance FROM b""")
def vincenty_consecutive(spark, sf):
    """The ellipsoidal distance from each point to the next one."""
    n = ordered.with_lead(customer_points(spark, sf), "c_custkey", ["lat", "lon"])
    return n.select("c_custkey", F.round(geo.vincenty_inverse(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))["distance"], 3).alias("distance"))


# ---- satellite navigation ------------------------------------------------------------------------------------------

#: Orbits made from the number of a supplier, as SQL and as columns: half axis, eccentricity, angles; and the time asked for.
ORBIT = """o AS (SELECT s_suppkey AS id, 5153.6 + (s_suppkey % 7) * 0.01 AS sa, 0.001 + (s_suppkey % 11) * 0.001 AS e, (s_suppkey % 60) * 0.1 - 3 AS m0, 0.9 + (s_suppkey % 5) * 0.02 AS i0, (s_suppkey % 50) * 0.12 - 3 AS om0, (s_suppkey % 30) * 0.2 - 3 AS w,
    4.5e-9 AS dn, -8e-9 AS omd, 1e-10 AS idot, 2e-6 AS cuc, -3e-6 AS cus, 200.0 AS crc, -60.0 AS crs, 1e-7 AS cic, -5e-8 AS cis, 345600.0 AS toe, (s_suppkey % 41) * 180.0 - 3600 AS tk FROM supplier)"""


def orbit_records(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    fixed = {"delta_n": 4.5e-9, "omega_dot": -8e-9, "idot": 1e-10, "cuc": 2e-6, "cus": -3e-6, "crc": 200.0, "crs": -60.0, "cic": 1e-7, "cis": -5e-8, "toe": 345600.0, "af0": 0.0, "af1": 0.0, "af2": 0.0, "week": 2295.0}
    own = {"sqrt_a": 5153.6 + (k % 7) * 0.01, "e": 0.001 + (k % 11) * 0.001, "m0": (k % 60) * 0.1 - 3, "i0": 0.9 + (k % 5) * 0.02, "omega0": (k % 50) * 0.12 - 3, "omega": (k % 30) * 0.2 - 3}
    t = F.lit(2295 * 604800.0 + 345600.0)
    return fx.read(spark, sf, "supplier").select(k.alias("id"), F.lit("G01").alias("sat"), F.lit("G").alias("system"), t.alias("toc"), (t + (k % 41) * 180.0 - 3600).alias("t"), *[F.lit(v).alias(n) for n, v in fixed.items()], *[v.cast("double").alias(n) for n, v in own.items()])


@query("broadcast_orbit", "WITH RECURSIVE " + ORBIT + """, k AS (SELECT *, m0 + (sqrt(3.986005e14 / pow(sa, 6)) + dn) * tk AS m, 0 AS n, m0 + (sqrt(3.986005e14 / pow(sa, 6)) + dn) * tk AS ea FROM o UNION ALL SELECT id, sa, e, m0, i0, om0, w, dn, omd, idot, cuc, cus, crc, crs, cic, cis, toe, tk, m, n + 1, m + e * sin(ea) FROM k WHERE n < 25),
    v AS (SELECT *, atan2(sqrt(1 - e * e) * sin(ea), cos(ea) - e) + w AS phi FROM k WHERE n = 25),
    u AS (SELECT *, phi + cus * sin(2 * phi) + cuc * cos(2 * phi) AS u, sa * sa * (1 - e * cos(ea)) + crs * sin(2 * phi) + crc * cos(2 * phi) AS r, i0 + idot * tk + cis * sin(2 * phi) + cic * cos(2 * phi) AS i, om0 + (omd - 7.2921151467e-5) * tk - 7.2921151467e-5 * toe AS om FROM v)
    SELECT id, round(r * cos(u) * cos(om) - r * sin(u) * cos(i) * sin(om), 3) AS x, round(r * cos(u) * sin(om) + r * sin(u) * cos(i) * cos(om), 3) AS y, round(r * sin(u) * sin(i), 3) AS z FROM u""")
def broadcast_orbit(spark, sf):
    o = orbit_records(spark, sf)

    def run(parts):
        import pandas as pd

        for pdf in parts:
            p = [gnss.broadcast_position([r], r["t"])[0] for r in pdf.to_dict("records")]
            yield pd.DataFrame({"id": pdf["id"], **{n: [round(float(v[k]), 3) for v in p] for k, n in enumerate("xyz")}})

    return o.mapInPandas(run, "id bigint, x double, y double, z double")


@query("troposphere_zenith", f"WITH {POINTS} SELECT c_custkey, round(0.0022768 * 1013.25 * pow(1 - 2.2557e-5 * abs(h), 5.2568) / (1 - 0.00266 * cos(2 * radians(lat)) - 2.8e-7 * abs(h)), 8) AS zhd FROM p")
def troposphere_zenith(spark, sf):
    return customer_points(spark, sf).select("c_custkey", F.round(gnss.saastamoinen_col(F.col("lat"), F.abs("h")), 8).alias("zhd"))


@query("orbit_file", """SELECT id AS sat, t, round((1000 + 10 * id + 2 * k - 0.05 * k * k) * 1e3, 1) AS x, round((2000 - id + 0.4 * k) * 1e3, 1) AS y, round((-3000 + 0.01 * k * k * k) * 1e3, 1) AS z, round((id * 10 + 0.5 * k) * 1e-6, 10) AS clock
    FROM (SELECT i, 'G0' || i AS sat, i AS id, k, 1388102400.0 + 900 * k AS t FROM (SELECT unnest([1, 2, 3]) AS i) CROSS JOIN (SELECT unnest(range(0, 40)) AS k)) o""".replace("SELECT id AS sat,", "SELECT sat,"))
def orbit_file(spark, sf):
    """Positions that follow polynomials, as an orbit file, and read back."""
    return rounded(rounded(files.read_sp3(spark, f"{sp3_file(spark)}/part-*").select("sat", "t", "x", "y", "z", "clock"), 1, "x", "y", "z"), 10, "clock")


def sp3_file(spark) -> str:
    """An epoch each 900 seconds from 2024-01-01 (GPS second 1388102400), three satellites."""
    k, i = F.col("k").cast("double"), F.col("i").cast("double")
    num = lambda v: F.lpad(F.format_string("%.6f", v), 14, " ")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 900)
    epochs = spark.range(40).withColumnRenamed("id", "k")
    heads = epochs.select((k * 10).alias("n"), F.concat(F.lit("*  "), F.date_format(at, "yyyy  M  d  H  m"), F.lit("  0.00000000")).alias("line"))
    rows = epochs.crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "i"))).select((k * 10 + i).alias("n"), F.concat(F.lit("PG0"), F.col("i").cast("string"), num(1000 + 10 * i + 2 * k - 0.05 * k * k), num(2000 - i + 0.4 * k), num(-3000 + 0.01 * k * k * k), num(i * 10 + 0.5 * k)).alias("line"))
    return file_of(heads.unionByName(rows), "sp3")


@query("precise_orbit", """SELECT 'G0' || i AS sat, 1388102400.0 + 900 * k AS t, round(x * cos(w) + y * sin(w), 2) AS sx, round(-x * sin(w) + y * cos(w), 2) AS sy, round((-3000 + 0.01 * pow(u, 3)) * 1e3, 2) AS sz
    FROM (SELECT i, k, u, (1000 + 10 * i + 2 * u - 0.05 * u * u) * 1e3 AS x, (2000 - i + 0.4 * u) * 1e3 AS y, 7.2921151467e-5 * 2.1e7 / 299792458.0 AS w
      FROM (SELECT i, k, k - 2.1e7 / 299792458.0 / 900 AS u FROM (SELECT unnest([1, 2, 3]) AS i) CROSS JOIN (SELECT unnest([5.5, 10.25, 17.75, 30.1]) AS k)))""")
def precise_orbit(spark, sf):
    """Places at transmission, between the epochs of the file, by interpolation."""
    asked = spark.createDataFrame([(f"G0{i}", 1388102400.0 + 900 * k, 2.1e7) for i in (1, 2, 3) for k in (5.5, 10.25, 17.75, 30.1)], "sat string, t double, code double")
    p = gnss.transmitted(asked, files.read_sp3(spark, f"{sp3_file(spark)}/part-*"))
    return rounded(p.select("sat", "t", "sx", "sy", "sz"), 2, "sx", "sy", "sz")


# ---- answers known beforehand --------------------------------------------------------------------------------------


@query("ssa_known", "SELECT 'made' AS station_id, 'x' AS component, 60000.0 + i AS mjd, round(3 * sin(i * 0.31) + 0.5 * cos(i * 0.83), 5) AS value FROM (SELECT unnest(range(0, 160)) AS i)")
def ssa_known(spark, sf):
    """Two oscillations are four components; those together are the series."""
    x = known_series(spark, 160, lambda i: 3 * F.sin(i * 0.31) + 0.5 * F.cos(i * 0.83))
    p = models.ssa(x, 40, 4).where("grp >= 0")
    return p.groupBy(*KEY, "mjd").agg((F.round(F.sum("part"), 5) + 0.0).alias("value"))


@query("return_level_known", """SELECT period, round(CASE WHEN xi = 0 THEN 10 - 2 * ln(-ln(1 - 1 / period)) ELSE 10 + 2 / xi * (pow(-ln(1 - 1 / period), -xi) - 1) END, 8) AS gev, round(5 + 1.5 / xg * (pow(20 * period, xg) - 1), 8) AS gpd
    FROM (SELECT unnest([2.0, 10.0, 50.0, 100.0]) AS period, 0.1 AS xi, 0.2 AS xg)""")
def return_level_known(spark, sf):
    rows = [(p, round(float(extremes.gev_level(10.0, 2.0, 0.1, p)), 8), round(float(extremes.gpd_level(5.0, 0.2, 1.5, 20.0, p)), 8)) for p in (2.0, 10.0, 50.0, 100.0)]
    return spark.createDataFrame(rows, "period double, gev double, gpd double")


def known_plane(spark, sf) -> DataFrame:
    """The suppliers' places with a value that is a plane over them; of equal places one."""
    return plane(spark, sf).select("x", "y", (2 + 0.5 * F.col("x") - 0.25 * F.col("y")).alias("value")).distinct()


for _method, _digits, _kw in (("bspline_surface", 4, {"nx": 5, "ny": 5}), ("natural_neighbor", 4, {}), ("kriging", 3, {"kind": "universal"})):

    @query(f"plane_by_{_method}", f"SELECT (30 + 5 * (i % 6))::DOUBLE AS x, (30 + 5 * (i // 6))::DOUBLE AS y, round(2 + 0.5 * (30 + 5 * (i % 6)) - 0.25 * (30 + 5 * (i // 6)), {_digits}) AS value FROM (SELECT unnest(range(0, 36)) AS i)")
    def _by_method(spark, sf, method=_method, digits=_digits, kw=_kw):
        """A plane over scattered points comes out as it is."""
        return rounded(spatial.interpolate(known_plane(spark, sf), spatial.grid(spark, 30.0, 55.0, 30.0, 55.0, 5.0), method, **kw).select("x", "y", "value"), digits, "value")


@query("bilinear_known", "SELECT a AS x, b AS y, round(1 + 2 * a - 3 * b + 0.5 * a * b, 6) AS value FROM (SELECT unnest([0.25, 1.5, 2.75]) AS a) CROSS JOIN (SELECT unnest([0.5, 1.75, 3.0]) AS b)")
def bilinear_known(spark, sf):
    import numpy as np

    y, x = np.mgrid[0:5, 0:5].astype(float)
    model = spatial.bilinear(1 + 2 * x - 3 * y + 0.5 * x * y, 0.0, 0.0, 1.0)
    cells = spark.createDataFrame([(a, b) for a in (0.25, 1.5, 2.75) for b in (0.5, 1.75, 3.0)], "x double, y double")
    return rounded(spatial.evaluate(cells, model, ["value"]), 6, "value")


@query("stream_ema")
def stream_ema(spark, sf):
    """The exponential mean of a stream, drained into files, equals that of the batch."""
    x = fx.events_hourly(spark, sf)
    at, to = scratch(spark, "stream_in"), scratch(spark, "stream_out")
    x.write.parquet(at)
    s = online.ema(spark.readStream.schema(x.schema).parquet(at), 0.31415)
    s.writeStream.format("parquet").option("path", to).option("checkpointLocation", scratch(spark, "stream_state")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(s.schema).parquet(to).select(*KEY, "mjd", "filtered"), 5, "filtered")


ORACLES["stream_ema"] = "WITH RECURSIVE " + SQL_EVENTS + f""", y AS (SELECT {K}, mjd, value, row_number() OVER ({WO}) AS i FROM events_hourly),
    r AS (SELECT {K}, mjd, i, value AS s FROM y WHERE i = 1 UNION ALL SELECT y.station_id, y.component, y.mjd, y.i, 0.31415 * y.value + (1 - 0.31415) * r.s FROM r JOIN y ON y.i = r.i + 1 AND y.component = r.component)
    SELECT {K}, mjd, round(s, 5) AS filtered FROM r"""


@query("stream_windows", "SELECT event_type AS component, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Windowed quality control, run over the table as a batch; late rows are those of a stream alone."""
    e = fx.read(spark, sf, "events").select(F.lit("e").alias("station_id"), F.col("event_type").alias("component"), F.col("ts").cast("timestamp").alias("t"), "value")
    w = online.windowed_qc(e, "1 hour", "1 day")
    return w.select("component", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "max")


@query("window_advice", "SELECT 'made' AS station_id, 'x' AS component, 25 AS window")
def window_advice(spark, sf):
    """The first peak of the autocorrelation of a daily cycle, as an odd window."""
    return filters.window_advice(known_series(spark, 480, lambda i: F.sin(i * 2 * 3.141592653589793 / 24), 1 / 24), "acf_peak").select(*KEY, "window")


# ---- tests, fits and smoothers in closed form ----------------------------------------------------------------------


@query("partial_autocorrelation", _with(SQL_EVENTS) + f""", x AS (SELECT {K}, mjd, value - avg(value) OVER ({W}) AS c FROM events_hourly), l AS (SELECT *, lag(c, 1) OVER ({WO}) AS l1, lag(c, 2) OVER ({WO}) AS l2 FROM x),
    r AS (SELECT {K}, sum(c * l1) / sum(c * c) AS r1, sum(c * l2) / sum(c * c) AS r2 FROM l GROUP BY {K}) SELECT {K}, round(r1, 8) AS pacf1, round((r2 - r1 * r1) / (1 - r1 * r1), 8) AS pacf2 FROM r""")
def partial_autocorrelation(spark, sf):
    d = hypothesis.dependence(fx.events_hourly(spark, sf), 3)
    return d.select(*KEY, (F.round(F.col("pacf")[1], 8) + 0.0).alias("pacf1"), (F.round(F.col("pacf")[2], 8) + 0.0).alias("pacf2"))


@query("kolmogorov_distance", _with(SQL_EVENTS) + f""", z AS (SELECT {K}, (value - avg(value) OVER ({W})) / stddev_samp(value) OVER ({W}) AS z, row_number() OVER ({W} ORDER BY value) AS i, count(*) OVER ({W}) AS n FROM events_hourly),
    f AS (SELECT {K}, i, n, 0.5 + sum((CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * k / 200, 2) / 2)) * z / 600 / sqrt(2 * pi()) AS f FROM z CROSS JOIN (SELECT unnest(range(0, 201)) AS k) GROUP BY {K}, i, n, z)
    SELECT {K}, round(max(greatest(i / n::DOUBLE - f, f - (i - 1) / n::DOUBLE)), 6) AS d FROM f GROUP BY {K}""")
def kolmogorov_distance(spark, sf):
    return hypothesis.normality(fx.events_hourly(spark, sf), "kolmogorov_smirnov").select(*KEY, F.round("statistic", 6).alias("d"))


@query("critical_values", "SELECT n, round(-2.8621 - 2.738 / n - 8.36 / (n * n), 8) AS adf, round(-3.4335 - 5.999 / n - 29.25 / (n * n), 8) AS adf01, 0.463::DOUBLE AS kpss, 0.146::DOUBLE AS kpss_trend FROM (SELECT unnest([25.0, 100.0, 1000.0]) AS n)")
def critical_values(spark, sf):
    rows = [(n, round(dist.adf_critical(int(n)), 8), round(dist.adf_critical(int(n), alpha=0.01), 8), dist.kpss_critical(), dist.kpss_critical("trend")) for n in (25.0, 100.0, 1000.0)]
    return spark.createDataFrame(rows, "n double, adf double, adf01 double, kpss double, kpss_trend double")


@query("calendar_fields", "SELECT event_id, dayofyear(ts)::INT AS doy, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def calendar_fields(spark, sf):
    t = F.col("ts").cast("timestamp")
    return fx.read(spark, sf, "events").select("event_id", F.dayofyear(t).alias("doy"), F.substring(tf.calendar_text(t), 1, 19).alias("utc"))


@query("welch_sums", _with(SQL_EVENTS) + f""", x AS (SELECT {K}, row_number() OVER ({WO}) - 1 AS j, count(*) OVER ({W}) AS n, value FROM events_hourly), s AS (SELECT x.*, p, j - 64 * p AS i FROM x CROSS JOIN (SELECT unnest(range(0, 40)) AS p) WHERE j >= 64 * p AND j < 64 * p + 128 AND 64 * p + 128 <= n),
    c AS (SELECT *, value - avg(value) OVER ({W}, p) AS c FROM s), f AS (SELECT {K}, p, k, sum(c * cos(2 * pi() * k * i / 128)) AS a, sum(c * sin(2 * pi() * k * i / 128)) AS b FROM c CROSS JOIN (SELECT unnest(range(1, 64)) AS k) GROUP BY {K}, p, k)
    SELECT {K}, k, round(avg(2 * (a * a + b * b) / 24 / 128), 5) AS psd FROM f GROUP BY {K}, k""")
def welch_sums(spark, sf):
    p = models.spectrum(fx.events_hourly(spark, sf), "welch", segment=128, window="rectangular")
    w = Window.partitionBy(*KEY).orderBy("frequency")
    return p.withColumn("k", (F.row_number().over(w) - 1).cast("bigint")).where("k between 1 and 63").select(*KEY, "k", (F.round("psd", 5) + 0.0).alias("psd"))


@query("stft_sums", _with(SQL_EVENTS) + f""", x AS (SELECT {K}, row_number() OVER ({WO}) - 1 AS j, count(*) OVER ({W}) AS n, mjd, value FROM events_hourly), s AS (SELECT x.*, p, j - 128 * p AS i FROM x CROSS JOIN (SELECT unnest(range(0, 20)) AS p) WHERE j >= 128 * p AND j < 128 * p + 256 AND 128 * p + 256 <= n),
    c AS (SELECT *, (value - avg(value) OVER ({W}, p)) * (0.5 - 0.5 * cos(2 * pi() * i / 255)) AS c, pow(0.5 - 0.5 * cos(2 * pi() * i / 255), 2) AS w FROM s),
    f AS (SELECT {K}, p, k, avg(mjd) AS mid, sum(w) AS w, sum(c * cos(2 * pi() * k * i / 256)) AS a, sum(c * sin(2 * pi() * k * i / 256)) AS b FROM c CROSS JOIN (SELECT unnest(range(1, 33)) AS k) GROUP BY {K}, p, k)
    SELECT {K}, round(mid, 6) AS mid, k, round(2 * (a * a + b * b) / 24 / w, 5) AS psd FROM f""")
def stft_sums(spark, sf):
    p = models.spectrogram(fx.events_hourly(spark, sf), 256, 0.5)
    w = Window.partitionBy(*KEY, "mid").orderBy("frequency")
    return p.withColumn("k", (F.row_number().over(w) - 1).cast("bigint")).where("k between 1 and 32").select(*KEY, F.round("mid", 6).alias("mid"), "k", (F.round("psd", 5) + 0.0).alias("psd"))


LEVEL = SQL_EVENTS + f""", y AS (SELECT {K}, mjd, value, row_number() OVER ({WO}) AS i FROM events_hourly),
    r AS (SELECT {K}, mjd, i, value AS y, 20.1::DOUBLE AS pp, value AS xp, 20.1 * 2.0::DOUBLE / 22.1 AS p, value AS x FROM y WHERE i = 1
      UNION ALL SELECT y.station_id, y.component, y.mjd, y.i, y.value, r.p + 0.1, r.x, (r.p + 0.1) * 2.0 / (r.p + 0.1 + 2.0), r.x + (r.p + 0.1) / (r.p + 0.1 + 2.0) * (y.value - r.x) FROM r JOIN y ON y.i = r.i + 1 AND y.component = r.component)"""


@query("kalman_likelihood", "WITH RECURSIVE " + LEVEL + f" SELECT {K}, round(sum(-0.5 * (ln(2 * pi() * (pp + 2)) + pow(y - xp, 2) / (pp + 2))), 4) AS loglik FROM r GROUP BY {K}")
def kalman_likelihood(spark, sf):
    k = models.kalman(fx.events_hourly(spark, sf), "local_level", "manual", 0.1, 2.0)
    return k.groupBy(*KEY).agg((F.round(F.first("loglik"), 4) + 0.0).alias("loglik"))


@query("smoother_recursion", "WITH RECURSIVE " + LEVEL + f""", n AS (SELECT component AS c, max(i) AS n FROM r GROUP BY 1),
    s AS (SELECT {K}, mjd, i, x AS s, pp FROM r JOIN n ON c = component AND i = n UNION ALL SELECT r.station_id, r.component, r.mjd, r.i, r.x + r.p / (r.p + 0.1) * (s.s - r.x), r.pp FROM s JOIN r ON r.i = s.i - 1 AND r.component = s.component)
    SELECT {K}, mjd, round(s, 5) AS smoothed FROM s""")
def smoother_recursion(spark, sf):
    return rounded(models.kalman(fx.events_hourly(spark, sf), "local_level", "manual", 0.1, 2.0).select(*KEY, "mjd", "smoothed"), 5, "smoothed")


@query("autoregression_fit", _with(SQL_EVENTS) + f""", x AS (SELECT {K}, mjd, value - avg(value) OVER ({W}) AS c FROM events_hourly), l AS (SELECT *, lag(c) OVER ({WO}) AS l FROM x), a AS (SELECT {K}, sum(c * l) / sum(l * l) AS a FROM l WHERE l IS NOT NULL GROUP BY {K})
    SELECT l.station_id, l.component, round(any_value(a), 7) AS ar1, round(avg(pow(c - a * l, 2)), 6) AS sigma2 FROM l JOIN a ON a.component = l.component WHERE l IS NOT NULL GROUP BY 1, 2""")
def autoregression_fit(spark, sf):
    def run(t, x):
        f = models.arima_fit(x, 1, 0)
        return {"ar1": f["ar"][0], "sigma2": f["sigma2"]}

    f = reduce_series(fx.events_hourly(spark, sf), run, "ar1 double, sigma2 double")
    return f.select(*KEY, (F.round("ar1", 7) + 0.0).alias("ar1"), F.round("sigma2", 6).alias("sigma2"))


@query("line_with_errors", _with(SQL_ORDERS) + f""", x AS (SELECT {K}, mjd - min(mjd) OVER ({W}) AS x, value FROM orders_daily), m AS (SELECT {K}, count(*) AS n, avg(x) AS mx, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM x GROUP BY {K}),
    e AS (SELECT m.*, sum(pow(value - a - b * x, 2)) / (any_value(n) - 2) AS s2 FROM x JOIN m USING (station_id, component) GROUP BY ALL) SELECT {K}, round(sqrt(s2), 2) AS sigma0, round(sqrt(s2 / sxx), 5) AS se_slope, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 2) AS se_intercept FROM e""")
def line_with_errors(spark, sf):
    f = regression.fit(fx.orders_daily(spark, sf), "linear")
    return f.select(*KEY, F.round("sigma0", 2).alias("sigma0"), F.round(F.col("std_errors")[1], 5).alias("se_slope"), F.round(F.col("std_errors")[0], 2).alias("se_intercept"))


@query("trend_known", "SELECT 'made' AS station_id, 'x' AS component, 7.0::DOUBLE AS a0, 0.02::DOUBLE AS a1, 3.0::DOUBLE AS sin1, -1.5::DOUBLE AS cos1")
def trend_known(spark, sf):
    x = known_series(spark, 800, lambda i: 7 + 0.02 * i + 3 * F.sin(i * (2 * 3.141592653589793 / 365.25)) - 1.5 * F.cos(i * (2 * 3.141592653589793 / 365.25)))
    c = F.col("coefficients")
    return regression.fit(x, "trend", period=365.25).select(*KEY, *[(F.round(c[i], 6) + 0.0).alias(n) for i, n in enumerate(("a0", "a1", "sin1", "cos1"))])


@query("bspline_known", "SELECT 'made' AS station_id, 'x' AS component, 60000.0 + i AS mjd, round(1 + 0.5 * i - 0.02 * i * i + 0.0003 * pow(i, 3), 6) AS fitted FROM (SELECT unnest(range(0, 80)) AS i)")
def bspline_known(spark, sf):
    """A cubic is in the space of cubic splines."""
    return rounded(splines.fit(known_series(spark, 80, lambda i: 1 + 0.5 * i - 0.02 * i * i + 0.0003 * i * i * i), 12).select(*KEY, "mjd", "fitted"), 6, "fitted")


@query("kriging_series_known", "SELECT 'made' AS station_id, 'x' AS component, unnest([60010.5, 60033.25])::DOUBLE AS mjd, unnest([26.0, 71.5])::DOUBLE AS value")
def kriging_series_known(spark, sf):
    """Universal kriging gives a line back."""
    k = spatial.krige_series(known_series(spark, 60, lambda i: 5 + 2 * i), [60010.5, 60033.25], "universal")
    return rounded(k.where("not is_observed").select(*KEY, "mjd", "value"), 3, "value")


@query("idw_left_out", """WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y, s_acctbal AS v FROM supplier WHERE s_suppkey <= 90),
    d AS (SELECT a.id, a.v, b.v AS w, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d FROM p a JOIN p b ON a.id <> b.id) SELECT id, round(sum(w / d) / sum(1 / d) - any_value(v), 4) AS error FROM d GROUP BY id""")
def idw_left_out(spark, sf):
    """Leave-one-out errors of the first ninety suppliers, whose places differ."""
    p = plane(spark, sf, "s_suppkey").where("s_suppkey <= 90").orderBy("s_suppkey").toPandas()
    e = spatial.loo(p[["x", "y", "value"]].to_numpy(float), spatial.idw_model)
    return spark.createDataFrame([(int(i), round(float(v), 4)) for i, v in zip(p["s_suppkey"], e, strict=True)], "id bigint, error double")


@query("envelope_quantiles", _with(SQL_ORDERS) + """, s AS (SELECT mjd::BIGINT % 30 AS seq, value FROM orders_daily) SELECT seq, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.95), 4) AS p95 FROM s GROUP BY seq""")
def envelope_quantiles(spark, sf):
    return rounded(resample.envelope(fx.orders_daily(spark, sf).select((F.col("mjd").cast("bigint") % 30).alias("seq"), "value")), 4, "p05", "p25", "p50", "p75", "p95")


@query("minimum_known", "SELECT 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, true AS found")
def minimum_known(spark, sf):
    """The simplex search in a narrow valley."""
    p, v, done = numeric.nelder_mead(lambda q: (1 - q[0]) ** 2 + 100 * (q[1] - q[0] ** 2) ** 2, [-1.2, 1.0], rounds=5000)
    return spark.createDataFrame([(round(float(p[0]), 3), round(float(p[1]), 3), bool(v < 1e-6))], "x double, y double, found boolean")


@query("singular_values", f"""WITH {LINES}, m AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM c) SELECT round(sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)), 4) AS s1, round(sqrt((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)), 4) AS s2 FROM m""")
def singular_values(spark, sf):
    """Of a tall table: from the triangle of its sums of products, which has the same ones."""
    import numpy as np

    g = lines_of(spark, sf).agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))).first()
    s = numeric.Svd(np.linalg.cholesky(np.array([[g[0], g[1]], [g[1], g[2]]])).T).s
    return spark.createDataFrame([(round(float(s[0]), 4), round(float(s[1]), 4))], "s1 double, s2 double")


# ---- navigation files and corrections ------------------------------------------------------------------------------


@query("ionosphere_delay", f"""WITH {POINTS}, a AS (SELECT c_custkey, lat, lon, (c_custkey % 36) * 10.0 AS az, 15.0 + c_custkey % 70 AS el, (c_custkey % 24) * 3600.0 AS t FROM p),
    b AS (SELECT *, 0.0137 / (el / 180 + 0.11) - 0.022 AS psi FROM a), c AS (SELECT *, greatest(-0.416, least(0.416, lat / 180 + psi * cos(radians(az)))) AS phi FROM b), d AS (SELECT *, lon / 180 + psi * sin(radians(az)) / cos(phi * pi()) AS lam FROM c),
    e AS (SELECT *, phi + 0.064 * cos((lam - 1.617) * pi()) AS pm, (43200 * lam + t) - 86400 * floor((43200 * lam + t) / 86400) AS tt FROM d),
    f AS (SELECT *, greatest(0, 1.2e-8 + 1.5e-8 * pm - 6e-8 * pm * pm - 6e-8 * pow(pm, 3)) AS amp, 2 * pi() * (tt - 50400) / greatest(72000, 9e4 + 9.8e4 * pm - 6.5e4 * pm * pm - 2e5 * pow(pm, 3)) AS x FROM e)
    SELECT c_custkey, round(299792458.0 * (1 + 16 * pow(0.53 - el / 180, 3)) * (5e-9 + CASE WHEN abs(x) < 1.57 THEN amp * (1 - x * x / 2 + pow(x, 4) / 24) ELSE 0 END), 6) AS delay FROM f""")
def ionosphere_delay(spark, sf):
    k = F.col("c_custkey")
    a = customer_points(spark, sf).select("c_custkey", "lat", "lon", ((k % 36) * 10.0).alias("az"), (15.0 + k % 70).alias("el"), ((k % 24) * 3600.0).alias("t"))

    def run(parts):
        import pandas as pd

        for pdf in parts:
            d = [gnss.klobuchar(r.lat, r.lon, r.az, r.el, r.t, [1.2e-8, 1.5e-8, -6e-8, -6e-8], [9e4, 9.8e4, -6.5e4, -2e5]) for r in pdf.itertuples()]
            yield pd.DataFrame({"c_custkey": pdf["c_custkey"], "delay": [round(v, 6) for v in d]})

    return a.mapInPandas(run, "c_custkey bigint, delay double")


@query("navigation_file", "SELECT printf('G%02d', i) AS sat, 'G' AS system, 1388102400.0 + 7200 * i AS toc, i * 1e-5 AS af0, 5153.0 + i * 0.25 AS sqrt_a, 0.001 * i AS e, 100.0 * i AS toe, 2295.0 + i AS week FROM (SELECT unnest(range(1, 11)) AS i)")
def navigation_file(spark, sf):
    """Ten navigation records of version 3, written in fixed columns and read back."""
    i = F.col("id").cast("double")
    num = lambda v: F.regexp_replace(F.format_string("%19.12e", v if not isinstance(v, (int, float)) else F.lit(float(v))), "e", "D")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200)
    r = spark.range(1, 11)
    line = lambda k, *vals: r.select((i * 10 + k).alias("n"), F.concat(F.lit("    "), *[num(v) for v in vals]).alias("line"))
    head = r.select((i * 10).alias("n"), F.concat(F.format_string("G%02d ", F.col("id")), F.date_format(at, "yyyy MM dd HH mm ss"), num(i * 1e-5), num(0), num(0)).alias("line"))
    rows = [head, line(1, 1, 2, 3, 0.5), line(2, 0, i * 0.001, 0, 5153 + i * 0.25), line(3, i * 100, 0, 1, 0), line(4, 0.95, 200, 0.3, -8e-9), line(5, 0, 1, i + 2295, 0), line(6, 2, 0, 1e-8, 1), line(7, 0, 4, 0, 0)]
    out = spark.createDataFrame([(-2.0, "     3.04           N: GNSS NAV DATA    G: GPS              RINEX VERSION / TYPE"), (-1.0, " " * 60 + "END OF HEADER")], "n double, line string")
    for x in rows:
        out = out.unionByName(x)
    return files.read_nav(spark, f"{file_of(out, 'nav')}/part-*").select("sat", "system", "toc", "af0", "sqrt_a", "e", "toe", "week")


@query("observation_file", "SELECT 1388102400.0 + 30 * k AS t, printf('G%02d', s) AS sat, round(2.0e7 + 1000 * s + k, 3) AS c1c, round(1.05e8 + s + 10 * k, 3) AS l1c FROM (SELECT unnest(range(0, 20)) AS k) CROSS JOIN (SELECT unnest([3, 7, 21]) AS s)")
def observation_file(spark, sf):
    k = F.col("id").cast("double")
    e = spark.range(20)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 30)
    out = spark.createDataFrame([(-2.0, "G    2 C1C L1C" + " " * 46 + "SYS / # / OBS TYPES"), (-1.0, " " * 60 + "END OF HEADER")], "n double, line string")
    out = out.unionByName(e.select((k * 10).alias("n"), F.concat(F.lit("> "), F.date_format(at, "yyyy MM dd HH mm ss"), F.lit(".0000000  0  3")).alias("line")))
    for j, s in enumerate((3, 7, 21)):
        out = out.unionByName(e.select((k * 10 + 1 + j).alias("n"), F.concat(F.lit(f"G{s:02d}"), F.format_string("%14.3f  ", 2.0e7 + 1000 * s + k), F.format_string("%14.3f  ", 1.05e8 + s + 10 * k)).alias("line")))
    o = files.read_obs(spark, f"{file_of(out, 'obs')}/part-*")
    return o.select("t", "sat", F.col("obs")["C1C"].alias("c1c"), F.col("obs")["L1C"].alias("l1c"))


@query("clock_and_bias_files", "SELECT 'clock' AS kind, printf('G%02d', i) AS name, i * 1e-6 AS value FROM (SELECT unnest(range(1, 6)) AS i) UNION ALL SELECT 'bias', printf('G%02d', i), i * 0.5 FROM (SELECT unnest(range(1, 6)) AS i)")
def clock_and_bias_files(spark, sf):
    i = F.col("id").cast("double")
    r = spark.range(1, 6)
    clk = r.select(i.alias("n"), F.format_string("AS G%02d  2024 01 01 00 00  0.000000  2   %.12e  1.0e-11", F.col("id"), i * 1e-6).alias("line"))
    osb = r.select(i.alias("n"), F.format_string(" OSB  G%03d G%02d           C1C       2024:001:00000 2024:002:00000 ns   %.4f  0.0100", F.col("id"), F.col("id"), i * 0.5).alias("line"))
    c = files.read_clk(spark, f"{file_of(clk, 'clk')}/part-*").select(F.lit("clock").alias("kind"), "name", F.col("bias").alias("value"))
    return c.unionByName(files.read_osb(spark, f"{file_of(osb, 'osb')}/part-*").select(F.lit("bias").alias("kind"), F.col("sat").alias("name"), F.col("bias").alias("value")))


@query("antenna_file", "SELECT printf('G%02d', i) AS serial, 'G01' AS frequency, round(i * 0.001, 6) AS north, round(2.5 + i * 0.01, 6) AS up, 3 AS n FROM (SELECT unnest(range(1, 6)) AS i)")
def antenna_file(spark, sf):
    i = F.col("id").cast("double")
    r = spark.range(1, 6)
    tag = lambda body, name: F.concat(F.rpad(body if hasattr(body, "alias") else F.lit(body), 60, " "), F.lit(name))
    lines = [
        tag("", "START OF ANTENNA"), tag(F.concat(F.rpad(F.lit("BLOCK IIF"), 20, " "), F.format_string("G%02d", F.col("id"))), "TYPE / SERIAL NO"), tag("     0.0  10.0   5.0", "ZEN1 / ZEN2 / DZEN"), tag("   G01", "START OF FREQUENCY"),
        tag(F.format_string("%10.2f%10.2f%10.2f", i, F.lit(0.0), 2500 + i * 10), "NORTH / EAST / UP"), F.lit("   NOAZI    1.00    2.00    3.00"), tag("   G01", "END OF FREQUENCY"), tag("", "END OF ANTENNA"),
    ]
    out = None
    for k, l in enumerate(lines):
        one = r.select((i * 10 + k).alias("n"), l.alias("line"))
        out = one if out is None else out.unionByName(one)
    a = files.read_antex(spark, f"{file_of(out, 'atx')}/part-*")
    return a.select("serial", "frequency", F.round(F.col("offset")[0], 6).alias("north"), F.round(F.col("offset")[2], 6).alias("up"), F.size("variation").alias("n"))


# ---- resampling, factors, channels ---------------------------------------------------------------------------------


@query("bootstrap_intervals", _with(SQL_ORDERS) + ", v AS (SELECT value / 1000 AS v FROM orders_daily WHERE mjd < 50000), m AS (SELECT avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS s FROM v) SELECT unnest(['percentile', 'bca', 'block']) AS method, round(m, 6) AS estimate, true AS inside, true AS near_normal FROM m")
def bootstrap_intervals(spark, sf):
    """Intervals of a mean hold it, and are about as wide as 1.96 standard errors to either side."""
    import numpy as np

    x = np.array([r.v for r in fx.orders_daily(spark, sf).where("mjd < 50000").orderBy("mjd").select((F.col("value") / 1000).alias("v")).collect()])
    se = x.std(ddof=1) / np.sqrt(len(x))
    rows = []
    for m in ("percentile", "bca", "block"):
        c = resample.confidence(spark, x, np.mean, m, 400)
        rows.append((m, round(c["estimate"], 6), bool(c["lower"] < c["estimate"] < c["upper"]), bool(0.6 < (c["upper"] - c["lower"]) / (3.92 * se) < 1.6)))
    return spark.createDataFrame(rows, "method string, estimate double, inside boolean, near_normal boolean")


@query("permutation_tests", "SELECT unnest(['one_sample', 'two_sample', 'correlation']) AS kind, unnest([0.5, 1.0, 1.0])::DOUBLE AS statistic, true AS rejected")
def permutation_tests(spark, sf):
    """A mean half a unit off, two samples one apart, and a line: all are rejected, with the statistic that they have."""
    import numpy as np

    x = np.sin(np.arange(60) * 2.399)
    x -= x.mean()
    tests = (("one_sample", (x + 0.5,)), ("two_sample", (x, x + 1.0)), ("correlation", (x, 2 * x + 1)))
    out = []
    for kind, args in tests:
        r = resample.permutation_test(spark, kind, *args, n=199)
        out.append((kind, round(r["statistic"], 8), bool(r["p_value"] <= 0.05)))
    return spark.createDataFrame(out, "kind string, statistic double, rejected boolean")


@query("mssa_known", "SELECT i::DOUBLE AS mjd, unnest(['u', 'v']) AS channel, round(unnest([2 * sin(i * 2 * pi() / 20), 3 * cos(i * 2 * pi() / 20)]), 4) AS value FROM (SELECT unnest(range(0, 120)) AS i)")
def mssa_known(spark, sf):
    """One oscillation in two channels is two components."""
    i = F.col("id").cast("double")
    x = spark.range(120).select(i.alias("mjd"), (2 * F.sin(i * (2 * 3.141592653589793 / 20))).alias("u"), (3 * F.cos(i * (2 * 3.141592653589793 / 20))).alias("v"))
    m = multivariate.analyze(x, "mssa", ["u", "v"], window=40, rank=2)
    return m.groupBy("mjd", "channel").agg((F.round(F.sum("part"), 4) + 0.0).alias("value"))


@query("one_factor", """WITH x AS (SELECT sin(i * 2.399) AS f, i FROM (SELECT unnest(range(0, 500)) AS i)), c AS (SELECT f + 0.3 * cos(i * 5.1) AS a, 2 * f + 0.4 * cos(i * 3.7) AS b, -f + 0.2 * cos(i * 1.9) AS c FROM x), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM c)
    SELECT unnest(['a', 'b', 'c']) AS channel, round(unnest([ab * ac / bc, ab * bc / ac, ac * bc / ab]), 3) AS communality FROM r""")
def one_factor(spark, sf):
    """Three channels of one factor: communalities follow from the three correlations."""
    i = F.col("id").cast("double")
    f = F.sin(i * 2.399)
    x = spark.range(500).select((f + 0.3 * F.cos(i * 5.1)).alias("a"), (2 * f + 0.4 * F.cos(i * 3.7)).alias("b"), (-f + 0.2 * F.cos(i * 1.9)).alias("c"))
    h = multivariate.analyze(x, "factor_analysis", ["a", "b", "c"], factors=1, rounds=2000, tol=1e-9)["communalities"]
    return spark.createDataFrame([(c, round(float(v), 3)) for c, v in zip("abc", h, strict=True)], "channel string, communality double")


@query("simulated_envelope", "SELECT 200::BIGINT AS n, true AS ordered, true AS widens")
def simulated_envelope(spark, sf):
    """Random walks of a local level: quantiles are in order and spread with time."""
    s = resample.simulate(spark, 60, lambda seed: resample.simulate_kalman(200, "local_level", 0.5, 0.1, seed))
    e = resample.envelope(s)
    late, early = F.avg(F.when(F.col("seq") >= 150, F.col("p95") - F.col("p05"))), F.avg(F.when(F.col("seq") < 20, F.col("p95") - F.col("p05")))
    return e.agg(F.count("*").alias("n"), F.min((F.col("p05") <= F.col("p25")) & (F.col("p25") <= F.col("p50")) & (F.col("p50") <= F.col("p75")) & (F.col("p75") <= F.col("p95"))).alias("ordered"), (late > early).alias("widens"))


@query("local_regression", _with(SQL_ORDERS) + f""", i AS (SELECT {K}, mjd, value, row_number() OVER ({WO}) - 1 AS i, count(*) OVER ({W}) AS n FROM orders_daily), k AS (SELECT *, CAST(ceil(0.01 * n) AS BIGINT) AS k, least(greatest(0, i - (CAST(ceil(0.01 * n) AS BIGINT) - 1) // 2), n - CAST(ceil(0.01 * n) AS BIGINT)) AS lo FROM i),
    j AS (SELECT a.*, b.value AS y, (b.i - a.i)::DOUBLE AS d, pow(1 - pow(least(abs(b.i - a.i)::DOUBLE / greatest(a.i - a.lo, a.lo + a.k - 1 - a.i), 1), 3), 3) AS w FROM k a JOIN i b ON b.i BETWEEN a.lo AND a.lo + a.k - 1),
    s AS (SELECT {K}, mjd, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM j GROUP BY {K}, mjd) SELECT {K}, mjd, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 2) AS filtered FROM s""")
def local_regression(spark, sf):
    """Lines over the nearest hundredth of the days."""
    return rounded(filters.loess(fx.orders_daily(spark, sf), 0.01).select(*KEY, "mjd", "filtered"), 2, "filtered")

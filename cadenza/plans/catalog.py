"""Registered queries over the driver tables, each with its SQL where SQL can express it.

Results are rounded where a float sum may depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import geodesy as geo
from cadenza.functions import timefn as tf
from cadenza.operators import filters, gaps, homogeneity, models, ordered, outliers, qc, regression, relational, stats
from cadenza.plans import fixtures as fx
from cadenza.plans.fixtures import KEY, SQL_EVENTS, SQL_GAPPY, SQL_ORDERS, SQL_SHIP

FLAGSHIP = "iqr_outliers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


W = "PARTITION BY station_id, component"
WO = W + " ORDER BY mjd"
K = "station_id, component"

# ---- scan and shape ------------------------------------------------------------------------------------------------


@query("daily_series", _with(SQL_ORDERS) + "SELECT * FROM orders_daily")
def daily_series(spark, sf):
    return fx.orders_daily(spark, sf)


@query("long_unpivot", """SELECT l_orderkey AS seq, l_linenumber, 'l_quantity' AS component, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""")
def long_unpivot(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq"), "l_linenumber", "l_quantity", "l_discount")
    return l.unpivot(["seq", "l_linenumber"], ["l_quantity", "l_discount"], "component", "value")


@query("merge_union", _with(SQL_ORDERS, SQL_SHIP) + "SELECT *, 0 AS source_no FROM orders_daily UNION ALL SELECT *, 1 FROM ship_daily")
def merge_union(spark, sf):
    return relational.merge(fx.orders_daily(spark, sf), fx.ship_daily(spark, sf))


@query("time_slice_closed", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-06-30'")
def time_slice_closed(spark, sf):
    o = fx.read(spark, sf, "orders")
    return o.where(F.col("o_orderdate").between(F.to_timestamp(F.lit("1996-03-01")), F.to_timestamp(F.lit("1996-06-30")))).select("o_orderkey", "o_totalprice")


@query("index_slice", _with(SQL_ORDERS) + f"SELECT * FROM (SELECT *, row_number() OVER ({WO}) - 1 AS idx FROM orders_daily) WHERE idx >= 100 AND idx < 200")
def index_slice(spark, sf):
    return relational.index_slice(fx.orders_daily(spark, sf), 100, 200)


@query("mjd_roundtrip", """SELECT event_id, round(epoch_us(ts) / 8.64e10 + 40587, 9) AS mjd, round(epoch_us(ts) / 1e6, 3) AS unix_s,
    (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 40587) AS day FROM events""")
def mjd_roundtrip(spark, sf):
    e = fx.read(spark, sf, "events").select("event_id", tf.mjd_from_timestamp(F.col("ts").cast("timestamp")).alias("m"))
    back = tf.timestamp_from_mjd(F.col("m"))
    return e.select("event_id", F.round("m", 9).alias("mjd"), F.round(tf.unix_from_mjd(F.col("m")), 3).alias("unix_s"), (F.unix_date(back.cast("date")) + 40587).alias("day"))


@query("gps_leap_lookup", """SELECT event_id, CAST(18 AS DOUBLE) AS leap, CAST(floor((epoch_us(ts) / 1e6 - 315964800 + 18) / 604800) AS INT) AS week,
    CAST(floor((epoch_us(ts) / 1e6 - 315964800 + 18) - floor((epoch_us(ts) / 1e6 - 315964800 + 18) / 604800) * 604800 + 5e-5) AS BIGINT) AS sow FROM events""")
def gps_leap_lookup(spark, sf):
    t = F.col("ts").cast("timestamp")
    e = fx.read(spark, sf, "events").select("event_id", tf.leap_seconds(tf.day_from_timestamp(t)).alias("leap"), tf.gps_from_timestamp(t).alias("s"))
    return e.select("event_id", "leap", tf.week_from_gps(F.col("s")).alias("week"), F.floor(tf.sow_from_gps(F.col("s")) + 5e-5).cast("bigint").alias("sow"))


# ---- statistics ----------------------------------------------------------------------------------------------------

EV = "SELECT event_type AS station_id, 'value' AS component, epoch_us(ts) / 8.64e10 + 40587 AS mjd, value FROM events"


def events_raw(spark, sf):
    e = fx.read(spark, sf, "events")
    return e.select(F.col("event_type").alias("station_id"), F.lit("value").alias("component"), tf.mjd_from_timestamp(F.col("ts").cast("timestamp")).alias("mjd"), "value")


@query("summary_stats", f"""WITH e AS ({EV}), m AS (SELECT {K}, median(value) AS med FROM e GROUP BY ALL)
    SELECT station_id, component, count(*) AS n, 0::BIGINT AS n_missing, count(*) AS n_valid, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance,
    round(stddev_samp(value), 6) AS stddev, round(skewness(value), 5) AS skewness, round(kurtosis(value), 4) AS kurtosis, min(value) AS min,
    round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max,
    round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
    round(stddev_samp(value) / abs(avg(value)), 6) AS cv, round(mad(value), 6) AS mad FROM e GROUP BY station_id, component""".replace(f", m AS (SELECT {K}, median(value) AS med FROM e GROUP BY ALL)", ""))
def summary_stats(spark, sf):
    s = stats.summary(events_raw(spark, sf))
    return rounded(rounded(rounded(s, 6, "mean", "stddev", "q1", "median", "q3", "range", "iqr", "cv", "mad"), 5, "variance", "skewness"), 4, "kurtosis")


@query("five_number", f"""WITH e AS ({EV}) SELECT {K}, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM e GROUP BY {K}""")
def five_number(spark, sf):
    return rounded(stats.five_number(events_raw(spark, sf)), 6, "q1", "median", "q3")


@query("trimmed_mean", f"""WITH e AS ({EV}), r AS (SELECT *, row_number() OVER ({W} ORDER BY value) AS r, count(*) OVER ({W}) AS n FROM e)
    SELECT {K}, round(avg(value), 6) AS trimmed_mean FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY {K}""")
def trimmed_mean(spark, sf):
    return rounded(stats.trimmed_mean(events_raw(spark, sf), 0.1), 6, "trimmed_mean")


@query("mad", f"WITH e AS ({EV}) SELECT {K}, round(mad(value), 6) AS mad FROM e GROUP BY {K}")
def mad(spark, sf):
    return rounded(stats.mad(events_raw(spark, sf)), 6, "mad")


@query("mode_list", """WITH c AS (SELECT l_returnflag AS station_id, l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1, 2),
    t AS (SELECT station_id, max(k) AS top FROM c GROUP BY 1)
    SELECT c.station_id, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY v) AS mode FROM c JOIN t ON c.station_id = t.station_id AND k = top AND top > 1 GROUP BY 1""")
def mode_list(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station_id"), F.col("l_quantity").alias("value"))
    return stats.modes(l, ["station_id"]).select("station_id", F.array_join(F.transform("mode", lambda x: x.cast("bigint").cast("string")), ",").alias("mode"))


@query("skew_kurt_adjusted", """SELECT l_returnflag AS station_id, round(skewness(l_extendedprice), 6) AS skewness, round(kurtosis(l_extendedprice), 5) AS kurtosis
    FROM lineitem GROUP BY 1""")
def skew_kurt_adjusted(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station_id"), F.col("l_extendedprice").alias("value"))
    return l.groupBy("station_id").agg(F.round(stats.skewness_adjusted(), 6).alias("skewness"), F.round(stats.kurtosis_adjusted(), 5).alias("kurtosis"))


@query("pearson", """SELECT l_returnflag AS station_id, count(*) AS n, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance,
    round(corr(l_quantity, l_extendedprice), 8) AS pearson FROM lineitem GROUP BY 1""")
def pearson(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station_id"), "l_quantity", "l_extendedprice")
    return rounded(rounded(stats.pearson(l, "l_quantity", "l_extendedprice", ["station_id"]), 2, "covariance"), 8, "pearson")


@query("spearman", """WITH r AS (SELECT l_returnflag AS s, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT s AS station_id, round(corr(a, b), 8) AS spearman FROM r GROUP BY 1""")
def spearman(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station_id"), "l_quantity", "l_extendedprice")
    return rounded(stats.spearman(l, "l_quantity", "l_extendedprice", ["station_id"]), 8, "spearman")


@query("acf_lags", _with(SQL_EVENTS) + f""", c AS (SELECT {K}, mjd, value - avg(value) OVER ({W}) AS c FROM events_hourly),
    l AS (SELECT *, lag(c, 1) OVER ({WO}) AS l1, lag(c, 2) OVER ({WO}) AS l2, lag(c, 3) OVER ({WO}) AS l3 FROM c)
    SELECT {K}, k AS lag, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN s1 / s0 WHEN 2 THEN s2 / s0 ELSE s3 / s0 END, 8) AS acf FROM
    (SELECT {K}, sum(c * c) AS s0, sum(c * l1) AS s1, sum(c * l2) AS s2, sum(c * l3) AS s3 FROM l GROUP BY {K}) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)""")
def acf_lags(spark, sf):
    return rounded(stats.acf(fx.events_hourly(spark, sf), 3), 8, "acf")


@query("diff_lag", _with(SQL_ORDERS) + f"SELECT {K}, mjd, value, round(diff, 2) AS diff FROM (SELECT *, value - lag(value, 7) OVER ({WO}) AS diff FROM orders_daily) WHERE diff IS NOT NULL")
def diff_lag(spark, sf):
    return rounded(stats.lagged_diff(fx.orders_daily(spark, sf), 7), 2, "diff")


@query("rmse_mae_bias", """SELECT l_returnflag AS station_id, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(100 * avg(abs(e / o)), 6) AS mape FROM
    (SELECT l_returnflag, l_quantity AS o, l_extendedprice / 1500 - l_quantity AS e FROM lineitem) GROUP BY 1""")
def rmse_mae_bias(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station_id"), "l_quantity", (F.col("l_extendedprice") / 1500).alias("p"))
    return rounded(stats.errors(l, "l_quantity", "p", ["station_id"]), 6, "rmse", "mae", "bias", "mape")


# ---- tests ---------------------------------------------------------------------------------------------------------


@query("durbin_watson", _with(SQL_ORDERS) + f"""SELECT {K}, round(sum(d * d) / sum(value * value), 8) AS durbin_watson FROM
    (SELECT *, value - lag(value) OVER ({WO}) AS d FROM orders_daily) GROUP BY {K}""")
def durbin_watson(spark, sf):
    return rounded(stats.durbin_watson(fx.orders_daily(spark, sf)), 8, "durbin_watson")


@query("jarque_bera", _with(SQL_ORDERS) + f""", m AS (SELECT {K}, count(*) AS n, avg(value) AS a, stddev_samp(value) AS s FROM orders_daily GROUP BY {K}),
    z AS (SELECT o.station_id, o.component, any_value(n) AS n, sum(pow((value - a) / s, 3)) / any_value(n) AS g1, sum(pow((value - a) / s, 4)) / any_value(n) - 3 AS g2 FROM orders_daily o JOIN m USING (station_id, component) GROUP BY 1, 2)
    SELECT {K}, n, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 5) AS statistic, round(exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)), 8) AS p_value FROM z""")
def jarque_bera(spark, sf):
    return rounded(rounded(stats.jarque_bera(fx.orders_daily(spark, sf)), 5, "statistic"), 8, "p_value")


@query("ljung_box_q", _with(SQL_EVENTS) + f""", c AS (SELECT {K}, mjd, value - avg(value) OVER ({W}) AS c FROM events_hourly),
    l AS (SELECT *, lag(c, 1) OVER ({WO}) AS l1, lag(c, 2) OVER ({WO}) AS l2, lag(c, 3) OVER ({WO}) AS l3 FROM c),
    s AS (SELECT {K}, count(*) AS n, sum(c * c) AS s0, sum(c * l1) AS s1, sum(c * l2) AS s2, sum(c * l3) AS s3 FROM l GROUP BY {K})
    SELECT {K}, round(n * (n + 2.0) * (pow(s1 / s0, 2) / (n - 1) + pow(s2 / s0, 2) / (n - 2) + pow(s3 / s0, 2) / (n - 3)), 6) AS statistic FROM s""")
def ljung_box_q(spark, sf):
    return rounded(stats.ljung_box(fx.events_hourly(spark, sf), 3).drop("p_value"), 6, "statistic")


@query("runs_z", _with(SQL_EVENTS) + f""", r AS (SELECT *, row_number() OVER ({W} ORDER BY value) AS r, count(*) OVER ({W}) AS n FROM events_hourly),
    m AS (SELECT {K}, max(CASE WHEN r = n // 2 + 1 THEN value END) AS med FROM r GROUP BY {K}),
    u AS (SELECT e.station_id, e.component, e.mjd, CASE WHEN value > med THEN 1 ELSE 0 END AS up FROM events_hourly e JOIN m USING (station_id, component) WHERE value <> med),
    w AS (SELECT *, CASE WHEN lag(up) OVER ({WO}) = up THEN 0 ELSE 1 END AS nw FROM u),
    a AS (SELECT {K}, CAST(sum(nw) AS BIGINT) AS runs, CAST(sum(up) AS BIGINT) AS n1, CAST(sum(1 - up) AS BIGINT) AS n2 FROM w GROUP BY {K})
    SELECT *, round((runs - (2.0 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2.0 * n1 * n2 * (2.0 * n1 * n2 - n1 - n2) / (pow(n1 + n2, 2) * (n1 + n2 - 1))), 8) AS z FROM a""")
def runs_z(spark, sf):
    return rounded(stats.runs_test(fx.events_hourly(spark, sf)), 8, "z")


# ---- gaps and season -----------------------------------------------------------------------------------------------

NEIGHBOURS = f"""nb AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN mjd END IGNORE NULLS) OVER b AS t0,
    first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN mjd END IGNORE NULLS) OVER a AS t1 FROM gappy
    WINDOW b AS ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({WO} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def gappy_orders(spark, sf):
    return fx.gappy(fx.orders_daily(spark, sf))


def null_out(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


@query("gap_detect", _with(SQL_ORDERS, SQL_GAPPY) + f""", s AS (SELECT {K}, median(d) AS step FROM (SELECT *, mjd - lag(mjd) OVER ({WO}) AS d FROM orders_daily) WHERE d > 0 GROUP BY {K}),
    x AS (SELECT g.*, step, row_number() OVER ({WO}) - 1 AS i, lag(mjd) OVER ({WO}) AS prev, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS bad FROM gappy g JOIN s USING (station_id, component)),
    y AS (SELECT *, CASE WHEN lag(bad) OVER ({WO}) = bad THEN 0 ELSE 1 END AS edge FROM x), z AS (SELECT *, sum(edge) OVER ({WO}) AS run FROM y)
    SELECT {K}, min(i) AS start_index, max(i) AS end_index, min(mjd) AS start_mjd, max(mjd) AS end_mjd, count(*) AS n_missing FROM z WHERE bad = 1 GROUP BY {K}, run
    UNION ALL SELECT {K}, i, i - 1, prev, mjd, CAST(round((mjd - prev) / step) AS BIGINT) - 1 FROM x WHERE bad = 0 AND mjd - prev > 1.5 * step AND round((mjd - prev) / step) > 1""")
def gap_detect(spark, sf):
    return gaps.detect(gappy_orders(spark, sf))


@query("fill_linear", _with(SQL_ORDERS, SQL_GAPPY, NEIGHBOURS) + f"""SELECT {K}, mjd, value, round(coalesce(value, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (mjd - t0) / (t1 - t0) END), 4) AS filled FROM nb""")
def fill_linear(spark, sf):
    return rounded(null_out(gaps.fill_linear(gappy_orders(spark, sf)), "value"), 4, "filled")


@query("fill_ffill", _with(SQL_ORDERS, SQL_GAPPY, NEIGHBOURS) + f"SELECT {K}, mjd, value, coalesce(value, v0, v1) AS filled FROM nb")
def fill_ffill(spark, sf):
    return null_out(gaps.fill_forward(gappy_orders(spark, sf)), "value")


@query("fill_mean", _with(SQL_ORDERS, SQL_GAPPY) + f"SELECT {K}, mjd, value, round(coalesce(value, avg(value) OVER ({W})), 4) AS filled FROM gappy")
def fill_mean(spark, sf):
    return rounded(null_out(gaps.fill_mean(gappy_orders(spark, sf)), "value"), 4, "filled")


PROFILE = f"""prof AS (SELECT {K}, dayofyear(DATE '1970-01-01' + CAST(mjd - 40587 AS INT)) AS doy, median(value) AS m, count(value) AS n FROM gappy WHERE value IS NOT NULL GROUP BY {K}, 3)"""


@query("median_year_profile", _with(SQL_ORDERS, SQL_GAPPY, PROFILE) + f"SELECT {K}, CAST(doy AS INT) AS doy, 0 AS slot, n, CASE WHEN n >= 5 THEN round(m, 4) END AS profile FROM prof")
def median_year_profile(spark, sf):
    return rounded(null_out(gaps.median_year(gappy_orders(spark, sf)), "profile"), 4, "profile")


@query("fill_median_year", _with(SQL_ORDERS, SQL_GAPPY, NEIGHBOURS, PROFILE) + """SELECT nb.station_id, nb.component, mjd, value, round(coalesce(value, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN n >= 5 THEN m END), 4) AS filled
    FROM nb LEFT JOIN prof ON nb.station_id = prof.station_id AND doy = dayofyear(DATE '1970-01-01' + CAST(mjd - 40587 AS INT))""")
def fill_median_year(spark, sf):
    return rounded(null_out(gaps.fill_median_year(gappy_orders(spark, sf)), "value", "filled"), 4, "filled")


MA = f"""ma AS (SELECT *, CASE WHEN count(value) OVER w = 31 THEN avg(value) OVER w END AS f FROM orders_daily WINDOW w AS ({WO} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
    held AS (SELECT {K}, mjd, value, coalesce(f, last_value(f IGNORE NULLS) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f IGNORE NULLS) OVER ({WO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend FROM ma)"""


@query("deseason_ma", _with(SQL_ORDERS, MA) + f"SELECT {K}, mjd, value, round(trend, 4) AS seasonal, round(value - trend, 4) AS residual FROM held")
def deseason_ma(spark, sf):
    return rounded(gaps.deseasonalize(fx.orders_daily(spark, sf), "moving_average", 30), 4, "seasonal", "residual")


@query("deseason_median_year", _with(SQL_ORDERS) + f""", prof AS (SELECT {K}, dayofyear(DATE '1970-01-01' + CAST(mjd - 40587 AS INT)) AS doy, median(value) AS m, count(*) AS n FROM orders_daily GROUP BY {K}, 3)
    SELECT o.station_id, o.component, mjd, value, CASE WHEN n >= 5 THEN round(m, 4) END AS seasonal, CASE WHEN n >= 5 THEN round(value - m, 4) END AS residual
    FROM orders_daily o LEFT JOIN prof ON o.station_id = prof.station_id AND doy = dayofyear(DATE '1970-01-01' + CAST(mjd - 40587 AS INT))""")
def deseason_median_year(spark, sf):
    return rounded(null_out(gaps.deseasonalize(fx.orders_daily(spark, sf)), "seasonal", "residual"), 4, "seasonal", "residual")


@query("classical_decompose", _with(SQL_ORDERS, MA.replace("= 31", "= 7").replace("15 PRECEDING", "3 PRECEDING").replace("15 FOLLOWING", "3 FOLLOWING")) + f""", s AS (SELECT *, (row_number() OVER ({WO}) - 1) % 7 AS slot FROM held),
    a AS (SELECT {K}, slot, avg(value - trend) AS m FROM s GROUP BY {K}, slot), b AS (SELECT *, m - avg(m) OVER ({W}) AS seasonal FROM a)
    SELECT s.station_id, s.component, mjd, value, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(value - trend - seasonal, 4) AS residual FROM s JOIN b ON s.station_id = b.station_id AND s.slot = b.slot""")
def classical_decompose(spark, sf):
    return rounded(models.classical_sql(fx.orders_daily(spark, sf), 7), 4, "trend", "seasonal", "residual")


# ---- filters -------------------------------------------------------------------------------------------------------


@query("moving_average", _with(SQL_ORDERS, MA) + f"SELECT {K}, mjd, value, round(f, 4) AS filtered FROM ma")
def moving_average(spark, sf):
    return rounded(null_out(filters.moving_average(fx.orders_daily(spark, sf), 30), "filtered"), 4, "filtered")


@query("weighted_ma", _with(SQL_ORDERS) + f"""SELECT {K}, mjd, value, round((lag(value, 2) OVER w * 1 + lag(value, 1) OVER w * 2 + value * 3 + lead(value, 1) OVER w * 2 + lead(value, 2) OVER w * 1) / 9.0, 4) AS filtered
    FROM orders_daily WINDOW w AS ({WO})""")
def weighted_ma(spark, sf):
    return rounded(null_out(filters.weighted(fx.orders_daily(spark, sf), [1.0, 2.0, 3.0, 2.0, 1.0]), "filtered"), 4, "filtered")


@query("kernel_epanechnikov", _with(SQL_ORDERS) + f""", i AS (SELECT *, row_number() OVER ({WO}) AS i FROM orders_daily)
    SELECT a.station_id, a.component, a.mjd, a.value, round(sum(0.75 * (1 - pow((b.i - a.i) / 5.0, 2)) * b.value) / sum(0.75 * (1 - pow((b.i - a.i) / 5.0, 2))), 4) AS filtered
    FROM i a JOIN i b ON b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY 1, 2, 3, 4""")
def kernel_epanechnikov(spark, sf):
    return rounded(filters.kernel_smooth(fx.orders_daily(spark, sf), 5), 4, "filtered")


@query("savgol_5_2", _with(SQL_ORDERS) + f""", i AS (SELECT *, row_number() OVER ({WO}) AS i, count(*) OVER ({W}) AS n FROM orders_daily)
    SELECT {K}, mjd, value, round((-3 * lag(value, 2) OVER w + 12 * lag(value, 1) OVER w + 17 * value + 12 * lead(value, 1) OVER w - 3 * lead(value, 2) OVER w) / 35.0, 4) AS filtered
    FROM i WINDOW w AS ({WO}) QUALIFY i > 2 AND i <= n - 2""")
def savgol_5_2(spark, sf):
    x = filters.savitzky_golay(fx.orders_daily(spark, sf), 5, 2)
    w = Window.partitionBy(*KEY)
    x = x.withColumns({"i": F.row_number().over(w.orderBy("mjd")), "n": F.count("*").over(w)})
    return rounded(x.where("i > 2 and i <= n - 2").drop("i", "n"), 4, "filtered")


@query("ema", "WITH RECURSIVE " + SQL_ORDERS + f""", i AS (SELECT *, row_number() OVER ({WO}) AS i FROM orders_daily),
    r AS (SELECT i, mjd, value, value AS s FROM i WHERE i = 1 UNION ALL SELECT i.i, i.mjd, i.value, 0.3 * i.value + 0.7 * r.s FROM r JOIN i ON i.i = r.i + 1)
    SELECT 'orders' AS station_id, 'revenue' AS component, mjd, value, round(s, 4) AS filtered FROM r""")
def ema(spark, sf):
    return rounded(filters.ema(fx.orders_daily(spark, sf), 0.3), 4, "filtered")


# ---- outliers and quality control ----------------------------------------------------------------------------------


@query("iqr_outliers", _with(SQL_ORDERS) + f""", f AS (SELECT 'orders' AS station_id, 'revenue' AS component, unnest(range((SELECT min(mjd)::BIGINT FROM orders_daily), (SELECT max(mjd)::BIGINT FROM orders_daily) + 1))::DOUBLE AS mjd),
    j AS (SELECT f.*, value FROM f LEFT JOIN orders_daily USING (mjd)),
    nb AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN mjd END IGNORE NULLS) OVER b AS t0,
    first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN mjd END IGNORE NULLS) OVER a AS t1 FROM j
    WINDOW b AS ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({WO} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    v AS (SELECT {K}, mjd, coalesce(value, v0 + (v1 - v0) * (mjd - t0) / (t1 - t0)) AS filled FROM nb),
    q AS (SELECT median(filled) AS m, quantile_cont(filled, 0.75) - quantile_cont(filled, 0.25) AS s FROM v)
    SELECT {K}, mjd, round(filled, 4) AS filled, round((filled - m) / s, 6) AS score FROM v, q WHERE abs((filled - m) / s) > 1.5""")
def iqr_outliers(spark, sf):
    """Outliers of the gap-filled daily revenue: expand the missing days, fill them, score about the median."""
    x = gaps.expand(fx.orders_daily(spark, sf))
    x = gaps.fill_linear(x).select(*KEY, "mjd", "filled")
    o = outliers.iqr(x, 1.5, KEY, "filled").where("is_outlier")
    return rounded(rounded(o.select(*KEY, "mjd", "filled", "score"), 4, "filled"), 6, "score")


@query("mad_outliers", f"""WITH e AS ({EV}), m AS (SELECT {K}, median(value) AS m, mad(value) / 0.6745 AS s FROM e GROUP BY {K})
    SELECT e.station_id, e.component, mjd, value, round((value - m) / s, 6) AS score FROM e JOIN m ON e.station_id = m.station_id WHERE abs((value - m) / s) > 3.5""")
def mad_outliers(spark, sf):
    o = outliers.mad(events_raw(spark, sf)).where("is_outlier").select(*KEY, "mjd", "value", "score")
    return rounded(o, 6, "score")


@query("zscore_outliers", f"""WITH e AS ({EV}), m AS (SELECT {K}, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY {K})
    SELECT e.station_id, e.component, mjd, value, round((value - m) / s, 6) AS score FROM e JOIN m ON e.station_id = m.station_id WHERE abs((value - m) / s) > 3""")
def zscore_outliers(spark, sf):
    return rounded(outliers.zscore(events_raw(spark, sf)).where("is_outlier").select(*KEY, "mjd", "value", "score"), 6, "score")


@query("outlier_clean", _with(SQL_ORDERS) + f""", m AS (SELECT median(value) AS m, mad(value) / 0.6745 AS s FROM orders_daily),
    gappy AS (SELECT {K}, mjd, value AS raw, CASE WHEN abs((value - m) / s) > 2 THEN NULL ELSE value END AS value FROM orders_daily, m), {NEIGHBOURS}
    SELECT {K}, mjd, round(raw, 4) AS value, round(coalesce(value, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (mjd - t0) / (t1 - t0) END), 4) AS cleaned, CASE WHEN value IS NULL THEN 2 ELSE 0 END AS flag_out FROM nb""")
def outlier_clean(spark, sf):
    x = outliers.clean(fx.orders_daily(spark, sf), "mad", 2.0)
    return rounded(x.select(*KEY, "mjd", "value", "cleaned", "flag_out"), 4, "value", "cleaned")


STEPS = f"""d AS (SELECT {K}, mjd, value, round(mjd - lag(mjd) OVER ({WO}), 9) AS d FROM events_hourly), r AS (SELECT *, row_number() OVER ({W} ORDER BY d) AS r, count(*) OVER ({W}) AS n FROM d WHERE d IS NOT NULL),
    st AS (SELECT {K}, max(CASE WHEN r = n // 2 + 1 THEN d END) AS step FROM r GROUP BY {K})"""


def hourly9(spark, sf):
    return fx.events_hourly(spark, sf)


@query("qc_sampling", _with(SQL_EVENTS, STEPS) + """SELECT r.station_id, r.component, round(any_value(step), 6) AS median_step, round(min(d), 6) AS min_step, round(max(d), 6) AS max_step, round(avg(CASE WHEN d > 1.1 * step THEN 1.0 ELSE 0.0 END), 8) AS non_uniform_fraction,
    round(1 - avg(CASE WHEN d > 1.1 * step THEN 1.0 ELSE 0.0 END), 8) AS uniform_fraction FROM r JOIN st USING (station_id, component) GROUP BY 1, 2""")
def qc_sampling(spark, sf):
    return rounded(rounded(qc.sampling(hourly9(spark, sf)), 6, "median_step", "min_step", "max_step"), 8, "non_uniform_fraction", "uniform_fraction")


@query("qc_coverage", _with(SQL_EVENTS, STEPS) + """SELECT d.station_id, d.component, round(min(mjd), 6) AS start_mjd, round(max(mjd), 6) AS end_mjd, count(*) AS n, count(*) AS n_valid, round(any_value(step), 6) AS step,
    count(CASE WHEN d > 1.5 * step THEN d END) AS n_gaps, round(max(CASE WHEN d > 1.5 * step THEN d END), 6) AS longest_gap, round(median(CASE WHEN d > 1.5 * step THEN d END), 6) AS median_gap,
    CAST(round((max(mjd) - min(mjd)) / any_value(step)) AS BIGINT) + 1 AS n_expected, round(count(*) / (round((max(mjd) - min(mjd)) / any_value(step)) + 1), 8) AS completeness FROM d JOIN st USING (station_id, component) GROUP BY 1, 2""")
def qc_coverage(spark, sf):
    return rounded(rounded(qc.coverage(hourly9(spark, sf)), 6, "start_mjd", "end_mjd", "step", "longest_gap", "median_gap"), 8, "completeness")


@query("qc_flags", _with(SQL_ORDERS, SQL_GAPPY) + f""", s AS (SELECT median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q, mad(value) / 0.6745 AS d, avg(value) AS a, stddev_samp(value) AS z FROM gappy)
    SELECT {K}, mjd, value, CASE WHEN value IS NULL THEN 1 ELSE 0 END + CASE WHEN abs((value - m) / q) > 1.0 THEN 2 ELSE 0 END + CASE WHEN abs((value - m) / d) > 2.0 THEN 4 ELSE 0 END + CASE WHEN abs((value - a) / z) > 2.0 THEN 8 ELSE 0 END AS qc_flag FROM gappy, s""")
def qc_flags(spark, sf):
    x = gappy_orders(spark, sf)
    return null_out(qc.flags(null_out(x, "value"), 0, 1.0, 2.0, 2.0), "value")


@query("qc_year_month", _with(SQL_ORDERS) + f""", st AS (SELECT 1.0 AS step), m AS (SELECT {K}, CAST(year(DATE '1970-01-01' + CAST(mjd - 40587 AS INT)) AS INT) AS year, CAST(month(DATE '1970-01-01' + CAST(mjd - 40587 AS INT)) AS INT) AS month, count(*) AS n FROM orders_daily GROUP BY {K}, 3, 4)
    SELECT {K}, year, month, n, round(n / 30.44, 8) AS share, n / 30.44 < 0.5 AS poor FROM m""")
def qc_year_month(spark, sf):
    return rounded(qc.year_month(fx.orders_daily(spark, sf)), 8, "share")


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("sync_inner_tol", _with(SQL_ORDERS, SQL_SHIP) + "SELECT * FROM orders_daily o WHERE EXISTS (SELECT 1 FROM ship_daily s WHERE abs(s.mjd - o.mjd) <= 0.5)")
def sync_inner_tol(spark, sf):
    return relational.sync_inner(fx.orders_daily(spark, sf), [fx.ship_daily(spark, sf)], 0.5)


@query("sync_outer", _with(SQL_ORDERS, SQL_SHIP) + "SELECT mjd FROM orders_daily UNION SELECT mjd FROM ship_daily")
def sync_outer(spark, sf):
    return relational.sync_outer([fx.orders_daily(spark, sf), fx.ship_daily(spark, sf)], 0.5)


@query("nearest_align", _with(SQL_ORDERS, SQL_SHIP) + f""", s AS (SELECT mjd + 0.25 * (1 + mjd::BIGINT % 3) AS near_mjd, value AS near_value FROM ship_daily),
    j AS (SELECT o.*, near_mjd, near_value, row_number() OVER (PARTITION BY mjd ORDER BY abs(near_mjd - mjd), near_mjd DESC) AS k FROM orders_daily o LEFT JOIN s ON abs(near_mjd - mjd) <= 0.4)
    SELECT {K}, mjd, value, near_mjd, near_value FROM j WHERE k = 1""")
def nearest_align(spark, sf):
    """All shipping days, at a quarter, a half or three quarters of their day, so that the nearest one differs."""
    shift = 0.25 * (1 + F.col("mjd").cast("bigint") % 3)
    s = fx.ship_daily(spark, sf).select(F.lit("orders").alias("station_id"), F.lit("revenue").alias("component"), (F.col("mjd") + shift).alias("mjd"), "value")
    return relational.nearest(fx.orders_daily(spark, sf), s, 0.4).select(*KEY, "mjd", "value", "near_mjd", "near_value")


@query("pivot_channels", _with(SQL_ORDERS, SQL_SHIP) + "SELECT coalesce(o.mjd, s.mjd) AS mjd, o.value AS revenue, s.value AS quantity FROM orders_daily o FULL JOIN ship_daily s ON o.mjd = s.mjd")
def pivot_channels(spark, sf):
    return relational.pivot_channels(fx.orders_daily(spark, sf).union(fx.ship_daily(spark, sf)), ["revenue", "quantity"])


@query("ccf_lags", _with(SQL_ORDERS, SQL_SHIP) + """, x AS (SELECT o.mjd, o.value AS a, s.value AS b FROM orders_daily o JOIN ship_daily s ON o.mjd = s.mjd), l AS (SELECT a, b, lead(b, 1) OVER (ORDER BY mjd) AS m1, lag(b, 1) OVER (ORDER BY mjd) AS p1 FROM x)
    SELECT lag, round(CASE lag WHEN -1 THEN r1 WHEN 0 THEN r2 ELSE r3 END, 8) AS r FROM (SELECT corr(a, m1) AS r1, corr(a, b) AS r2, corr(a, p1) AS r3 FROM l) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS lag)""")
def ccf_lags(spark, sf):
    x = fx.orders_daily(spark, sf).select("mjd", F.col("value").alias("a")).join(fx.ship_daily(spark, sf).select("mjd", F.col("value").alias("b")), "mjd")
    return rounded(relational.ccf(x, "a", "b", 1), 8, "r")


@query("variogram_bins", _with(SQL_ORDERS) + f"""SELECT a.station_id, a.component, CAST(floor((b.mjd - a.mjd) / 2.0) AS BIGINT) AS bin, count(*) AS n_pairs, round(avg(b.mjd - a.mjd), 8) AS lag, round(sum(pow(a.value - b.value, 2)) / (2 * count(*)) / 1e6, 4) AS gamma
    FROM orders_daily a JOIN orders_daily b ON b.mjd > a.mjd AND b.mjd - a.mjd < 20 GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def variogram_bins(spark, sf):
    v = relational.variogram(fx.orders_daily(spark, sf), 20.0, 10).withColumn("gamma", F.col("gamma") / 1e6)
    return rounded(rounded(v, 8, "lag"), 4, "gamma")


# ---- models --------------------------------------------------------------------------------------------------------


@query("linear_fit", _with(SQL_ORDERS) + f"""SELECT {K}, count(*) AS n, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 3) AS intercept, round(regr_r2(value, x), 8) AS r2, min(mjd) AS t_ref FROM (SELECT *, mjd - min(mjd) OVER ({W}) AS x FROM orders_daily) GROUP BY {K}""")
def linear_fit(spark, sf):
    return rounded(rounded(rounded(regression.linear(fx.orders_daily(spark, sf)), 6, "slope"), 3, "intercept"), 8, "r2")


@query("harmonic_fit", _with(SQL_ORDERS) + f""", x AS (SELECT *, sin((mjd - min(mjd) OVER ({W})) * 2 * pi() / 365.25) AS s, cos((mjd - min(mjd) OVER ({W})) * 2 * pi() / 365.25) AS c FROM orders_daily),
    m AS (SELECT {K}, count(*) AS n, avg(value) AS my, avg(s) AS ms, avg(c) AS mc, covar_pop(s, s) AS ss, covar_pop(c, c) AS cc, covar_pop(s, c) AS sc, covar_pop(s, value) AS sy, covar_pop(c, value) AS cy FROM x GROUP BY {K}),
    b AS (SELECT *, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS b1, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS b2 FROM m)
    SELECT {K}, n, round(my - b1 * ms - b2 * mc, 3) AS a0, round(b1, 3) AS b_sin, round(b2, 3) AS b_cos, round(sqrt(b1 * b1 + b2 * b2), 3) AS amplitude, round(atan2(b1, b2), 6) AS phase FROM b""")
def harmonic_fit(spark, sf):
    return rounded(rounded(regression.harmonic_normal(fx.orders_daily(spark, sf), 365.25), 3, "a0", "b_sin", "b_cos", "amplitude"), 6, "phase")


@query("tls_calibration", """WITH a AS (SELECT l_returnflag AS station_id, count(*) AS n, var_samp(l_quantity) AS xx, var_samp(l_extendedprice / 1500) AS yy, covar_samp(l_quantity, l_extendedprice / 1500) AS xy, avg(l_quantity) AS mx, avg(l_extendedprice / 1500) AS my FROM lineitem GROUP BY 1),
    b AS (SELECT *, (yy - xx + sqrt(pow(yy - xx, 2) + 4 * xy * xy)) / (2 * xy) AS s FROM a) SELECT station_id, n, round(s, 8) AS slope, round(my - s * mx, 6) AS intercept FROM b""")
def tls_calibration(spark, sf):
    l = fx.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("station_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1500).alias("y"))
    return rounded(rounded(regression.calibration(l, "x", "y", ["station_id"]), 8, "slope"), 6, "intercept")


SPLITS = f"""c AS (SELECT *, count(*) OVER ({W}) AS n, value - avg(value) OVER ({W}) AS c FROM orders_daily), p AS (SELECT *, row_number() OVER ({WO}) AS k, sum(c) OVER o AS s, sum(c * c) OVER o AS q, sum(c * c) OVER ({W}) AS qq FROM c WINDOW o AS ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    t AS (SELECT *, s / k AS l, -s / (n - k) AS r FROM p WHERE k < n)"""


@query("snht_argmax", _with(SQL_ORDERS, SPLITS) + f"""SELECT {K}, k, round((k * l * l + (n - k) * r * r) / (qq / n), 6) AS snht, round(r - l, 4) AS shift FROM t QUALIFY row_number() OVER ({W} ORDER BY (k * l * l + (n - k) * r * r) / (qq / n) DESC, k) = 1""")
def snht_argmax(spark, sf):
    return rounded(rounded(homogeneity.snht_argmax(fx.orders_daily(spark, sf)), 6, "snht"), 4, "shift")


@query("tstat_argmax", _with(SQL_ORDERS, SPLITS) + f""", u AS (SELECT *, sqrt((n - k) * k / n::DOUBLE) * abs(l - r) / sqrt((qq - s * s / k - s * s / (n - k)) / (n - 2)) AS ts FROM t)
    SELECT {K}, k, round(ts, 6) AS t_stat, round(r - l, 4) AS shift, mjd AS last_left FROM u QUALIFY row_number() OVER ({W} ORDER BY ts DESC, k) = 1""")
def tstat_argmax(spark, sf):
    return rounded(rounded(homogeneity.t_argmax(fx.orders_daily(spark, sf)), 6, "t_stat"), 4, "shift")


@query("series_adjust", _with(SQL_ORDERS) + f"SELECT {K}, mjd, value, round(value - CASE WHEN mjd >= 50500 THEN 900.5 ELSE 0 END - CASE WHEN mjd >= 51000 THEN -400.25 ELSE 0 END, 4) AS adjusted FROM orders_daily")
def series_adjust(spark, sf):
    pts = spark.createDataFrame([("orders", "revenue", 50500.0, 900.5), ("orders", "revenue", 51000.0, -400.25)], "station_id string, component string, mjd double, shift double")
    return rounded(homogeneity.adjust(fx.orders_daily(spark, sf), pts), 4, "adjusted")


@query("breusch_pagan", _with(SQL_ORDERS) + f""", x AS (SELECT *, mjd - min(mjd) OVER ({W}) AS x FROM orders_daily), l AS (SELECT regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM x),
    e AS (SELECT x.*, a + b * x AS f, pow(a + b * x - value, 2) AS e FROM x, l) SELECT {K}, count(*) AS n, round(count(*) * pow(corr(e, f), 2), 6) AS lm FROM e GROUP BY {K}""")
def breusch_pagan(spark, sf):
    return rounded(regression.breusch_pagan(fx.orders_daily(spark, sf)), 6, "lm")


@query("lomb_scargle", _with(SQL_EVENTS) + f""", d AS (SELECT *, mjd - lag(mjd) OVER ({WO}) AS d FROM events_hourly), st AS (SELECT {K}, median(d) AS step FROM d WHERE d > 0 GROUP BY {K}),
    x AS (SELECT e.station_id, e.component, step, mjd - min(mjd) OVER (PARTITION BY e.component) AS t, value - avg(value) OVER (PARTITION BY e.component) AS c, max(mjd) OVER (PARTITION BY e.component) - min(mjd) OVER (PARTITION BY e.component) AS span FROM events_hourly e JOIN st ON e.component = st.component),
    n AS (SELECT DISTINCT component AS own, unnest(range(1, CAST(floor(4.0 * span / (2 * step) + 1e-6) AS BIGINT) + 1)) AS k FROM (SELECT component, any_value(span) AS span, any_value(step) AS step FROM x GROUP BY 1)),
    f AS (SELECT x.*, k, k / (span * 4.0) AS f, 2 * pi() * k / (span * 4.0) * t AS a FROM x JOIN n ON own = component),
    s AS (SELECT {K}, k, any_value(f) AS f, count(*) AS n, sum(sin(2 * a)) AS s2, sum(cos(2 * a)) AS c2, sum(c * sin(a)) AS ys, sum(c * cos(a)) AS yc, sum(c * c) AS yy FROM f GROUP BY {K}, k),
    u AS (SELECT *, cos(atan2(s2, c2) / 2) AS co, sin(atan2(s2, c2) / 2) AS si, sqrt(s2 * s2 + c2 * c2) AS r FROM s)
    SELECT {K}, k, round(f, 8) AS frequency, round(0.5 * (pow(yc * co + ys * si, 2) / ((n + r) / 2) + CASE WHEN (n - r) / 2 > 1e-10 * n THEN pow(ys * co - yc * si, 2) / ((n - r) / 2) ELSE 0 END) / (yy / (n - 1)), 6) AS power FROM u""")
def lomb_scargle(spark, sf):
    """The whole grid, to half the inverse of the median step; a sine that vanishes at all epochs adds no power."""
    return rounded(rounded(models.lomb_scargle(fx.events_hourly(spark, sf)).drop("fap").withColumn("k", F.col("k").cast("bigint")), 8, "frequency"), 6, "power")


@query("block_maxima", _with(SQL_ORDERS) + f""", r AS (SELECT *, (row_number() OVER ({WO}) - 1) // 30 AS block, count(*) OVER ({W}) AS n FROM orders_daily) SELECT {K}, CAST(block AS BIGINT) AS block, max(value) AS maximum FROM r WHERE (block + 1) * 30 <= n GROUP BY {K}, block""")
def block_maxima(spark, sf):
    from cadenza.operators import extremes

    return extremes.block_maxima(fx.orders_daily(spark, sf), 30)


@query("pot_exceedances", f"""WITH e AS ({EV}), q AS (SELECT {K}, quantile_cont(value, 0.95) AS u FROM e GROUP BY {K})
    SELECT e.station_id, e.component, round(any_value(u), 6) AS threshold, count(CASE WHEN value > u THEN 1 END) AS n_exceed, round(sum(CASE WHEN value > u THEN value - u END) / count(CASE WHEN value > u THEN 1 END), 6) AS mean_excess FROM e JOIN q ON e.station_id = q.station_id GROUP BY 1, 2""")
def pot_exceedances(spark, sf):
    from cadenza.operators import extremes

    return rounded(extremes.exceedances(events_raw(spark, sf), 0.95), 6, "threshold", "mean_excess")


@query("mean_excess", f"""WITH e AS ({EV}), q AS (SELECT {K}, unnest([0.5, 0.75, 0.9]) AS p FROM e GROUP BY {K}), u AS (SELECT e.station_id, p, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.9) AS c FROM e JOIN q ON e.station_id = q.station_id GROUP BY 1, 2),
    t AS (SELECT station_id, p, CASE p WHEN 0.5 THEN a WHEN 0.75 THEN b ELSE c END AS u FROM u)
    SELECT e.station_id, e.component, p, round(any_value(u), 6) AS threshold, count(*) AS n, round(avg(value - u), 6) AS mean_excess FROM e JOIN t ON e.station_id = t.station_id AND value > u GROUP BY 1, 2, 3""")
def mean_excess(spark, sf):
    from cadenza.operators import extremes

    return rounded(extremes.mean_excess(events_raw(spark, sf), [0.5, 0.75, 0.9]), 6, "threshold", "mean_excess")


# ---- geodesy and space ---------------------------------------------------------------------------------------------


def customer_points(spark, sf):
    c = fx.read(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_custkey") % 160 - 80).cast("double").alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).cast("double").alias("lon"), F.col("c_acctbal").alias("h"))


POINTS = "p AS (SELECT c_custkey, (c_custkey % 160 - 80)::DOUBLE AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon, c_acctbal AS h FROM customer)"


@query("haversine_consecutive", f"""WITH {POINTS}, n AS (SELECT *, lead(lat) OVER (ORDER BY c_custkey) AS lat2, lead(lon) OVER (ORDER BY c_custkey) AS lon2 FROM p)
    SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2), 1.0))), 2) AS distance FROM n WHERE lat2 IS NOT NULL""")
def haversine_consecutive(spark, sf):
    n = ordered.with_lead(customer_points(spark, sf), "c_custkey", ["lat", "lon"])
    return n.select("c_custkey", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 2).alias("distance"))


ECEF = POINTS + """, g AS (SELECT *, 6378137.0 / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * pow(sin(radians(lat)), 2)) AS n FROM p),
    x AS (SELECT *, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - (1 / 298.257223563) * (2 - 1 / 298.257223563)) + h) * sin(radians(lat)) AS z FROM g)"""


@query("geod2ecef", f"WITH {ECEF} SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM x")
def geod2ecef(spark, sf):
    x, y, z = geo.geod_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    return rounded(customer_points(spark, sf).select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z")), 3, "x", "y", "z")


@query("ecef2geod", f"WITH {POINTS} SELECT c_custkey, round(lat, 8) AS lat, round(lon, 8) AS lon, round(h, 3) AS h FROM p")
def ecef2geod(spark, sf):
    x, y, z = geo.geod_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    e = customer_points(spark, sf).select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, h = geo.ecef_to_geod(F.col("x"), F.col("y"), F.col("z"))
    return rounded(rounded(e.select("c_custkey", lat.alias("lat"), lon.alias("lon"), h.alias("h")), 8, "lat", "lon"), 3, "h").withColumn("lon", F.when(F.col("lon") == 180, -180.0).otherwise(F.col("lon")))


@query("ecef2enu", f"""WITH {ECEF}, o AS (SELECT 6378137.0 / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * pow(sin(radians(49.5)), 2)) AS n0),
    d AS (SELECT c_custkey, x - (n0 + 300) * cos(radians(49.5)) * cos(radians(15.0)) AS dx, y - (n0 + 300) * cos(radians(49.5)) * sin(radians(15.0)) AS dy, z - (n0 * (1 - (1 / 298.257223563) * (2 - 1 / 298.257223563)) + 300) * sin(radians(49.5)) AS dz FROM x, o)
    SELECT c_custkey, round(-sin(radians(15.0)) * dx + cos(radians(15.0)) * dy, 3) AS e, round(-sin(radians(49.5)) * cos(radians(15.0)) * dx - sin(radians(49.5)) * sin(radians(15.0)) * dy + cos(radians(49.5)) * dz, 3) AS n,
    round(cos(radians(49.5)) * cos(radians(15.0)) * dx + cos(radians(49.5)) * sin(radians(15.0)) * dy + sin(radians(49.5)) * dz, 3) AS u FROM d""")
def ecef2enu(spark, sf):
    e, n, u = geo.geod_to_enu(F.col("lat"), F.col("lon"), F.col("h"), F.lit(49.5), F.lit(15.0), F.lit(300.0))
    return rounded(customer_points(spark, sf).select("c_custkey", e.alias("e"), n.alias("n"), u.alias("u")), 3, "e", "n", "u")


@query("idw_grid", """WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y, s_acctbal AS v FROM supplier), g AS (SELECT a * 10.0 AS gx, b * 10.0 AS gy FROM (SELECT unnest(range(0, 11)) AS a) CROSS JOIN (SELECT unnest(range(0, 11)) AS b)),
    d AS (SELECT gx, gy, v, sqrt(pow(x - gx, 2) + pow(y - gy, 2)) AS d FROM g CROSS JOIN p)
    SELECT gx AS x, gy AS y, round(CASE WHEN min(d) < 1e-12 THEN avg(CASE WHEN d < 1e-12 THEN v END) ELSE sum(CASE WHEN d >= 1e-12 THEN v / (d * d) END) / sum(CASE WHEN d >= 1e-12 THEN 1 / (d * d) END) END, 6) AS value FROM d GROUP BY 1, 2""")
def idw_grid(spark, sf):
    from cadenza.operators import spatial

    p = fx.read(spark, sf, "supplier").select((F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 97).cast("double").alias("y"), F.col("s_acctbal").alias("value"))
    g = spark.range(121).select(((F.col("id") % 11) * 10.0).alias("x"), (F.floor(F.col("id") / 11) * 10.0).alias("y"))
    return rounded(spatial.idw(p, g), 6, "value")


# ---- operators that SQL cannot express, a row each series or a row each observation; tested against numpy ----------


def _hourly(spark, sf):
    return fx.events_hourly(spark, sf)


NUMERIC: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "loess": lambda s, f: filters.loess(fx.orders_daily(s, f), 0.2),
    "spline_filter": lambda s, f: filters.spline_filter(fx.orders_daily(s, f)),
    "hat_matrix_outliers": lambda s, f: outliers.hat_matrix(fx.orders_daily(s, f), 3).where("is_outlier"),
    "stl_decompose": lambda s, f: models.decompose(_hourly(s, f), 24, "stl"),
    "change_points_bocpd": lambda s, f: homogeneity.change_points(_hourly(s, f), "bocpd"),
    "polynomial_fit": lambda s, f: regression.fit(fx.orders_daily(s, f), "polynomial", degree=2),
    "robust_fit": lambda s, f: regression.fit(fx.orders_daily(s, f), "robust"),
    "trend_fit": lambda s, f: regression.fit(fx.orders_daily(s, f), "trend", period=365.25, harmonics=2),
    "trend_decompose": lambda s, f: regression.decompose_trend(fx.orders_daily(s, f), 365.25),
    "predict_linear": lambda s, f: regression.predict(fx.orders_daily(s, f), [2500.0, 2600.0], "linear"),
    "stationarity": lambda s, f: models.stationarity(_hourly(s, f)),
    "arima_fit": lambda s, f: models.arima(_hourly(s, f), 2, 1),
    "arima_forecast": lambda s, f: models.arima(_hourly(s, f), 1, 0, horizon=12),
    "fft_periodogram": lambda s, f: models.spectrum(_hourly(s, f)),
    "welch": lambda s, f: models.spectrum(_hourly(s, f), "welch", segment=128),
    "spectrogram": lambda s, f: models.spectrogram(fx.orders_daily(s, f), 365, 0.5),
    "spectral_peaks": lambda s, f: models.peaks(models.lomb_scargle(_hourly(s, f)), 5),
    "ssa": lambda s, f: models.ssa(_hourly(s, f), 48, 8),
    "kalman": lambda s, f: models.kalman(_hourly(s, f), "local_level", "heuristic", horizon=6),
    "kalman_em": lambda s, f: models.kalman(_hourly(s, f), "local_trend", "em"),
}


def _late():
    from cadenza.operators import cluster, extremes, hypothesis, multivariate, spatial, splines
    from cadenza.plans.homogenize import HomogenizeConfig, homogenize

    def embeddings(s, f):
        """The table with a column for each coordinate, and their names."""
        e = fx.read(s, f, "embeddings")
        cols = [f"ch{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
        return e.select(F.col("vec_id").alias("mjd"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols

    def pca_scores(s, f):
        e, cols = embeddings(s, f)
        m = multivariate.pca(e, cols, 2)
        return multivariate.linear_scores(e, cols, m["mean"], m["loadings"], ["pc1", "pc2"]).select("mjd", "pc1", "pc2")

    def lda_predict(s, f):
        e, cols = embeddings(s, f)
        return multivariate.lda_predict(e, cols, multivariate.lda(e, cols, "label")).select("mjd", "label", "predicted")

    def cca(s, f):
        e, cols = embeddings(s, f)
        return one_row(s, multivariate.cca(e, cols[: len(cols) // 2], cols[len(cols) // 2 :]))

    def one_row(s, values: dict):
        return s.createDataFrame([{k: v.tolist() if hasattr(v, "tolist") else v for k, v in values.items()}])

    plane = lambda s, f: fx.read(s, f, "supplier").select((F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 97).cast("double").alias("y"), F.col("s_acctbal").alias("value"))
    cells = lambda s: spatial.grid(s, 0.0, 100.0, 0.0, 100.0, 10.0)
    NUMERIC.update({
        "shapiro_wilk": lambda s, f: hypothesis.normality(_hourly(s, f)),
        "kolmogorov_smirnov": lambda s, f: hypothesis.normality(_hourly(s, f), "kolmogorov_smirnov"),
        "pacf_hurst": lambda s, f: hypothesis.dependence(_hourly(s, f)),
        "bspline_fit": lambda s, f: splines.fit(_hourly(s, f), 20),
        "return_levels_pot": lambda s, f: extremes.return_levels(_hourly(s, f), [30.0, 365.0], interval="delta"),
        "return_levels_blocks": lambda s, f: extremes.return_levels(fx.orders_daily(s, f), [10.0, 50.0], "blocks", block=30),
        "cluster_features": lambda s, f: cluster.features(fx.orders_daily(s, f)),
        "kmeans": lambda s, f: cluster.kmeans(*embeddings(s, f), 5).select("mjd", "cluster"),
        "kmeans_series": lambda s, f: cluster.kmeans_series(cluster.features(_hourly(s, f)), ["value", "derivative"], 3, inits=2),
        "pca_scores": pca_scores,
        "mahalanobis": lambda s, f: multivariate.mahalanobis(*embeddings(s, f)).select("mjd", "distance", "is_outlier"),
        "lda_predict": lda_predict,
        "manova": lambda s, f: one_row(s, multivariate.manova(*embeddings(s, f), "label")),
        "cca": cca,
        "rbf_grid": lambda s, f: spatial.interpolate(plane(s, f), cells(s), "rbf"),
        "natural_neighbour_grid": lambda s, f: spatial.interpolate(plane(s, f), cells(s), "natural_neighbor"),
        "kriging_grid": lambda s, f: spatial.interpolate(plane(s, f), cells(s), "kriging"),
        "kriging_series": lambda s, f: spatial.krige_series(_hourly(s, f), [60320.0]),
        "homogenize": lambda s, f: homogenize(fx.gappy(fx.orders_daily(s, f)), HomogenizeConfig(deseasonalize="moving_average", window=31))[0],
    })


_late()
QUERIES.update(NUMERIC)

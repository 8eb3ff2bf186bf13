"""Series derived from the driver tables, in Spark and as SQL text.

Sums of money and quantities are taken in whole cents and hundredths, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["station_id", "component"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(c: str):
    return (F.unix_date(F.col(c).cast("date")) + 40587).cast("double")


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(_day("o_orderdate").alias("mjd"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    g = o.groupBy("mjd").agg((F.sum("c") / 100).alias("value"))
    return g.select(F.lit("orders").alias("station_id"), F.lit("revenue").alias("component"), "mjd", "value")


def ship_daily(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").select(_day("l_shipdate").alias("mjd"), F.round(F.col("l_quantity") * 100).cast("bigint").alias("c"))
    g = l.groupBy("mjd").agg((F.sum("c") / 100).alias("value"))
    return g.select(F.lit("ship").alias("station_id"), F.lit("quantity").alias("component"), "mjd", "value")


def events_hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").alias("h"), F.round(F.col("value") * 1e6).cast("bigint").alias("c"))
    g = e.groupBy("event_type", "h").agg(F.round(F.sum("c") / F.count("*") / 1e6, 4).alias("value"))
    return g.select(F.lit("events").alias("station_id"), F.col("event_type").alias("component"), (F.unix_micros(F.col("h").cast("timestamp")) / F.lit(3.6e9) / 24 + 40587).alias("mjd"), "value")


def gappy(df: DataFrame) -> DataFrame:
    """Every eleventh day, and days 30 to 36 of each 100, are missing (NaN)."""
    d = F.col("mjd").cast("bigint")
    return df.withColumn("value", F.when((d % 11 == 0) | (d % 100).between(30, 36), F.lit(float("nan"))).otherwise(F.col("value")))


SQL_ORDERS = """orders_daily AS (SELECT 'orders' AS station_id, 'revenue' AS component,
    (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 40587)::DOUBLE AS mjd,
    sum(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE AS value FROM orders GROUP BY 3)"""
SQL_SHIP = """ship_daily AS (SELECT 'ship' AS station_id, 'quantity' AS component,
    (date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 40587)::DOUBLE AS mjd,
    sum(round(l_quantity * 100)::BIGINT) / 100.0::DOUBLE AS value FROM lineitem GROUP BY 3)"""
SQL_EVENTS = """events_hourly AS (SELECT 'events' AS station_id, event_type AS component,
    epoch_us(date_trunc('hour', ts)) / 3.6e9 / 24 + 40587 AS mjd,
    round(sum(round(value * 1e6)::BIGINT) / count(*) / 1e6, 4) AS value FROM events GROUP BY event_type, date_trunc('hour', ts))"""
SQL_GAPPY = """gappy AS (SELECT station_id, component, mjd,
    CASE WHEN mjd::BIGINT % 11 = 0 OR mjd::BIGINT % 100 BETWEEN 30 AND 36 THEN NULL ELSE value END AS value FROM orders_daily)"""

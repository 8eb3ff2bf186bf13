"""Quality control of series: sampling, coverage, flags, and months that are poorly covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.timefn import timestamp_from_mjd
from cadenza.operators import outliers
from cadenza.operators.filters import held_moving_average
from cadenza.operators.stats import valid
from cadenza.schema import KEYS

# The bits of a quality flag.
GAP, IQR, MAD, ZSCORE = 1, 2, 4, 8
MONTH_DAYS = 30.44


def _steps(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_d", F.col(order) - F.lag(order).over(w))


def sampling(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd") -> DataFrame:
    """Median step (upper), least and largest step, share of steps beyond 1.1 medians and its complement."""
    d = _steps(df, keys, order).where("_d is not null").select(*keys, "_d")
    w = Window.partitionBy(*keys)
    d = d.withColumns({"_r": F.row_number().over(w.orderBy("_d")), "_n": F.count("*").over(w)})
    m = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("_d"))).over(w)
    d = d.withColumn("_m", m)
    a = d.groupBy(*keys).agg(F.first("_m").alias("median_step"), F.min("_d").alias("min_step"), F.max("_d").alias("max_step"), F.avg((F.col("_d") > 1.1 * F.col("_m")).cast("double")).alias("non_uniform_fraction"))
    return a.withColumn("uniform_fraction", 1 - F.col("non_uniform_fraction"))


def coverage(df: DataFrame, factor: float = 1.5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Rows expected over the span, share of them valid, and the gaps in time."""
    s = sampling(df, keys, order).select(*keys, "median_step")
    x = _steps(df, keys, order).join(s, keys)
    gap = F.when(F.col("_d") > factor * F.col("median_step"), F.col("_d"))
    a = x.groupBy(*keys).agg(
        F.min(order).alias("start_mjd"), F.max(order).alias("end_mjd"), F.count("*").alias("n"), F.count_if(valid(value)).alias("n_valid"), F.first("median_step").alias("step"),
        F.count(gap).alias("n_gaps"), F.max(gap).alias("longest_gap"), F.median(gap).alias("median_gap"),
    )
    a = a.withColumn("n_expected", F.round((F.col("end_mjd") - F.col("start_mjd")) / F.col("step")).cast("bigint") + 1)
    return a.withColumn("completeness", F.col("n_valid") / F.col("n_expected"))


def flags(df: DataFrame, window: int = 0, k_iqr: float = 1.5, k_mad: float = 3.5, k_z: float = 3.0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """The bit mask of each row: missing value, and three detectors on the residual to a centred mean (window 0: on the value)."""
    x = held_moving_average(df, window, keys, order, value).drop("filtered") if window else df.withColumn("residual", F.col(value))
    bits = F.when(~valid(value), GAP).otherwise(0)
    for bit, fn, k in ((IQR, outliers.iqr, k_iqr), (MAD, outliers.mad, k_mad), (ZSCORE, outliers.zscore, k_z)):
        x = fn(x, k, keys, "residual").withColumn(f"_b{bit}", F.when(F.col("is_outlier"), bit).otherwise(0)).drop("score", "is_outlier")
        bits = bits.bitwiseOR(F.col(f"_b{bit}"))
    return x.withColumn("qc_flag", bits).drop("residual", f"_b{IQR}", f"_b{MAD}", f"_b{ZSCORE}")


def year_month(df: DataFrame, least: float = 0.5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Valid rows of each month against what the step would give; a month below `least` is poor."""
    s = sampling(df, keys, order).select(*keys, "median_step")
    t = timestamp_from_mjd(F.col(order))
    m = df.where(valid(value)).groupBy(*keys, F.year(t).alias("year"), F.month(t).alias("month")).agg(F.count("*").alias("n"))
    return m.join(s, keys).withColumn("share", F.col("n") / (MONTH_DAYS / F.col("median_step"))).withColumn("poor", F.col("share") < least).drop("median_step")


def poor_years(df: DataFrame, least: float = 0.5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """A year with more than six poor or absent months is poor."""
    m = year_month(df, least, keys, order, value)
    return m.groupBy(*keys, "year").agg((12 - F.count("*") + F.count_if("poor")).alias("poor_months")).withColumn("poor_year", F.col("poor_months") > 6)

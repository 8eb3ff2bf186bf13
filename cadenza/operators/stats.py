"""Descriptive statistics as grouped aggregates over series keys.

NaN policy: "skip" drops NaN, "propagate" gives NaN if a series has one, "throw" fails the job. NULL is never a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.schema import KEYS, ConfigError

POLICIES = ("skip", "propagate", "throw")


def valid(value: str = "value") -> Column:
    """Neither NaN nor NULL; the flag does not matter."""
    return F.col(value).isNotNull() & ~F.isnan(value)


def with_policy(df: DataFrame, policy: str = "skip", value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """df ready for aggregates that ignore NULL."""
    if policy not in POLICIES:
        raise ConfigError(f"unknown NaN policy {policy!r}")
    if policy == "throw":
        return df.withColumn(value, F.when(F.isnan(value), F.raise_error(F.lit("NaN in series")).cast("double")).otherwise(F.col(value)))
    if policy == "propagate":
        bad = F.max(F.isnan(value).cast("int")).over(Window.partitionBy(*keys))
        return df.withColumn(value, F.when(bad == 1, F.lit(float("nan"))).otherwise(F.col(value)))
    return df.where(valid(value))


def skewness_adjusted(value: str = "value") -> Column:
    """Bias-adjusted G1 from Spark's population form; 0 for a constant series, null below three rows."""
    n = F.count(value)
    g1 = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None)).when(F.stddev_samp(value) < 2.220446049250313e-16, F.lit(0.0)).otherwise(g1)


def kurtosis_adjusted(value: str = "value") -> Column:
    """Bias-adjusted excess G2; null below four rows."""
    n = F.count(value)
    g2 = ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n < 4, F.lit(None)).when(F.stddev_samp(value) < 2.220446049250313e-16, F.lit(0.0)).otherwise(g2)


def quantile(p: float, value: str = "value") -> Column:
    """Type 7, exact."""
    if not 0 <= p <= 1:
        raise ConfigError("a quantile lies in [0, 1]")
    return F.percentile(value, F.lit(p))


def summary(df: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """One row for each series: counts, moments, order statistics. One shuffle, one more for the deviations (mad)."""
    n_all = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~valid(value)).alias("n_missing"))
    x = df.where(valid(value))
    q = F.percentile(value, F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    s = x.groupBy(*keys).agg(
        F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("stddev"),
        skewness_adjusted(value).alias("skewness"), kurtosis_adjusted(value).alias("kurtosis"), q.alias("q"),
    )
    s = s.select("*", F.col("q")[0].alias("min"), F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"), F.col("q")[3].alias("q3"), F.col("q")[4].alias("max")).drop("q")
    s = s.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1"), "cv": F.when(F.col("mean") != 0, F.col("stddev") / F.abs("mean"))})
    return n_all.join(s, keys, "left").join(mad(df, keys, value), keys, "left")


def five_number(df: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.where(valid(value)).groupBy(*keys).agg(q.alias("q")).select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def mad(df: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Median absolute deviation from the median, unscaled."""
    x = df.where(valid(value))
    m = x.groupBy(*keys).agg(F.median(value).alias("_m"))
    return x.join(m, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))


def modes(df: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """All values of the highest frequency, ascending; an empty list if every value is unique."""
    c = df.where(valid(value)).groupBy(*keys, value).count()
    top = c.groupBy(*keys).agg(F.max("count").alias("_top"))
    many = c.join(top, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when((F.col("count") == F.col("_top")) & (F.col("_top") > 1), F.col(value)))).alias("mode"))
    return many


def trimmed_mean(df: DataFrame, fraction: float, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    if not 0 <= fraction < 0.5:
        raise ConfigError("the trimmed share lies in [0, 0.5)")
    w = Window.partitionBy(*keys)
    x = df.where(valid(value)).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    cut = F.floor(F.col("_n") * fraction)
    return x.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"))


def average_rank(value: str, keys: list[str] = KEYS) -> Column:
    """Ranks with ties averaged."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(valid(x) & valid(y))


def pearson(df: DataFrame, x: str, y: str, keys: list[str] = KEYS) -> DataFrame:
    """Covariance and correlation of the complete pairs."""
    return pairs(df, x, y).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("covariance"), F.corr(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] = KEYS) -> DataFrame:
    r = pairs(df, x, y).select(*keys, average_rank(x, keys).alias("_x"), average_rank(y, keys).alias("_y"))
    return r.groupBy(*keys).agg(F.corr("_x", "_y").alias("spearman"))


def acf(df: DataFrame, max_lag: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Autocorrelation at lags 0..max_lag of the compacted series: one sort for each series, one aggregate for all lags."""
    w = Window.partitionBy(*keys)
    x = df.where(valid(value)).withColumn("_c", F.col(value) - F.avg(value).over(w))
    o = w.orderBy(order)
    x = x.select(*keys, "_c", *[F.lag("_c", k).over(o).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    s = x.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)])
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_s{k}") / F.col("_s0")).alias("acf")) for k in range(max_lag + 1)])
    return s.select(*keys, F.explode(lags).alias("_e")).select(*keys, "_e.lag", "_e.acf")


def lagged_diff(df: DataFrame, lag: int = 1, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """value minus the value `lag` rows before; the first rows drop out."""
    d = F.col(value) - F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("diff", d).where(F.col("diff").isNotNull())


def errors(df: DataFrame, observed: str, predicted: str, keys: list[str] = KEYS) -> DataFrame:
    """rmse, mae, bias (predicted - observed) and mape in percent (NaN if an observation is zero)."""
    e = F.col(predicted) - F.col(observed)
    zero = F.max((F.abs(observed) < 2.220446049250313e-16).cast("int")) == 1
    return pairs(df, observed, predicted).groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when(zero, F.lit(float("nan"))).otherwise(100 * F.avg(F.abs(e / F.nullif(F.col(observed), F.lit(0.0))))).alias("mape"),
    )


def jarque_bera(df: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Moments are 1/n sums over powers of the sample deviation; the tail of chi-square(2) is closed."""
    x = df.where(valid(value))
    n, s = F.count(value), F.stddev_samp(value)
    ratio = F.var_pop(value) / F.var_samp(value)
    g1, g2 = F.skewness(value) * F.pow(ratio, 1.5), (F.kurtosis(value) + 3) * ratio * ratio - 3
    a = x.groupBy(*keys).agg(n.alias("n"), (n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)).alias("statistic"), s.alias("_s"))
    return a.where("n >= 8").select(*keys, "n", "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


def durbin_watson(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.where(valid(value)).withColumn("_d", d).groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col(value) * F.col(value))).alias("durbin_watson"))


def ljung_box(df: DataFrame, max_lag: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    from cadenza.functions.dist import chi2_cdf_col

    n = df.where(valid(value)).groupBy(*keys).agg(F.count("*").alias("n"))
    a = acf(df, max_lag, keys, order, value).where("lag > 0").join(n, keys)
    q = a.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("statistic"))
    return q.withColumn("p_value", 1 - chi2_cdf_col(F.col("statistic"), F.lit(float(max_lag))))


def runs_test(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Runs about the upper median, values on it dropped; normal approximation."""
    w = Window.partitionBy(*keys)
    x = df.where(valid(value)).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    x = x.withColumn("_m", F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(value))).over(w)).where(F.col(value) != F.col("_m"))
    x = x.withColumn("_up", (F.col(value) > F.col("_m")).cast("int"))
    x = x.withColumn("_new", F.coalesce((F.col("_up") != F.lag("_up").over(w.orderBy(order))).cast("int"), F.lit(1)))
    a = x.groupBy(*keys).agg(F.sum("_new").alias("runs"), F.sum("_up").alias("n1"), F.sum(1 - F.col("_up")).alias("n2"))
    n, p = F.col("n1") + F.col("n2"), 2.0 * F.col("n1") * F.col("n2")
    return a.withColumn("z", (F.col("runs") - (p / n + 1)) / F.sqrt(p * (p - n) / (n * n * (n - 1))))

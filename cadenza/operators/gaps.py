"""Gap detection, expansion and filling; the median-year profile; deseasonalising."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.timefn import timestamp_from_mjd
from cadenza.operators.stats import valid
from cadenza.schema import KEYS, ConfigError


def expected_step(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd") -> DataFrame:
    """Median of the positive steps."""
    d = F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, d.alias("_d")).where("_d > 0").groupBy(*keys).agg(F.median("_d").alias("step"))


def detect(df: DataFrame, factor: float = 1.5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """One row for each gap: runs of missing values, and time jumps beyond factor steps with the number of rows missing.

    A jump before or inside a run of missing values is not counted.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.join(expected_step(df, keys, order), keys)
    x = x.withColumns({"_i": F.row_number().over(w) - 1, "_bad": (~valid(value)).cast("int"), "_prev": F.lag(order).over(w)})
    x = x.withColumn("_edge", (F.col("_bad") != F.coalesce(F.lag("_bad").over(w), F.lit(-1))).cast("int"))
    x = x.withColumn("_run", F.sum("_edge").over(w))
    runs = x.where("_bad = 1").groupBy(*keys, "_run").agg(F.min("_i").alias("start_index"), F.max("_i").alias("end_index"), F.min(order).alias("start_mjd"), F.max(order).alias("end_mjd"), F.count("*").alias("n_missing"))
    jump = F.round((F.col(order) - F.col("_prev")) / F.col("step")).cast("bigint") - 1
    jumps = x.where((F.col("_bad") == 0) & (F.col(order) - F.col("_prev") > factor * F.col("step"))).select(*keys, F.col("_i").alias("start_index"), (F.col("_i") - 1).alias("end_index"), F.col("_prev").alias("start_mjd"), F.col(order).alias("end_mjd"), jump.alias("n_missing"))
    return runs.drop("_run").unionByName(jumps.where("n_missing > 0"))


def expand(df: DataFrame, factor: float = 1.5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """df (keys, order, value) with a NaN row at each missing step of a time jump."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, order, value).join(expected_step(df, keys, order), keys).withColumn("_next", F.lead(order).over(w))
    n = F.round((F.col("_next") - F.col(order)) / F.col("step")).cast("int") - 1
    new = x.where((F.col("_next") - F.col(order) > factor * F.col("step")) & (n > 0)).withColumn("_k", F.explode(F.sequence(F.lit(1), n)))
    new = new.select(*keys, (F.col(order) + F.col("_k") * F.col("step")).alias(order), F.lit(float("nan")).alias(value))
    return df.select(*keys, order, value).unionByName(new)


def _neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    ok = F.when(valid(value), F.col(value))
    at = F.when(valid(value), F.col(order))
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({"_ok": ok, "_v0": F.last(ok, True).over(back), "_t0": F.last(at, True).over(back), "_v1": F.first(ok, True).over(ahead), "_t1": F.first(at, True).over(ahead)})


def _short(max_fill: int, keys: list[str], order: str) -> Column:
    """Whether an interior gap may be filled."""
    if not max_fill:
        return F.lit(True)
    return F.count("*").over(Window.partitionBy(*keys, "_t0", "_t1", F.col("_ok").isNull())) <= max_fill


def fill_linear(df: DataFrame, max_fill: int = 0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Interior gaps by time, edges held. Runs longer than max_fill stay NaN, except at the edges."""
    x = _neighbours(df, keys, order, value)
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(order) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    inner = F.when(_short(max_fill, keys, order), between).otherwise(F.lit(float("nan")))
    y = F.coalesce(F.col("_ok"), F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(inner))
    return x.withColumn("filled", y).select(*df.columns, "filled")


def fill_forward(df: DataFrame, max_fill: int = 0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """The last value carried on, edges held."""
    x = _neighbours(df, keys, order, value)
    inner = F.when(F.col("_v1").isNull() | _short(max_fill, keys, order), F.col("_v0")).otherwise(F.lit(float("nan")))
    return x.withColumn("filled", F.coalesce(F.col("_ok"), F.when(F.col("_v0").isNull(), F.col("_v1")).otherwise(inner))).select(*df.columns, "filled")


def fill_mean(df: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    ok = F.when(valid(value), F.col(value))
    return df.withColumn("filled", F.coalesce(ok, F.avg(ok).over(Window.partitionBy(*keys))))


def fill_spline(df: DataFrame, max_fill: int = 0, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """A cubic spline through all valid rows of a series; edges held, runs longer than max_fill stay NaN.

    Fewer than four valid rows are joined by lines. A spline needs the whole series, so a series is one group.
    """
    from cadenza.functions.numeric import cubic_spline
    from cadenza.operators.series import per_series

    def run(t: np.ndarray, x: np.ndarray) -> dict:
        ok = np.flatnonzero(~np.isnan(x))
        if not len(ok):
            return {"filled": x}
        y = cubic_spline(t[ok], x[ok])(t) if len(ok) > 3 else np.interp(t, t[ok], x[ok])
        y = np.where(np.isnan(x), y, x)
        y[: ok[0]], y[ok[-1] + 1 :] = x[ok[0]], x[ok[-1]]
        if max_fill:
            for a, b in zip(ok[:-1], ok[1:], strict=True):
                if b - a - 1 > max_fill:
                    y[a + 1 : b] = np.nan
        return {"filled": y}

    return per_series(df, run, "filled double", keys, order, value)


def fill(df: DataFrame, method: str = "linear", **kw) -> DataFrame:
    """By the name of the method: linear, forward, mean, spline, median_year or none."""
    methods = {"linear": fill_linear, "forward": fill_forward, "mean": fill_mean, "spline": fill_spline, "median_year": fill_median_year, "none": fill_none}
    if method not in methods:
        raise ConfigError(f"unknown method {method!r}")
    return methods[method](df, **kw)


def fill_none(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("filled", F.col(value))


def slot(order: str, slots_per_day: int) -> Column:
    """Rounded slot of the day; the last half slot wraps to slot 0 of the same day."""
    frac = F.col(order) - F.floor(order)
    return F.pmod(F.floor(frac * slots_per_day + 0.5).cast("int"), F.lit(slots_per_day))


def median_year(df: DataFrame, slots_per_day: int = 1, min_years: int = 5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Median for each day of the year and slot, NaN where fewer than min_years values stand."""
    if slots_per_day > 24:
        raise ConfigError("steps finer than an hour have no median year")
    doy = F.dayofyear(timestamp_from_mjd(F.floor(order).cast("double")))
    g = df.where(valid(value)).groupBy(*keys, doy.alias("doy"), slot(order, slots_per_day).alias("slot")).agg(F.median(value).alias("_m"), F.count("*").alias("n"))
    return g.withColumn("profile", F.when(F.col("n") >= min_years, F.col("_m")).otherwise(F.lit(float("nan")))).drop("_m")


def with_profile(df: DataFrame, profile: DataFrame, slots_per_day: int = 1, keys: list[str] = KEYS, order: str = "mjd") -> DataFrame:
    doy = F.dayofyear(timestamp_from_mjd(F.floor(order).cast("double")))
    return df.withColumns({"doy": doy, "slot": slot(order, slots_per_day)}).join(profile.select(*keys, "doy", "slot", "profile"), [*keys, "doy", "slot"], "left")


def fill_median_year(df: DataFrame, slots_per_day: int = 1, min_years: int = 5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Edges held, interior from the profile, NaN where the profile has none."""
    p = median_year(df, slots_per_day, min_years, keys, order, value)
    x = with_profile(_neighbours(df, keys, order, value), p, slots_per_day, keys, order)
    y = F.coalesce(F.col("_ok"), F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")), F.col("profile"), F.lit(float("nan")))
    return x.withColumn("filled", y).select(*df.columns, "filled")


def deseasonalize(df: DataFrame, method: str = "median_year", window: int = 365, slots_per_day: int = 1, min_years: int = 5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """seasonal and residual columns, by moving average, by median year, or none."""
    if method == "none":
        return df.withColumns({"seasonal": F.lit(0.0), "residual": F.col(value)})
    if method == "moving_average":
        from cadenza.operators.filters import held_moving_average

        out = held_moving_average(df, window, keys, order, value).withColumnRenamed("filtered", "seasonal")
    elif method == "median_year":
        p = median_year(df, slots_per_day, min_years, keys, order, value)
        out = with_profile(df, p, slots_per_day, keys, order).withColumnRenamed("profile", "seasonal").drop("doy", "slot")
    else:
        raise ConfigError(f"unknown method {method!r}")
    return out.withColumn("residual", F.col(value) - F.col("seasonal"))

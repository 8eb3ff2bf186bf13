"""Slices, look-ups, sets and joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.schema import KEYS, ConfigError


def time_slice(df: DataFrame, first: float, last: float, order: str = "mjd") -> DataFrame:
    """Both ends inclusive; the predicate reaches the scan."""
    if last < first:
        raise ConfigError("the slice ends before it begins")
    return df.where(F.col(order).between(first, last))


def index_slice(df: DataFrame, start: int, stop: int, keys: list[str] = KEYS, order: str = "mjd") -> DataFrame:
    """Rows start..stop-1 of each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("idx", F.row_number().over(w) - 1).where((F.col("idx") >= start) & (F.col("idx") < stop))


def merge(*parts: DataFrame) -> DataFrame:
    """Union of all rows, equal times kept, in the order of the parts at equal times by seq."""
    out = parts[0].withColumn("source_no", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source_no", F.lit(i)))
    return out


def bucket(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def nearest(left: DataFrame, right: DataFrame, tolerance: float, keys: list[str] = KEYS, order: str = "mjd", value: str = "value", how: str = "left") -> DataFrame:
    """Each left row with the right row of the same key nearest in time within the tolerance (days); ties to the later row.

    A band join: both sides fall into buckets as wide as the tolerance, the right side into its neighbours' as well, so
    the join is an equi-join on key and bucket. NULL where nothing is near, NaN where the near value is not finite.
    """
    width = max(float(tolerance), 1e-9)
    own = Window.partitionBy(*keys).orderBy(order)
    l = left.withColumns({"_id": F.row_number().over(own), "_b": bucket(F.col(order), width)})
    r = right.select(*keys, F.col(order).alias(f"near_{order}"), F.col(value).alias(f"near_{value}"), F.explode(F.array(*[bucket(F.col(order), width) + d for d in (-1, 0, 1)])).alias("_b"))
    j = l.join(r, [*keys, "_b"], how)
    d = F.abs(F.col(order) - F.col(f"near_{order}"))
    j = j.withColumn("_d", F.when(d <= tolerance, d)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_id").orderBy(F.col("_d").asc_nulls_last(), F.desc(f"near_{order}"))))
    j = j.where("_k = 1")
    if how == "inner":
        j = j.where("_d is not null")
    hit = F.col("_d").isNotNull()
    return j.withColumns({f"near_{order}": F.when(hit, F.col(f"near_{order}")), f"near_{value}": F.when(hit, F.col(f"near_{value}"))}).drop("_id", "_b", "_d", "_k")


def sync_inner(anchor: DataFrame, others: list[DataFrame], tolerance: float, order: str = "mjd") -> DataFrame:
    """Epochs of the anchor that every other channel has within the tolerance (days). One epoch may serve two anchors."""
    out = anchor
    width = max(float(tolerance), 1e-9)
    for o in others:
        if tolerance == 0:
            out = out.join(o.select(order).distinct(), order, "left_semi")
            continue
        r = o.select(F.col(order).alias("_t")).distinct().select("_t", F.explode(F.array(*[bucket(F.col("_t"), width) + d for d in (-1, 0, 1)])).alias("_b"))
        l = out.withColumn("_b", bucket(F.col(order), width))
        out = l.join(r, (l["_b"] == r["_b"]) & (F.abs(l[order] - r["_t"]) <= tolerance), "left_semi").drop("_b")
    return out


def at_time(df: DataFrame, t: float, tolerance: float, keys: list[str] = KEYS, order: str = "mjd") -> DataFrame:
    """Of each series the row nearest to t, ties to the later one. The job fails if a series has none within the tolerance."""
    d = F.abs(F.col(order) - F.lit(float(t)))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(-d, F.col(order))).alias("_r"), F.min(d).alias("_d"))
    far = F.raise_error(F.concat(F.lit(f"nothing within {tolerance} days of {t} in "), F.concat_ws("/", *keys)))
    return best.withColumn("_r", F.when(F.col("_d") <= tolerance, F.col("_r")).otherwise(far.cast(best.schema["_r"].dataType))).select(*keys, "_r.*").select(*df.columns)


def ends(df: DataFrame, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """First and last row of each series by position: times and values, missing values too."""
    at = F.struct(F.col(order), F.col(value).alias("v"))
    g = df.groupBy(*keys).agg(F.min_by(at, order).alias("a"), F.max_by(at, order).alias("b"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.col(f"a.{order}").alias(f"first_{order}"), F.col("a.v").alias(f"first_{value}"), F.col(f"b.{order}").alias(f"last_{order}"), F.col("b.v").alias(f"last_{value}"))


#: What a step appends to the name of the component that it makes.
SUFFIXES = {"deseasonalize": "_deseas", "filter": "_filtered", "fill": "_filled", "adjust": "_adj", "clean": "_clean", "difference": "_diff"}


def derived(df: DataFrame, step: str, value: str, component: str = "component") -> DataFrame:
    """The result column as a series of its own: `value` becomes value, and the component's name gets the step's suffix."""
    if step not in SUFFIXES:
        raise ConfigError(f"unknown step {step!r}")
    return df.withColumns({component: F.concat(F.col(component), F.lit(SUFFIXES[step])), "value": F.col(value)}).drop(*({value} - {"value"}))


def sync_outer(channels: list[DataFrame], tolerance: float, order: str = "mjd", range_rows: int = 1_000_000) -> DataFrame:
    """The pooled epochs, grouped greedily from each group's first epoch; a group stands at its mean.

    Epochs further apart than the tolerance cannot share a group, so islands between such gaps are walked one by one. They
    are found by range of time: inside a range by a window, and at the ranges' edges from the last epoch before each.
    """
    pool = channels[0].select(order)
    for c in channels[1:]:
        pool = pool.union(c.select(order))
    if tolerance <= 0:
        return pool.distinct()
    from cadenza.operators.ordered import with_range

    x = with_range(pool, order, "_range", range_rows)
    # a range's edges, of which there are few, tell the last epoch before it
    last, edges = None, []
    for r in sorted(x.groupBy("_range").agg(F.max(order).alias("hi")).collect()):
        edges.append((r["_range"], last))
        last = r["hi"]
    edges = pool.sparkSession.createDataFrame(edges, "_range bigint, _last double")
    w = Window.partitionBy("_range").orderBy(order)
    x = x.join(F.broadcast(edges), "_range").withColumn("_prev", F.coalesce(F.lag(order).over(w), F.col("_last")))
    x = x.withColumn("_new", F.coalesce(F.col(order) - F.col("_prev") > tolerance, F.lit(True)))
    # an island is named by its first epoch; one that crosses edges takes the name that was open at each edge
    x = x.withColumn("_run", F.last(F.when(F.col("_new"), F.col(order)), True).over(w))
    open_, names = None, []
    for r in sorted(x.groupBy("_range").agg(F.max("_run").alias("run")).collect()):
        names.append((r["_range"], open_))
        open_ = r["run"] if r["run"] is not None else open_
    names = pool.sparkSession.createDataFrame(names, "_range bigint, _open double")
    x = x.join(F.broadcast(names), "_range").select(order, F.coalesce("_run", "_open").alias("_run"))

    def walk(pdf):
        import numpy as np
        import pandas as pd

        ts = np.sort(pdf[order].to_numpy(float))
        out, i = [], 0
        while i < len(ts):
            j = int(np.searchsorted(ts, ts[i] + tolerance, side="right"))
            out.append(float(ts[i:j].mean()))
            i = j
        return pd.DataFrame({order: out})

    return x.groupBy("_run").applyInPandas(walk, f"{order} double")


def pivot_channels(df: DataFrame, channels: list[str], channel: str = "component", order: str = "mjd", value: str = "value") -> DataFrame:
    """Wide form, a column for each named channel."""
    return df.groupBy(order).pivot(channel, channels).agg(F.first(value))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population z-scores of finite values; constant columns stay as they are. One aggregate, joined back as one row."""
    s = df.agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(s))  # one row
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c)) for c in cols}
    return out.withColumns(z).select(*df.columns)


def assemble(channels: dict[str, DataFrame], tolerance: float, how: str = "inner", fill: str | None = "linear", max_fill: int = 0, z_scores: bool = False, order: str = "mjd", value: str = "value") -> DataFrame:
    """Channels (order, value) on one axis: synchronise, align each to it, fill, and standardise.

    how: "inner", epochs of the first channel that all others have within the tolerance, or "outer", all pooled epochs. A
    channel's value at an epoch is its nearest one within the tolerance, else missing; fill: "linear", "forward", "mean",
    or None, which leaves NaN.
    """
    from cadenza.operators import gaps

    if how not in ("inner", "outer"):
        raise ConfigError(f"unknown way to synchronise {how!r}")
    parts = list(channels.values())
    axis = sync_inner(parts[0].select(order), [p.select(order) for p in parts[1:]], tolerance, order) if how == "inner" else sync_outer([p.select(order) for p in parts], tolerance, order)
    out = axis.select(order).distinct()
    for name, p in channels.items():
        key = F.lit(name).alias("_c")
        one = nearest(out.select(key, order), p.select(key, order, value), tolerance, ["_c"], order, value).select("_c", order, F.coalesce(F.col(f"near_{value}"), F.lit(float("nan"))).alias(value))
        if fill == "linear":
            one = gaps.fill_linear(one, max_fill, ["_c"], order, value).drop(value).withColumnRenamed("filled", value)
        elif fill == "forward":
            one = gaps.fill_forward(one, max_fill, ["_c"], order, value).drop(value).withColumnRenamed("filled", value)
        elif fill == "mean":
            one = gaps.fill_mean(one, ["_c"], value).drop(value).withColumnRenamed("filled", value)
        elif fill is not None:
            raise ConfigError(f"unknown fill {fill!r}")
        out = out.join(one.select(order, F.col(value).alias(name)), order)
    return standardise(out, list(channels)) if z_scores else out


def ccf(df: DataFrame, x: str, y: str, max_lag: int, order: str = "mjd", range_rows: int = 1_000_000) -> DataFrame:
    """Cross-correlation of two columns at lags -max_lag..max_lag: y is shifted against x.

    Rows are numbered by ranges of the order, and the lags are one equi-join on those numbers.
    """
    from cadenza.operators.ordered import numbered

    n = numbered(df.select(order, F.col(x).alias("_x"), F.col(y).alias("_y")), order, "_i", range_rows)
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    shifted = n.select("_y", "_i", lags).select("_y", "lag", (F.col("_i") + F.col("lag")).alias("_i"))
    return n.select("_x", "_i").join(shifted, "_i").groupBy("lag").agg(F.corr("_x", "_y").alias("r"))


def variogram(df: DataFrame, max_lag: float, bins: int, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """Binned semivariances of all pairs nearer than max_lag, as a band join on buckets of that width."""
    width = max_lag / bins
    p = df.select(*keys, F.col(order).alias("t"), F.col(value).alias("z")).withColumn("_b", bucket(F.col("t"), max_lag))
    q = p.select(*keys, F.col("t").alias("t2"), F.col("z").alias("z2"), F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"))
    j = p.join(q, [*keys, "_b"]).where((F.col("t2") > F.col("t")) & (F.col("t2") - F.col("t") < max_lag))
    h, d = F.col("t2") - F.col("t"), F.col("z") - F.col("z2")
    a = j.groupBy(*keys, F.floor(h / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n_pairs"), F.avg(h).alias("lag"), (F.sum(d * d) / (2 * F.count("*"))).alias("gamma"))
    return a.where("n_pairs >= 2")

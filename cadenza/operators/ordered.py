"""Operations along one order over a whole table, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one range of the order should have at most, if the order is spread evenly.
RANGE_ROWS = 1_000_000


def with_range(df: DataFrame, order: str, to: str = "_range", range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the number of an equally wide range of the order: one task sorts a range, and ranges follow each other."""
    n, lo, hi = df.agg(F.count(order), F.min(order).cast("double"), F.max(order).cast("double")).first()
    parts = max(1, -(-n // range_rows))
    if parts == 1 or hi <= lo:
        return df.withColumn(to, F.lit(0).cast("bigint"))
    at = F.floor((F.col(order).cast("double") - lo) / F.lit((hi - lo) / parts)).cast("bigint")
    return df.withColumn(to, F.greatest(F.lit(0), F.least(at, F.lit(parts - 1))))


def numbered(df: DataFrame, order: str, to: str = "idx", range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the place of each row in the order, from 0. Ranges are counted first; a count a range comes to the driver."""
    x = with_range(df, order, "_range", range_rows)
    counts = sorted((r["_range"], r["count"]) for r in x.groupBy("_range").count().collect())
    before, rows = 0, []
    for k, c in counts:
        rows.append((k, before))
        before += c
    offsets = df.sparkSession.createDataFrame(rows, "_range bigint, _before bigint")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return x.join(F.broadcast(offsets), "_range").withColumn(to, F.col("_before") + own).drop("_range", "_before")


def with_lead(df: DataFrame, order: str, cols: list[str], step: int = 1, suffix: str = "2", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row with the cols of the row `step` places later in the order; the last rows have none and drop out."""
    x = numbered(df, order, "_i", range_rows)
    ahead = x.select((F.col("_i") - step).alias("_i"), *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return x.join(ahead, "_i").drop("_i")


def with_lags(df: DataFrame, order: str, cols: list[str], max_lag: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (cols, c__1, ..., c__max_lag for each c, _r) with the values of earlier rows, null where there is none.

    _r is the place from 1. Each lag is an equi-join on places.
    """
    x = numbered(df.select(order, *cols), order, "_i", range_rows).select("_i", *cols)
    out = x
    for k in range(1, max_lag + 1):
        out = out.join(x.select((F.col("_i") + k).alias("_i"), *[F.col(c).alias(f"{c}__{k}") for c in cols]), "_i", "left")
    return out.withColumn("_r", F.col("_i") + 1).drop("_i")

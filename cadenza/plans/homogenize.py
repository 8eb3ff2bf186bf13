"""The homogenisation of a series, end to end: fill, clean, deseasonalise, clean again, detect, adjust."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import gaps, homogeneity, outliers
from cadenza.schema import KEYS, ConfigError


@dataclass
class HomogenizeConfig:
    fill: str = "linear"
    max_fill: int = 0
    pre_outlier: str | None = "mad"
    pre_k: float = 5.0
    deseasonalize: str = "median_year"
    window: int = 365
    slots_per_day: int = 1
    min_years: int = 5
    post_outlier: str | None = "mad"
    post_k: float = 5.0
    method: str = "yao_davis"
    detector: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict) -> HomogenizeConfig:
        """Absent entries take their defaults; unknown ones are an error."""
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ConfigError(f"unknown settings: {sorted(unknown)}")
        return cls(**raw)


FILLS = {"linear": lambda df, c, k: gaps.fill_linear(df, c.max_fill, k), "forward": lambda df, c, k: gaps.fill_forward(df, c.max_fill, k), "mean": lambda df, c, k: gaps.fill_mean(df, k), "median_year": lambda df, c, k: gaps.fill_median_year(df, c.slots_per_day, c.min_years, k), "none": lambda df, c, k: gaps.fill_none(df)}


def homogenize(df: DataFrame, config: HomogenizeConfig | None = None, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(adjusted rows, change points) of the series in df (keys, mjd, value)."""
    c = config or HomogenizeConfig()
    if c.fill not in FILLS:
        raise ConfigError(f"unknown fill {c.fill!r}")
    x = gaps.expand(df.select(*keys, "mjd", "value"), keys=keys)
    x = FILLS[c.fill](x, c, keys).withColumn("original", F.col("value")).withColumn("value", F.col("filled")).drop("filled")
    if c.pre_outlier:
        x = outliers.clean(x, c.pre_outlier, c.pre_k, None, c.max_fill, keys).withColumn("value", F.col("cleaned")).drop("cleaned", "score", "is_outlier").withColumnRenamed("flag_out", "pre_flag")
    x = gaps.deseasonalize(x, c.deseasonalize, c.window, c.slots_per_day, c.min_years, keys)
    if c.post_outlier:
        r = outliers.clean(x.withColumn("_r", F.col("residual")), c.post_outlier, c.post_k, None, c.max_fill, keys, value="_r")
        x = r.withColumn("residual", F.col("cleaned")).drop("_r", "cleaned", "score", "is_outlier").withColumnRenamed("flag_out", "post_flag")
    points = homogeneity.change_points(x, c.method, keys, value="residual", **c.detector)
    return homogeneity.adjust(x, points, keys), points

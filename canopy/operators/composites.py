"""Composites of a season and covariates of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seasonal_composite(scenes: DataFrame, pixel: list[str], bands: list[str], date: str, months: list[int], cloud: str, most: float, clear: Column | None = None) -> DataFrame:
    """(pixel, bands, n_dates): the median of each band over a season's dates with few clouds; ``clear`` leaves masked pixels out.

    A pixel has one row a date, so its values are few.
    """
    seen = scenes.filter(F.month(date).isin(months) & (F.col(cloud) <= most))
    seen = seen if clear is None else seen.filter(clear)
    return seen.groupBy(*pixel).agg(*[F.percentile(b, F.lit(0.5)).alias(b) for b in bands], F.count("*").alias("n_dates"))


#: How each kind of covariate is gathered, and its units changed.
CONVERSIONS = {
    "kelvin_mean": lambda v: F.avg(v) - 273.15,
    "kelvin_min": lambda v: F.min(v) - 273.15,
    "kelvin_max": lambda v: F.max(v) - 273.15,
    "metres_sum": lambda v: F.sum(v) * 1000,
    "thousandths_mean": lambda v: F.avg(v * 1000) / 100,
}


def yearly_covariates(daily: DataFrame, keys: list[str], date: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, year, covariates); wanted: name -> (column, kind of ``CONVERSIONS``)."""
    return daily.groupBy(*keys, F.year(date).alias("year")).agg(*[CONVERSIONS[kind](F.col(column)).alias(name) for name, (column, kind) in wanted.items()])

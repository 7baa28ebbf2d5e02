"""Guards for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ratio(a: Column, b: Column, undefined: str = "zero") -> Column:
    """a / b; without a value for b = 0: 0 or null."""
    out = a.cast("double") / F.when(b != 0, b.cast("double"))
    return F.coalesce(out, F.lit(0.0)) if undefined == "zero" else out


def finite(x: Column) -> Column:
    """x, or null if it is not a number or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within limits; null and not-a-number stay."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def mean_of(columns: list[Column]) -> Column:
    """Mean of the columns that aren't null."""
    array = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(array) > 0, F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.size(array))

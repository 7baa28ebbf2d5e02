"""Features as 16-bit and 8-bit integers, and back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.numeric import INF, clip

# Ranges in which features are stored.
TOP = 65535
AMPLITUDE_RANGE = {"ndvi": (0.0, 1.0), "evi": (0.0, 1.0), "nbr": (0.0, 1.0), "crswir": (0.0, 2.5)}
OFFSET_RANGE = {"ndvi": (0.0, 1.0), "evi": (0.0, 1.0), "nbr": (0.0, 1.0), "crswir": (0.0, 2.5)}
VARIANCE_RANGE = (0.0, 2.0)
KINDS = {"amplitude_h1": "amplitude", "amplitude_h2": "amplitude", "phase_h1": "phase", "phase_h2": "phase", "offset": "offset", "var_residual": "variance"}


def scale(x: Column, low: float, high: float) -> Column:
    """Within limits, as 0..65535, cut off."""
    return ((clip(x, low, high) - low) / (high - low) * TOP).cast("int")


def unscale(x: Column, low: float, high: float) -> Column:
    return x.cast("double") / TOP * (high - low) + low


def scale_phase(phase: Column) -> Column:
    return scale(phase, -math.pi, math.pi)


def unscale_phase(x: Column, centered: bool = False) -> Column:
    """Radians from 0 to 2 pi, as models were trained with; ``centered``: from -pi to pi, as they were scaled."""
    out = x.cast("double") / TOP * (2 * math.pi)
    return out - math.pi if centered else out


def feature_range(index: str, kind: str) -> tuple[float, float]:
    if kind == "variance":
        return VARIANCE_RANGE
    ranges = {"amplitude": AMPLITUDE_RANGE, "offset": OFFSET_RANGE}
    if kind not in ranges or index not in ranges[kind]:
        raise ValueError(f"no range for {kind} of {index}")
    return ranges[kind][index]


def scale_feature(x: Column, index: str, kind: str) -> Column:
    return scale_phase(x) if kind == "phase" else scale(x, *feature_range(index, kind))


def unscale_feature(x: Column, index: str, kind: str, centered: bool = False) -> Column:
    return unscale_phase(x, centered) if kind == "phase" else unscale(x, *feature_range(index, kind))


def kind_of(feature: str) -> tuple[str, str]:
    """Index and kind of a feature name."""
    index, _, measure = feature.partition("_")
    if measure not in KINDS:
        raise ValueError(f"unknown feature: {feature}")
    return index, KINDS[measure]


def unscale_features(df: DataFrame, features: list[str], centered: bool = False) -> DataFrame:
    return df.withColumns({f: unscale_feature(F.col(f), *kind_of(f), centered) for f in features})


def circular(df: DataFrame, indices: list[str]) -> DataFrame:
    """Cosine and sine of the phases (radians) in place of them."""
    phases = [c for i in indices for c in (f"{i}_phase_h1", f"{i}_phase_h2") if c in df.columns]
    return df.withColumns({f"{c}_{n}": f(c) for c in phases for n, f in (("cos", F.cos), ("sin", F.sin))}).drop(*phases)


def rescale_uint16(values: Column, nodata: int | None, low: float = -1.0, high: float = 1.0) -> Column:
    """Array of 0..65535 to the range; nodata to null."""

    def one(x: Column) -> Column:
        out = clip(unscale(x, low, high), low, high)
        return out if nodata is None else F.when(x != nodata, out)

    return F.transform(values, one)


def to_byte(p: Column) -> Column:
    """Probability as 0..255, halves to even."""
    return F.bround(p * 255, 0).cast("int")


def first_largest(values: Column) -> Column:
    """Place of the first largest value, from 1."""
    return F.array_position(values, F.array_max(values)).cast("int")


def sanitised(values: Column) -> Column:
    """Infinite values to 0, then within -1..1, then not-a-number and null to 0."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INF), 0.0).otherwise(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))


def clipped(values: Column) -> Column:
    """Within -1..1 (infinite values too), then not-a-number and null to 0."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))


def guarded(values: Column) -> Column:
    """Infinite values and not-a-number to null, the rest within -1..1."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INF), None).otherwise(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF))

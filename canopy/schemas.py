"""Schemas of the tables, and checks of columns and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDICES = ("ndvi", "evi", "nbr", "crswir")
MEASURES = ("amplitude_h1", "amplitude_h2", "phase_h1", "phase_h2", "offset", "var_residual")
HARMONIC_FEATURES = [f"{i}_{m}" for i in INDICES for m in MEASURES]
BANDS = ("b2", "b4", "b8", "b11", "b12")
PIXEL_KEY = ["tile_id", "row", "col"]
LABELS = ("phenology", "genus", "species", "source", "year")


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_KEY = {k: T.IntegerType() for k in PIXEL_KEY}
SERIES = _struct(**_KEY, date=T.DateType(), **{b: T.IntegerType() for b in BANDS}, msk_cldprb=T.IntegerType())
HARMONICS = _struct(**_KEY, **{f: T.IntegerType() for f in HARMONIC_FEATURES})
TRAINING = T.StructType(HARMONICS.fields + _struct(**{c: T.IntegerType() for c in LABELS}, eco_region=T.StringType(), weight=T.DoubleType()).fields)
EMBEDDINGS = _struct(**_KEY, phenology=T.IntegerType(), embedding=T.ArrayType(T.FloatType()), eco_region=T.StringType(), weight=T.DoubleType())
TILES = _struct(tile_id=T.IntegerType(), perc=T.DoubleType(), NomSER=T.StringType(), effective_pixels=T.DoubleType(), xmin=T.DoubleType(), ymin=T.DoubleType(), xmax=T.DoubleType(), ymax=T.DoubleType())
PREDICTIONS = _struct(**_KEY, eco_region=T.StringType(), weight=T.DoubleType(), fold=T.IntegerType(), y_true=T.IntegerType(), y_pred=T.IntegerType(), prob_class_1=T.DoubleType(), prob_class_2=T.DoubleType())
_BAND = _struct(band=T.IntegerType(), name=T.StringType(), no_data_pct=T.DoubleType(), min=T.DoubleType(), max=T.DoubleType(), mean=T.DoubleType(), std=T.DoubleType())
QA_DOCUMENT = T.MapType(T.StringType(), T.MapType(T.StringType(), _struct(bands=T.ArrayType(_BAND))))
TILE_CONFIG = _struct(tile_idx=T.IntegerType(), spatial_id=T.StringType(), dates=T.ArrayType(T.StringType()), tif_paths=T.ArrayType(T.StringType()))


def feature_names(indices: tuple[str, ...] | list[str] = INDICES, circular: bool = True, selected: list[str] | None = None) -> list[str]:
    """Names of the harmonic features of some indices, measure by measure; circular: cosine and sine in place of a phase.

    selected: names as they are stored, each of which becomes what it is after that change.
    """
    stored = [f"{i}_{m}" for i in indices for m in MEASURES] if selected is None else selected
    return [n for f in stored for n in ((f"{f}_cos", f"{f}_sin") if circular and "_phase_" in f and not f.endswith(("_cos", "_sin")) else (f,))]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has all of the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, if no two rows share a key; this runs a job."""
    if duplicate_keys(df, keys).limit(1).count():
        raise ValueError(f"duplicate keys: {', '.join(keys)}")
    return df


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    """Names of the numeric columns that aren't excluded."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def prefixed_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns ``prefix``0, ``prefix``1, ... in the order of their numbers."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def feature_columns(df: DataFrame, meta: set[str], wanted: list[str] | None = None) -> list[str]:
    """All columns but the meta ones, or the wanted ones if all of them are there."""
    if wanted is None:
        return [c for c in df.columns if c not in meta]
    require_columns(df, wanted)
    return list(wanted)


def require_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Raise if a key is in both; this runs a job."""
    if a.select(*keys).join(b.select(*keys), keys, "left_semi").limit(1).count():
        raise ValueError(f"keys in both: {', '.join(keys)}")


def positive_targets(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is there and positive, the target as an integer."""
    return df.filter(F.col(target) > 0).withColumn(target, F.col(target).cast("int"))


def column_report(df: DataFrame, columns: list[str], limit: int = 10) -> dict[str, list | None]:
    """At most ``limit`` values of each column, or None where the column is missing (a report)."""
    return {c: sorted((r[0] for r in df.select(c).distinct().limit(limit).collect()), key=str) if c in df.columns else None for c in columns}


def band_of(labels: list[str], names: list[str], missing: str = "raise") -> dict[str, int | None]:
    """Number (from 1) of the band with each name; missing ones raise, or count as None."""
    at = {label: k + 1 for k, label in reversed(list(enumerate(labels)))}
    lost = [n for n in names if n not in at]
    if lost and missing == "raise":
        raise ValueError(f"no band for: {', '.join(lost)}")
    return {n: at.get(n) for n in names}

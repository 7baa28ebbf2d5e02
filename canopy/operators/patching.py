"""Patches of rasters for training: where they lie, and their cells as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH, STRIDE = 64, 56


def _starts(size: Column, offset: int, patch: int, stride: int) -> Column:
    last = size - patch
    return F.when(last >= offset, F.sequence(F.lit(offset).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint")))


def patch_grid(spark: SparkSession, height: int, width: int, patch: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """(row_off, col_off) of patches on a grid and at the midpoints between its corners, inside the raster."""
    both = spark.range(2).select((F.col("id") * (stride // 2)).alias("o"))
    parts = [both.filter(F.col("o") == o).select(F.explode(_starts(F.lit(height), o, patch, stride)).alias("row_off")).withColumn("col_off", F.explode(_starts(F.lit(width), o, patch, stride))) for o in (0, stride // 2)]
    return parts[0].union(parts[1]).select(F.col("row_off").cast("int").alias("row_off"), F.col("col_off").cast("int").alias("col_off"))


def features_of(columns: list[str], index: str | None = None, selected: list[str] | None = None) -> list[str]:
    """The columns of one index (``ndvi``: all that begin with ``ndvi_``), or the selected ones; those that are missing raise."""
    if (index is None) == (selected is None):
        raise ValueError("either an index or selected features")
    found = [c for c in columns if c.startswith(f"{index}_")] if index is not None else [c for c in selected if c in columns]
    if not found or selected is not None and len(found) < len(selected):
        raise ValueError(f"no features of {index}" if index is not None else f"missing: {', '.join(c for c in selected if c not in columns)}")
    return found


def patch_tensors(cells: DataFrame, by: list[str], features: list[str], label: str, patch: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """(by, row_off, col_off, pixels, label): the patches with any positive label and only finite features.

    pixels: (features, patch, patch) as one array of floats, band by band and row by row; label: (patch, patch) as integers.
    Patches lie in their raster's extent, whose first row and column are 0.  A cell finds the few patches that hold it by arithmetic, so a group is a
    patch, of a fixed size; a patch with a missing cell isn't complete and goes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    extent = cells.groupBy(*by).agg((F.max("row") + 1).alias("_height"), (F.max("col") + 1).alias("_width"))

    def holding(c: str, size: str, o: int) -> Column:
        last = F.floor((F.col(c) - o) / stride)
        first = F.greatest(F.ceil((F.col(c) - o - patch + 1) / stride), F.lit(0))
        at = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * stride + o))
        return F.filter(at, lambda a: a + patch <= F.col(size))

    met = cells.join(extent, by) if by else cells.crossJoin(F.broadcast(extent))  # one row

    def corners(o: int) -> Column:
        cols = lambda r: F.transform(holding("col", "_width", o), lambda c: F.struct(r.alias("row_off"), c.alias("col_off")))
        return F.flatten(F.transform(holding("row", "_height", o), cols))

    none = F.array().cast("array<struct<row_off:bigint,col_off:bigint>>")
    dealt = met.select(*by, "row", "col", *[F.col(f).cast("double") for f in features], F.col(label).cast("int").alias("_label"), F.inline(F.concat(*[F.coalesce(corners(o), none) for o in (0, stride // 2)])))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[[*by, "row_off", "col_off"]].iloc[:1].reset_index(drop=True)
        at = rows["row"] - rows["row_off"], rows["col"] - rows["col_off"]
        pixels, marks = np.full((len(features), patch, patch), np.nan), np.zeros((patch, patch), np.int32)
        for k, f in enumerate(features):
            pixels[k][at] = rows[f].to_numpy(dtype=np.float64, na_value=np.nan)
        marks[at] = rows["_label"].fillna(0)
        if not np.isfinite(pixels).all() or not (marks > 0).any():
            return keys.iloc[:0].assign(pixels=pd.Series(dtype=object), label=pd.Series(dtype=object))
        return keys.assign(pixels=[pixels.astype(np.float32).ravel()], label=[marks.ravel()])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["row_off long", "col_off long", "pixels array<float>", "label array<int>"])
    return dealt.groupBy(*by, "row_off", "col_off").applyInPandas(run, schema)

"""Harmonic features of whole folders of rasters: one job from dated band files to feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.names import file_date
from canopy.operators.harmonic import feature_stack
from canopy.schemas import BANDS, HARMONIC_FEATURES
from canopy.sources.rasters import register, write_rasters

#: Side of the windows that are fitted together.
WINDOW = 64


def band_series(spark: SparkSession, path: str, tile: Column | None = None, block: int = 512) -> DataFrame:
    """(tile, row, col, date, bands) of rasters b2, b4, b8, b11, b12 and cloud probability, a file a tile and date.

    The date stands in the file's name; the tile is the folder of the file unless ``tile`` makes it from ``path``.
    """
    register(spark)
    cells = spark.read.format("raster").option("block", block).load(path)
    name = [*BANDS, "msk_cldprb"]
    parts = F.split("path", "/")
    where = F.element_at(parts, -2) if tile is None else tile
    dated = cells.select(where.alias("tile"), "row", "col", file_date(F.element_at(parts, -1)).alias("date"), *[F.col(f"band_{k + 1}").cast("int").alias(n) for k, n in enumerate(name)])
    return dated.filter("tile is not null and date is not null")


def write_features(spark: SparkSession, path: str, out: str, tile: Column | None = None, block: int = 512, max_iter: int = 10) -> None:
    """The 24 stored features of each pixel as 16-bit files by windows; pixels without a fit hold 0."""
    series = band_series(spark, path, tile, block).withColumns({"_r": F.floor(F.col("row") / WINDOW), "_c": F.floor(F.col("col") / WINDOW)})
    stack = feature_stack(series, ["tile", "_r", "_c"], ["row", "col"], max_iter=max_iter)
    write_rasters(stack, "tile", HARMONIC_FEATURES, out, block, "uint16")

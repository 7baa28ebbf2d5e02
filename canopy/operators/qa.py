"""Quality summaries of bands and documents about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import INF, ratio
from canopy.operators.stats import unpivoted

# Fixed value: divisor of the mean cloud band that gives percent.
CLOUD_SCALE = 2185


def band_stats(df: DataFrame, keys: list[str], bands: list[str], nodata: float = 0, scale: float = 65535) -> DataFrame:
    """(keys, feature, total, no_data_pct, min, max, mean, std, and the same by ``scale``) of each band, computed in double.

    A band without data has 100 percent and nulls.
    """
    ok = F.when(F.col("value") != nodata, F.col("value"))
    out = unpivoted(df, keys, bands).groupBy(*keys, "feature").agg(F.count("*").alias("total"), F.count(ok).alias("_n"), F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"))
    scaled = {f"{c}_scaled": F.col(c) / scale for c in ("min", "max", "mean", "std")}
    return out.withColumn("no_data_pct", 100 * (1 - ratio(F.col("_n"), F.col("total")))).withColumns(scaled).drop("_n")


def flattened(documents: DataFrame, column: str = "document") -> DataFrame:
    """(date, file, band, name, no_data_pct, mean) of nested documents: date -> file -> bands."""
    dates = documents.select(F.explode(column).alias("date", "files"))
    files = dates.select("date", F.explode("files").alias("file", "content"))
    return files.select("date", "file", F.explode("content.bands").alias("b")).select("date", "file", "b.band", "b.name", "b.no_data_pct", "b.mean")


def mosaic_rollup(bands: DataFrame, tile: str = "tile", file: str = "file") -> DataFrame:
    """(tile, no_data_pct, cloud_pct): means over files of the first five bands' no-data and of the sixth band's cloud."""
    per_file = bands.groupBy(tile, file).agg(F.avg(F.when(F.col("band") <= 5, F.col("no_data_pct"))).alias("nd"), F.avg(F.when(F.col("band") == 6, F.col("mean"))).alias("cloud"))
    return per_file.groupBy(tile).agg(F.avg("nd").alias("no_data_pct"), (F.avg("cloud") / CLOUD_SCALE * 100).alias("cloud_pct"))


def nodata_difference(features: DataFrame, mosaics: DataFrame, tile: str = "tile") -> DataFrame:
    """Features (tile, name, no_data_pct) minus the tile's mosaic."""
    return features.join(mosaics.select(tile, F.col("no_data_pct").alias("mosaic_pct")), tile).withColumn("difference", F.col("no_data_pct") - F.col("mosaic_pct"))


def cloud_bin(percent: Column) -> Column:
    """Right-closed bins; outside of them null."""
    out = F.when(F.lit(False), "")
    for low, high in ((0, 5), (5, 10), (10, 20), (20, 100)):
        out = out.when((percent > low) & (percent <= high), f"({low}, {high}]")
    return out


def report(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """(group, n, mean, max, worst, above): with the key of the largest value (ties: smallest key), and whether the mean is above the overall one."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("worst"), F.sum(value).alias("_s"))
    all_rows = Window.partitionBy(F.lit(1))
    return out.withColumn("above", F.col("mean") > F.sum("_s").over(all_rows) / F.sum("n").over(all_rows)).drop("_s")


def vector_scan(df: DataFrame, vector: str) -> DataFrame:
    """(band, total, non_finite, outside, min, max) of each component; outside: finite and beyond -1..1."""
    x = F.col("x")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == INF)
    ok = F.when(~bad, x)
    return df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("band", "x")).groupBy("band").agg(F.count("*").alias("total"), F.count_if(bad).alias("non_finite"), F.count_if(F.abs(ok) > 1).alias("outside"), F.min(ok).alias("min"), F.max(ok).alias("max"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, new ones in place of old ones."""
    return old.join(new, key, "left_anti").unionByName(new)

"""Folds, weights and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import ratio


def balanced_folds(df: DataFrame, region: str, tile: str, k: int = 5, seed: int = 42, order: Column | None = None) -> DataFrame:
    """(region, tile, fold): whole tiles in k folds of nearly equal size in each region, in seeded hash order.

    Tiles of several regions go with the one that holds most of their rows (then the smallest name).
    """
    own = main_region(df, region, tile)
    by = Window.partitionBy(region).orderBy(F.xxhash64(F.lit(seed), tile) if order is None else order, tile)
    return own.withColumn("fold", F.ntile(k).over(by))


def main_region(df: DataFrame, region: str, tile: str, unknown: str = "Unknown") -> DataFrame:
    """(tile, region) by most rows, ties to the smallest name; rows without a region count as unknown."""
    counts = df.groupBy(tile, F.coalesce(F.col(region), F.lit(unknown)).alias(region)).agg(F.count("*").alias("n"))
    return counts.groupBy(tile).agg(F.min_by(region, F.struct(-F.col("n"), region)).alias(region))


def with_folds(df: DataFrame, folds: DataFrame, tile: str) -> DataFrame:
    return df.join(folds.select(tile, "fold"), tile)


def fold_distribution(df: DataFrame, k: int = 5, region: str = "eco_region") -> DataFrame:
    """Training, validation and all rows of each region in each fold, their shares and ratio.

    Regions without training rows in a fold are left out there; the ratio to no validation rows, which is infinite, is null.
    """
    folds = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("f"))
    counts = df.groupBy(region, "fold").agg(F.count("*").alias("n"))
    per = counts.crossJoin(F.broadcast(folds)).groupBy("f", region).agg(F.sum(F.when(F.col("fold") == F.col("f"), F.col("n")).otherwise(0)).alias("val"), F.sum(F.when(F.col("fold") != F.col("f"), F.col("n")).otherwise(0)).alias("train"))
    over = Window.partitionBy("f")
    shares = [(100 * ratio(F.col(c), F.sum(c).over(over))).alias(f"{c}_pct") for c in ("train", "val")]
    return per.select(F.col("f").alias("fold"), region, "train", "val", (F.col("train") + F.col("val")).alias("total"), *shares, ratio(F.col("train"), F.col("val"), "null").alias("train_val_ratio")).filter("train > 0")


def area_weights(df: DataFrame, areas: DataFrame, region: str, missing: str = "zero") -> DataFrame:
    """(region, n, raw, weight): share of area by share of rows; weights of all rows sum to their number.

    areas: (region, area).  missing: "zero" gives rows of unknown regions 0 and rows without a region null;
    "one" gives both 1 before they are normalised.
    """
    counts = df.groupBy(region).agg(F.count("*").alias("n")).join(areas, region, "left")
    all_rows, all_area = (F.sum(c).over(Window.partitionBy(F.lit(1))) for c in ("n", "area"))
    share = ratio(F.col("area"), all_area, "null") / ratio(F.col("n"), all_rows, "null")
    raw = F.coalesce(share, F.lit(1.0)) if missing == "one" else F.when(F.col(region).isNotNull(), F.coalesce(share, F.lit(0.0)))
    out = counts.withColumn("raw", raw)
    total = F.sum(F.col("raw") * F.col("n")).over(Window.partitionBy(F.lit(1)))
    rows = F.sum(F.when(F.col("raw").isNotNull(), F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return out.select(region, "n", "raw", (F.col("raw") * ratio(rows, total, "null")).alias("weight"))


def sample_by(df: DataFrame, group: list[str], key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, by seeded hash of the key; a sampling operator."""
    order = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def stratified_split(df: DataFrame, strata: list[str], key: list[str], share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: train for about ``share`` of each stratum, test for the rest; lone rows train."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    size = F.count("*").over(Window.partitionBy(*strata))
    train = F.greatest(F.lit(1), F.round(size * share).cast("long"))
    return df.withColumn("part", F.when(F.row_number().over(order) <= train, "train").otherwise("test"))


def split_with_fallbacks(df: DataFrame, strata: list[str], key: list[str], share: float, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """``stratified_split`` by as many of the strata, from the left, as can be had, and which these were.

    Strata can be had if each has two rows and both parts have at least as many rows as there are strata; this runs jobs.
    Without strata the hash of the key decides each row by itself.
    """
    for k in range(len(strata), 0, -1):
        used = strata[:k]
        r = df.groupBy(*used).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
        if r.groups and r.least >= 2 and min(share, 1 - share) * r.rows >= r.groups:
            return stratified_split(df, used, key, share, seed), used
    place = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 32)) / float(1 << 32)
    return df.withColumn("part", F.when(place < share, "train").otherwise("test")), []


def fold_splits(assigned: DataFrame, tile: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, tile, part): each tile validates in its own fold and trains in the others.

    A fold without tiles of its own borrows one, the first in seeded hash order; it doesn't train there.
    """
    folds = assigned.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("_f"))
    lone = folds.join(F.broadcast(assigned.select(F.col("fold").alias("_f")).distinct()), "_f", "left_anti")
    order = F.struct(F.xxhash64(F.lit(seed), "_f", tile), tile)
    rows = assigned.select(tile, "fold").crossJoin(F.broadcast(folds))  # k folds
    borrowed = rows.join(F.broadcast(lone), "_f").groupBy("_f").agg(F.min_by(tile, order).alias("_borrowed"))
    out = rows.join(F.broadcast(borrowed), "_f", "left")
    own = (F.col("fold") == F.col("_f")) | F.coalesce(F.col(tile) == F.col("_borrowed"), F.lit(False))
    return out.select(F.col("_f").alias("fold"), tile, F.when(own, "val").otherwise("train").alias("part"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): all rows by rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", ratio(F.sum("n").over(Window.partitionBy(F.lit(1))), F.col("n")))

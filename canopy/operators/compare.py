"""Comparison of two class maps by block and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.numeric import ratio
from canopy.operators.classification import agreement, binary_metrics
from canopy.operators.raster import block_of, centre_mode

COUNTS = ("tn", "fp", "fn", "tp")


def compare_blocks(cells: DataFrame, block: int, custom: str = "custom", reference: str = "ref", region: str = "eco", nodata: int = 255, legacy: bool = False) -> DataFrame:
    """Counts of each block: comparable cells, forest in either or both maps with percentages, and the 2 x 2 classes.

    Cells count that lie in a region and have data in both maps.  legacy: cells of no forest in both maps count even
    where they aren't comparable, so percentages may exceed 100.  Rows of the 2 x 2 counts are the custom map.
    """
    valid = (F.col(region) >= 1) & (F.col(custom) != nodata) & (F.col(reference) != nodata)
    a, b = F.col(custom).isin(1, 2) & valid, F.col(reference).isin(1, 2) & valid
    neither = ~a & ~b if legacy else ~a & ~b & valid
    both = lambda x, y: F.count_if(a & b & (F.col(custom) == x) & (F.col(reference) == y))
    counts = {
        "total_comparable_pixels": F.count_if(valid), "count_custom_only_forest": F.count_if(a & ~b), "count_ref_only_forest": F.count_if(b & ~a),
        "count_both_forest": F.count_if(a & b), "count_both_nonforest": F.count_if(neither), "tn": both(1, 1), "fp": both(1, 2), "fn": both(2, 1), "tp": both(2, 2),
    }
    out = cells.groupBy(block_of(F.col("row"), block).alias("row_off"), block_of(F.col("col"), block).alias("col_off")).agg(*[c.alias(n) for n, c in counts.items()])
    parts = ("custom_only_forest", "ref_only_forest", "both_forest", "both_nonforest")
    return out.withColumns({f"perc_{p}": 100 * ratio(F.col(f"count_{p}"), F.col("total_comparable_pixels"), "null") for p in parts})


def with_metrics(counts: DataFrame, undefined: str = "zero") -> DataFrame:
    """Agreement and class metrics; in maps, rows are the map and columns the reference."""
    bundle = binary_metrics(undefined)
    wanted = ("precision_deciduous", "recall_deciduous", "f1_deciduous", "precision_evergreen", "recall_evergreen", "f1_evergreen", "f1_macro")
    return counts.withColumns(agreement(undefined) | {k: bundle[k] for k in wanted})


def block_regions(blocks: DataFrame, cells: DataFrame, block: int, region: str = "eco") -> DataFrame:
    """Blocks with the region around their centre."""
    centres = blocks.select((F.col("row_off") + block // 2).alias("row"), (F.col("col_off") + block // 2).alias("col"))
    found = centre_mode(cells, centres, region).select((F.col("row") - block // 2).alias("row_off"), (F.col("col") - block // 2).alias("col_off"), F.col("v").alias("eco_id"))
    return blocks.join(found, ["row_off", "col_off"], "left")


def compare_regions(blocks: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """National and regional metrics of blocks (eco_id, tn, fp, fn, tp) in one pass; region 0 counts nationally only."""
    out = blocks.groupingSets([[], [F.col("eco_id")]], F.col("eco_id")).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("eco_id").alias("_all"))
    out = out.filter("_all = 1 or eco_id > 0").withColumn("total_pixels", sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])))
    name = F.concat(F.lit("eco_"), F.col("eco_id").cast("string"))
    if names:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("eco_id").cast("int")], name)
    return with_metrics(out.withColumn("eco_region", F.when(F.col("_all") == 1, "national").otherwise(name)).drop("_all", "eco_id"), "null")


def weighted_overall(regions: DataFrame) -> DataFrame:
    """Accuracy and kappa over regions, by their pixels."""
    n = F.sum("total_pixels")
    return regions.filter("eco_region <> 'national'").agg(n.alias("pixels"), *[ratio(F.sum(F.col(c) * F.col("total_pixels")), n, "null").alias(c) for c in ("overall_accuracy", "kappa")])

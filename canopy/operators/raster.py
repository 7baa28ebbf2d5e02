"""Rasters as tables of cells (tile, row, col, value), and kernels on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import ratio
from canopy.operators import blocks
from canopy.operators.lineage import cut
from canopy.operators.quantiles import with_quantiles
from canopy.operators.scanline import burnt


#: Side of the blocks in which neighbouring cells meet.
EDGE_BLOCK = 512


def windows(spark: SparkSession, height: int, width: int, block: int) -> DataFrame:
    """(row_off, col_off, height, width) of blocks in row order; the last ones are cut."""
    rows = spark.range(0, height, block).select(F.col("id").alias("row_off"))
    out = rows.select("row_off", F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(block))).alias("col_off"))
    return out.select("row_off", "col_off", F.least(F.lit(block), height - F.col("row_off")).alias("height"), F.least(F.lit(block), width - F.col("col_off")).alias("width"))


def block_of(cell: Column, block: int) -> Column:
    return F.floor(cell / block) * block


def cell_index(x: Column, origin: float, size: float) -> Column:
    """Index of the cell that a coordinate lies in."""
    return F.floor((x - origin) / size)


def snapped(low: Column, high: Column, origin: float, size: float) -> tuple[Column, Column]:
    """Offset and length of the window that bounds cover, the length rounded half up."""
    off = F.floor((low - origin) / size)
    return off, F.floor((high - low) / size + 0.5)


def edge_density(cells: DataFrame, by: list[str], value: str = "value", size: float = 10.0) -> DataFrame:
    """(by, valid, edges, area_km2, edge_density): changes between valid neighbours in metres by km2; without any, null.

    Cells are dealt by blocks, once, and each meets the one before it in its row and in its column there; the first row
    and column of the next blocks are dealt to a block too.
    """
    row, col = F.col("row"), F.col("col")
    at = [F.floor(row / EDGE_BLOCK), F.floor(col / EDGE_BLOCK)]
    block = lambda r, c: F.struct(r.alias("_r"), c.alias("_c"))
    more = [F.when(row % EDGE_BLOCK == 0, block(at[0] - 1, at[1])), F.when(col % EDGE_BLOCK == 0, block(at[0], at[1] - 1))]
    blocks = F.filter(F.array(block(*at), *more), lambda b: b.isNotNull())
    dealt = cells.filter(F.col(value) > 0).select(*by, "row", "col", F.col(value).alias("v"), F.inline(blocks)).repartition(*by, "_r", "_c")
    own = (at[0] == F.col("_r")) & (at[1] == F.col("_c"))
    changes = []
    for line, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(*by, "_r", "_c", line).orderBy(along)
        beside = (F.lag(along).over(w) == F.col(along) - 1) & F.lag(own).over(w)
        changes.append((beside & (F.lag("v").over(w) != F.col("v"))).alias(f"_{line}"))
    edges = dealt.select(*by, *changes).groupBy(*by).agg((F.count_if("_row") + F.count_if("_col")).alias("edges"))
    counts = cells.groupBy(*by).agg(F.count_if(F.col(value) > 0).alias("valid"))
    out = (counts.join(edges, by, "left") if by else counts.crossJoin(F.broadcast(edges))).fillna(0, ["edges"])
    area = F.col("valid") * (size * size / 1e6)
    return out.select(*by, "valid", "edges", area.alias("area_km2"), ratio(F.col("edges") * size, area, "null").alias("edge_density"))


def patches(cells: DataFrame, by: list[str], classes: tuple[int, ...] = (1, 2), value: str = "value", size: float = 10.0, side: int = blocks.SIDE) -> DataFrame:
    """(by, class, patches, per_100km2): 8-connected patches of each class in each raster of any size, by km2 of valid cells."""
    found = blocks.component_counts(cells, by, classes, value, side)
    density = ratio(F.col("components") * 100.0, F.col("valid") * (size * size / 1e6), "null")
    return found.select(*by, "class", F.col("components").alias("patches"), density.alias("per_100km2"))


def median_filter(cells: DataFrame, by: list[str], value: str = "value", size: int = 3, side: int = blocks.SIDE) -> DataFrame:
    """Median of each cell's neighbourhood (edges repeat); no-forest cells stay, and so do cells whose median is 0."""
    border = size // 2

    def kernel(wide: np.ndarray) -> tuple[np.ndarray]:
        near = np.lib.stride_tricks.sliding_window_view(wide, (size, size))
        grid = near[..., border, border]
        middle = np.sort(near.reshape(*grid.shape, -1), axis=-1)[..., size * size // 2]
        return (np.where((grid > 0) & (middle > 0), middle, grid),)

    return blocks.by_block(cells, by, [value], "value int", kernel, border, "edge", side)


def gaussian(wide: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Smoothing by a kernel, one way after the other; the result is narrower by the kernel's reach on each side."""
    for axis in (0, 1):
        wide = np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis) @ kernel
    return wide


def gaussian_soft_labels(
    cells: DataFrame, by: list[str], height: str, deciduous: str, evergreen: str, least: float = 5.0, sigma: float = 1.5, scale: float = 255.0, truncate: float = 4.0, side: int = blocks.SIDE
) -> DataFrame:
    """Probabilities of no forest, deciduous and evergreen from canopy height smoothed to a forest probability; rasters are mirrored at their edges."""
    border = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-border, border + 1) / sigma) ** 2)
    weights /= weights.sum()

    def kernel(h: np.ndarray, d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        forest = np.clip(gaussian((np.nan_to_num(h.astype(float)) >= least).astype(float), weights), 0, 1)
        inner = (slice(border, -border or None),) * 2
        return 1 - forest, np.clip(d[inner] / scale * forest, 0, 1), np.clip(e[inner] / scale * forest, 0, 1)

    return blocks.by_block(cells, by, [height, deciduous, evergreen], "p_nonforest double, p_deciduous double, p_evergreen double", kernel, border, "symmetric", side)


def centre_mode(cells: DataFrame, centres: DataFrame, value: str) -> DataFrame:
    """centres (row, col) with the most frequent positive value of the 3x3 cells around; none: 0, ties: the smallest."""
    near = F.inline(F.array(*[F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = centres.select(F.col("row"), F.col("col"), near)
    found = around.join(cells.filter(F.col(value) > 0).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v")), ["r", "c"])
    mode = found.groupBy("row", "col", "v").agg(F.count("*").alias("n")).groupBy("row", "col").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return centres.join(mode, ["row", "col"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def rasterised(cells: DataFrame, polygons: DataFrame, value: str, order: str, size: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), background: int = 0) -> DataFrame:
    """(row, col, value): the polygon (ring, value, order) whose inside holds the cell's centre; later polygons win; none: background."""
    return burnt(cells.select("row", "col"), polygons, {"value": value}, [order], size, origin, background)


def touched(cells: DataFrame, polygons: DataFrame, x: Column, y: Column, size: float, all_touched: bool = True) -> DataFrame:
    """(row, col, value): 1 for cells that a polygon (ring) touches, or whose centre one holds, else 0.

    A cell is touched if a side of a polygon meets its square, the border included, or if its centre lies inside.
    """
    from canopy.operators.geo import _edges, bounds, box_join, contains

    half = size / 2
    points = cells.select("row", "col", x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    boxes = polygons.select("ring").withColumns({k: v + (half if k.endswith("max") else -half) for k, v in bounds(F.col("ring")).items()})
    near = box_join(points, boxes, "_x", "_y", size * 16, closed=True)
    cx, cy = F.col("_x"), F.col("_y")

    def meets(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        overlap = (F.least(e["x1"], e["x2"]) <= cx + half) & (F.greatest(e["x1"], e["x2"]) >= cx - half) & (F.least(e["y1"], e["y2"]) <= cy + half) & (F.greatest(e["y1"], e["y2"]) >= cy - half)
        return overlap & (F.abs(dx * (cy - e["y1"]) - dy * (cx - e["x1"])) <= half * (F.abs(dx) + F.abs(dy)))

    hit = contains(F.col("ring"), cx, cy)
    hit = hit | F.exists(_edges(F.col("ring")), meets) if all_touched else hit
    found = near.filter(hit).select("row", "col").distinct().withColumn("value", F.lit(1))
    return cells.select("row", "col").join(found, ["row", "col"], "left").fillna(0, ["value"])


def sampled_statistics(pixels: DataFrame, tile: str, key: list[str], columns: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population deviation of each column over at most n pixels of each tile (a sampling operator)."""
    order = Window.partitionBy(tile).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    some = pixels.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return some.agg(*[f.alias(a) for c in columns for a, f in ((f"{c}_mean", F.coalesce(F.avg(c), F.lit(0.0))), (f"{c}_std", F.coalesce(F.stddev_pop(c), F.lit(1.0))))])


def zonal(pixels: DataFrame, zone: list[str], value: str) -> DataFrame:
    """Mean, least, largest, deviation, 90th percentile and mode (ties: smallest) of each zone."""
    mode = pixels.groupBy(*zone, value).agg(F.count("*").alias("n")).groupBy(*zone).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"))
    stats = pixels.groupBy(*zone).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))
    return with_quantiles(stats.join(mode, zone), pixels, zone, value, {"p90": 0.9})


def km2(cells: Column, size: float = 10.0) -> Column:
    return cells * (size * size / 1e6)


def labelled_pixels(cells: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(row, col, label, columns) of the cells whose label isn't 0 or missing."""
    return cells.filter(F.col(label).isNotNull() & (F.col(label) != 0)).select("row", "col", F.col(label).cast("int").alias(label), *columns)


def same_grid(a: str, b: str, tolerance: float = 1e-6) -> Column:
    """Whether two grids (structs: crs, x0, y0, size_x, size_y, height, width) have the same cells; false if a field is null."""
    equal = [F.col(f"{a}.{f}") == F.col(f"{b}.{f}") for f in ("crs", "height", "width")]
    near = [F.abs(F.col(f"{a}.{f}") - F.col(f"{b}.{f}")) < tolerance for f in ("x0", "y0", "size_x", "size_y")]
    out = F.lit(True)
    for c in (*equal, *near):
        out = out & F.coalesce(c, F.lit(False))
    return out


def first_band(rasters: DataFrame, bands: str = "bands", wanted: int = 2) -> DataFrame:
    """Rasters (path, bands: array) with exactly ``wanted`` bands, and the first of them; others are skipped."""
    return rasters.filter(F.size(bands) == wanted).withColumn("band", F.col(bands)[0]).drop(bands)


def resampled(cells: DataFrame, source: DataFrame, value: str, size: float, source_size: float, origin: tuple[float, float] = (0.0, 0.0), fill: int | None = None) -> DataFrame:
    """Cells (row, col, ...) with the value of the source cell in which their centre lies; both grids share axes.

    size, source_size: widths of their cells; origin: x and y of the source's first corner from that of the cells.
    Nearest resampling is index arithmetic, so the grids meet in one equi-join.  Cells outside the source get ``fill``.
    """
    at = lambda c, o: F.floor(((F.col(c) + 0.5) * size - o) / source_size)
    placed = cells.withColumns({"_r": at("row", origin[1]), "_c": at("col", origin[0])})
    found = source.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).alias(f"_{value}"))
    return placed.join(found, ["_r", "_c"], "left").withColumn(value, F.coalesce(f"_{value}", F.lit(fill))).drop("_r", "_c", f"_{value}")


def placed_in_block(block: DataFrame, mask: DataFrame, value: str, row_off: int, col_off: int, background: int = 0) -> DataFrame:
    """A block's cells (row, col from its own corner) with a mask's value where the mask, on the whole raster's grid, covers them."""
    found = mask.select((F.col("row") - row_off).alias("row"), (F.col("col") - col_off).alias("col"), F.col(value).alias("_value"))
    return block.join(found, ["row", "col"], "left").withColumn(value, F.coalesce("_value", F.lit(background))).drop("_value")


def cropped(cells: DataFrame, box: tuple[float, float, float, float], size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The cells that a box (xmin, ymin, xmax, ymax) touches, with rows and columns from its corner."""
    low = [int(np.floor((box[k] - origin[k]) / size)) for k in (0, 1)]
    high = [int(np.ceil((box[k + 2] - origin[k]) / size)) for k in (0, 1)]
    inside = F.col("col").between(low[0], high[0] - 1) & F.col("row").between(low[1], high[1] - 1)
    return cells.filter(inside).withColumns({"row": F.col("row") - low[1], "col": F.col("col") - low[0]})


def training_tile(features: DataFrame, polygons: DataFrame, attributes: list[str], order: str, size: float = 10.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Feature cells (row, col, ...) with one band for each attribute of the polygons (ring, attributes, order), all burnt in one pass; 0 where there is none."""
    return burnt(features, polygons, {a: a for a in attributes}, [order], size, origin)


def valid_patches(cells: DataFrame, patches: DataFrame, label: str, features: list[str], patch: int = 64) -> DataFrame:
    """Patches (row_off, col_off) with any positive label and only finite features; n: their cells."""
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / patch) * patch - patch, F.floor(F.col(c) / patch) * patch, F.lit(patch)))
    placed = cells.withColumn("_r", near("row")).withColumn("_c", near("col"))  # a patch that holds a cell begins in one of four blocks
    blocks = patches.withColumns({"_r": F.floor(F.col("row_off") / patch) * patch, "_c": F.floor(F.col("col_off") / patch) * patch})
    inside = [(F.col(c) >= F.col(o)) & (F.col(c) < F.col(o) + patch) for c, o in (("row", "row_off"), ("col", "col_off"))]
    finite = F.lit(True)
    for f in features:
        finite = finite & F.coalesce(F.abs(F.col(f).cast("double")) < float("inf"), F.lit(False))
    held = placed.join(blocks, ["_r", "_c"]).filter(inside[0] & inside[1]).groupBy("row_off", "col_off")
    found = held.agg(F.count("*").alias("n"), F.max(F.col(label) > 0).alias("_any"), F.min(finite).alias("_finite"))
    return found.filter(F.col("_any") & F.col("_finite")).select("row_off", "col_off", "n")


def coherence(cells: DataFrame, by: list[str], value: str = "value", size: float = 10.0, side: int = blocks.SIDE) -> DataFrame:
    """(by, area_km2, edge_density, forest_fraction, patches and their density in all and of each class) of each tile.

    Densities are by 100 km2; without valid cells all but the fraction are null.
    """
    edges = edge_density(cells, by, value, size)
    fraction = cells.groupBy(*by).agg((F.count_if(F.col(value) > 0) / F.count("*")).alias("forest_fraction"))
    found = patches(cells, by, (1, 2), value, size, side)
    valid = F.col("valid") > 0
    counts = found.groupBy(*by).agg(F.sum("patches").alias("total"), *[F.max(F.when(F.col("class") == k, F.col("patches"))).alias(n) for k, n in ((1, "deciduous"), (2, "evergreen"))])
    out = edges.join(fraction, by).join(counts, by)
    columns = []
    for name in ("total", "deciduous", "evergreen"):
        columns += [F.when(valid, F.col(name)).alias(f"patch_count_{name}"), F.when(valid, F.col(name) * 100 / F.col("area_km2")).alias(f"patch_density_{name}")]
    return out.select(*by, F.when(valid, F.col("area_km2")).alias("area_km2"), "edge_density", "forest_fraction", *columns)


def coherence_variants(first: DataFrame, second: DataFrame, by: list[str], names: tuple[str, str] = ("embedding", "harmonic"), size: float = 10.0, side: int = blocks.SIDE) -> DataFrame:
    """The coherence of two maps and of the second one smoothed by a 3 x 3 median, one row each with its ``variant``."""
    smoothed = cut(median_filter(second, by, side=side))  # edges, fraction and patches all read it
    parts = [coherence(m, by, size=size, side=side).withColumn("variant", F.lit(n)) for m, n in ((first, names[0]), (second, names[1]), (smoothed, f"{names[1]}_median"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

"""Points, boxes and polygons without a geometry library: joins by grid cells with an exact residual."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.lineage import cut, release

#: Picks of so many regions may be broadcast (five numbers each).
BROADCAST_REGIONS = 100_000
# Fixed value: one pixel of 10 m covers so many square metres.
PIXEL_AREA = 100.0


def _edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of each side of a ring, which need not repeat its first point."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def effective_pixels(ring: Column) -> Column:
    return area(ring) / PIXEL_AREA


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of a ring with an area."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]

    def moment(axis: str) -> Column:
        return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e[f"{axis}1"] + e[f"{axis}2"]) * cross(e))

    sums = moment("x"), moment("y")
    return sums[0] / (6 * signed_area(ring)), sums[1] / (6 * signed_area(ring))


def bounds(ring: Column) -> dict[str, Column]:
    get = lambda a, f: f(F.transform(ring, lambda p: p[a]))
    return {"xmin": get("x", F.array_min), "ymin": get("y", F.array_min), "xmax": get("x", F.array_max), "ymax": get("y", F.array_max)}


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.aggregate(_edges(ring), F.lit(False), lambda odd, e: F.when(F.coalesce(crosses(e), F.lit(False)), ~odd).otherwise(odd))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def box_join(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """Points with the boxes (xmin, ymin, xmax, ymax) that hold them (half open, or closed), by an equi-join on grid cells."""
    tiled = boxes.withColumn("_cx", F.explode(_cells(F.col("xmin"), F.col("xmax"), cell))).withColumn("_cy", F.explode(_cells(F.col("ymin"), F.col("ymax"), cell)))
    placed = points.withColumns({"_px": F.floor(F.col(x) / cell), "_py": F.floor(F.col(y) / cell)})
    px, py = F.col(x), F.col(y)
    inside = (px >= F.col("xmin")) & (py >= F.col("ymin")) & ((px <= F.col("xmax")) & (py <= F.col("ymax")) if closed else (px < F.col("xmax")) & (py < F.col("ymax")))
    return placed.join(tiled, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & inside, how).drop("_px", "_py", "_cx", "_cy")


def box_sums(points: DataFrame, boxes: DataFrame, key: str, x: str, y: str, cell: float, value: str) -> DataFrame:
    """(key, points, sum) of the boxes (key, xmin, ymin, xmax, ymax; half open) that hold points: how many, and the sum of their values.

    Points at one place and boxes of one extent meet once, so the work grows with the different ones and not with all pairs.
    """
    sides = ["xmin", "ymin", "xmax", "ymax"]
    places = points.groupBy(x, y).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    found = box_join(places, boxes.select(*sides).distinct(), x, y, cell).groupBy(*sides).agg(F.sum("_n").alias("points"), F.sum("_sum").alias("sum"))
    return boxes.select(key, *sides).join(found, sides).groupBy(key).agg(F.sum("points").alias("points"), F.sum("sum").alias("sum"))


def within_join(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float, how: str = "inner") -> DataFrame:
    """Points with the polygons (ring) that hold them."""
    tiled = polygons.withColumns(bounds(F.col("ring")))
    tiled = tiled.withColumn("_cx", F.explode(_cells(F.col("xmin"), F.col("xmax"), cell))).withColumn("_cy", F.explode(_cells(F.col("ymin"), F.col("ymax"), cell)))
    placed = points.withColumns({"_px": F.floor(F.col(x) / cell), "_py": F.floor(F.col(y) / cell)})
    px, py = F.col(x), F.col(y)
    boxed = (px >= F.col("xmin")) & (px <= F.col("xmax")) & (py >= F.col("ymin")) & (py <= F.col("ymax"))
    on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & boxed & contains(F.col("ring"), px, py)
    return placed.join(tiled, on, how).drop("_px", "_py", "_cx", "_cy", "xmin", "ymin", "xmax", "ymax")


def assigned(tiles: DataFrame, regions: DataFrame, region: str, cell: float, missing: str = "Unknown") -> DataFrame:
    """Tiles (xmin, ymin, xmax, ymax) with the region whose polygon holds their centre; of several, the first name.

    Each centre is looked up once, however many tiles share it.
    """
    centred = tiles.withColumns({"_x": (F.col("xmin") + F.col("xmax")) / 2, "_y": (F.col("ymin") + F.col("ymax")) / 2})
    parts = 4 * tiles.sparkSession.sparkContext.defaultParallelism  # few small rows with much work, which adaptive plans would put into one task
    centres = centred.select("_x", "_y").distinct().repartition(parts, "_x", "_y")
    hits = within_join(centres, regions.repartition(parts, region), "_x", "_y", cell).groupBy("_x", "_y").agg(F.min(region).alias(region))
    return centred.join(hits, ["_x", "_y"], "left").select(*tiles.columns, F.coalesce(region, F.lit(missing)).alias(region))


def overlapping(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes that touch or overlap: a (id_a, xmin...), b (id_b, xmin...); each pair once."""
    sides = []
    for t, s in ((a, "a"), (b, "b")):
        t = t.select(f"id_{s}", *[F.col(c).alias(f"{c}_{s}") for c in ("xmin", "ymin", "xmax", "ymax")])
        t = t.withColumn(f"_cx_{s}", F.explode(_cells(F.col(f"xmin_{s}"), F.col(f"xmax_{s}"), cell))).withColumn(f"_cy_{s}", F.explode(_cells(F.col(f"ymin_{s}"), F.col(f"ymax_{s}"), cell)))
        sides.append(t)
    # only the first cell that both lie in reports the pair
    first = lambda c, n: F.greatest(F.floor(F.col(f"{c}_a") / cell), F.floor(F.col(f"{c}_b") / cell)) == F.col(n)
    on = (F.col("_cx_a") == F.col("_cx_b")) & (F.col("_cy_a") == F.col("_cy_b")) & first("xmin", "_cx_a") & first("ymin", "_cy_a")
    meet = (F.col("xmin_a") <= F.col("xmax_b")) & (F.col("xmin_b") <= F.col("xmax_a")) & (F.col("ymin_a") <= F.col("ymax_b")) & (F.col("ymin_b") <= F.col("ymax_a"))
    return sides[0].join(sides[1], on & meet).select("id_a", "id_b")


#: Rounds in which nearest_distance looks in growing cells around; what is left then is far from everything selected.
RINGS = 4
#: A cell with at most so many selected points is read point by point.
FEW = 16


def nearest_distance(points: DataFrame, selected: DataFrame, key: str, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, distance) to the nearest of the selected (x, y) with equal ``by``, which may be many; null if there is none.  A written table.

    The first rounds look in the 3 x 3 cells around; what is found within one cell's width is the nearest, and the rest goes on
    with cells of twice the width.  Points far from everything selected then go down a tree of cells instead: from the cells that
    hold all selected points to their quarters, and so on, of which only those stay that may hold the nearest.
    """
    extent = points.select("x", "y").union(selected.select("x", "y")).agg(F.max("x"), F.min("x"), F.max("y"), F.min("y")).first()
    if extent[0] is None or not selected.limit(1).count():
        return points.select(key, F.lit(None).cast("double").alias("distance"))
    span = max(extent[0] - extent[1], extent[2] - extent[3], cell)
    rest, parts, before = points.select(key, *by, "x", "y"), [], []
    for _ in range(RINGS):
        near = [F.explode(F.sequence(F.floor(F.col(c) / cell) - 1, F.floor(F.col(c) / cell) + 1)) for c in "xy"]
        spread = selected.select(*by, F.col("x").alias("sx"), F.col("y").alias("sy"), near[0].alias("_cx"), "y").withColumn("_cy", near[1]).drop("y")
        placed = rest.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
        found = cut(placed.join(spread, [*by, "_cx", "_cy"], "left").groupBy(key, *by, "x", "y").agg(F.min(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).alias("distance")))
        parts.append(found.filter(F.col("distance") <= cell).select(key, "distance"))
        before.append(found)
        rest = found.filter(F.col("distance").isNull() | (F.col("distance") > cell)).select(key, *by, "x", "y")
        if cell > span or rest.isEmpty():
            break
        cell *= 2
    if not rest.isEmpty():
        parts.append(_nearest_by_tree(rest, selected, key, span, (extent[1], extent[3]), by))
    return cut(reduce(DataFrame.union, parts), *before, *parts)


def _nearest_by_tree(points: DataFrame, selected: DataFrame, key: str, span: float, corner: tuple[float, float], by: tuple[str, ...]) -> DataFrame:
    """(key, distance), a written table, by bounds of cells.

    A cell with selected points bounds the distance from below by its nearest and from above by its farthest corner (of the
    box of its points).  Each level goes on with the quarters of the cells whose lower bound isn't above the least upper one.
    """
    level, done, size = 0, [], span * (1 + 1e-9)
    at = lambda c, k: F.floor((F.col(c) - corner[k]) / size)
    pool = selected.select(*by, F.col("x").alias("sx"), F.col("y").alias("sy"))
    open_ = points.select(key, *by, "x", "y", F.lit(0).cast("bigint").alias("_cx"), F.lit(0).cast("bigint").alias("_cy"))
    gap = lambda c: F.greatest(F.col(f"_{c}0") - F.col(c), F.col(c) - F.col(f"_{c}1"), F.lit(0.0))
    reach = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"_{c}0")), F.abs(F.col(c) - F.col(f"_{c}1")))
    earlier = None
    while True:
        boxes = pool.groupBy(*by, at("sx", 0).alias("_cx"), at("sy", 1).alias("_cy")).agg(
            F.min("sx").alias("_x0"), F.max("sx").alias("_x1"), F.min("sy").alias("_y0"), F.max("sy").alias("_y1"), F.count("*").alias("_many")
        )
        met = open_.join(boxes, [*by, "_cx", "_cy"]).withColumns({"_low": F.hypot(gap("x"), gap("y")), "_high": F.hypot(reach("x"), reach("y"))})
        met = met.withColumn("_least", F.min("_high").over(Window.partitionBy(key))).filter(F.col("_low") <= F.col("_least") * (1 + 1e-12))
        place = (F.col("_x0") == F.col("_x1")) & (F.col("_y0") == F.col("_y1"))  # all its points are one
        found = cut(met.select(key, *by, "x", "y", "_cx", "_cy", "_many", F.when(place, F.col("_low")).alias("_exact")))
        if earlier is not None:
            release(earlier)
        earlier = found
        # small cells are read, and cells of one place known; the others go on
        last = level >= 40
        small, exact = F.col("_many") <= FEW, F.col("_exact").isNotNull()
        read = (found if last else found.filter(small)).filter(~exact)
        with_points = read.join(pool.withColumns({"_cx": at("sx", 0), "_cy": at("sy", 1)}), [*by, "_cx", "_cy"])
        nearest = with_points.select(key, F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")).alias("distance"))
        done.append(cut(nearest.union(found.filter(exact).select(key, "_exact")).groupBy(key).agg(F.min("distance").alias("distance"))))
        further = found.filter(~small & ~exact)
        if last or further.isEmpty():
            release(earlier)
            out = reduce(DataFrame.union, done).groupBy(key).agg(F.min("distance").alias("distance"))
            return cut(points.select(key).join(out, key, "left"), *done)
        quarters = F.array(*[F.struct((F.col("_cx") * 2 + i).alias("cx"), (F.col("_cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
        open_ = further.select(key, *by, "x", "y", F.inline(quarters)).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
        level, size = level + 1, size / 2


def farthest_selection(tiles: DataFrame, region: str, needed: str, min_distance: float, chosen: str = "chosen") -> DataFrame:
    """(tile_id, region, step): tiles picked one by one in each region, the farthest from all picked first.

    tiles: (tile_id, region, x, y, effective_pixels, needed, chosen); ties by more effective pixels, then tile_id.  Picks
    keep min_distance; when none does, half of it.  Each step is one aggregation and one join with its picks (a row for
    each region that isn't done), so there are as many steps as the largest ``needed``, and no region in one task.  The
    distance to what was chosen before comes from ``nearest_distance``.  Tiles without a region are left out.
    """
    tiles = tiles.select("tile_id", region, "x", "y", F.coalesce("effective_pixels", F.lit(0)).alias("effective_pixels"), needed, chosen).filter(F.col(region).isNotNull())
    free = tiles.filter(~F.col(chosen) & (F.col(needed) > 0))
    before = nearest_distance(free, tiles.filter(chosen), "tile_id", min_distance, (region,))
    free = cut(free.join(before, "tile_id").withColumn("_far", F.coalesce("distance", F.lit(math.inf))).drop("distance", chosen))
    out, step = [], 0
    while True:
        step += 1
        first = F.struct(-F.col("_far"), -F.col("effective_pixels"), "tile_id")
        best = free.groupBy(region).agg(F.min_by(F.struct("tile_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "_far", F.col(needed).alias("_needed")), first).alias("b")).select(region, "b.*")
        best = cut(best.filter((F.col("_far") >= min_distance / 2) & (F.col("_needed") >= step)).drop("_needed", "_far"))
        out.append(best)
        n = best.count()
        if not n:
            picks = [b.select("tile_id", F.col(region).cast("string").alias(region), F.lit(k + 1).alias("step")) for k, b in enumerate(out)]
            return cut(reduce(DataFrame.union, picks), free, *out)
        best = best.withColumnRenamed("tile_id", "_picked")
        left = free.join(F.broadcast(best) if n <= BROADCAST_REGIONS else best, region).filter(F.col("tile_id") != F.col("_picked"))
        free = cut(left.withColumn("_far", F.least("_far", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")))).drop("_picked", "_x", "_y"), free)


def reference_set(in_situ: DataFrame, supplementary: DataFrame, distance: int = 5) -> DataFrame:
    """Cells (row, col, phenology, source) by the rule of reference polygons, on rasters of polygons.

    in_situ and supplementary: (id, row, col, phenology).  In-situ cells are kept.  A supplementary polygon is kept if it
    meets no in-situ polygon, dropped if it meets one of another phenology, and else loses the cells within ``distance``
    cells of its edge or of in-situ cells.
    """
    cell = ["row", "col"]
    meets = supplementary.alias("s").join(in_situ.select(*cell, F.col("phenology").alias("_other")), cell)
    state = meets.groupBy("id").agg(F.max((F.col("phenology") != F.col("_other")).cast("int")).alias("conflict"))
    clear = supplementary.join(state, "id", "left_anti")
    same = supplementary.join(state.filter("conflict = 0").select("id"), "id", "left_semi")
    steps = [(i, j) for i in range(-distance, distance + 1) for j in range(-distance, distance + 1) if math.hypot(i, j) <= distance]
    offsets = F.inline(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in steps]))
    around = same.select("id", *cell, "phenology", offsets).select("id", *cell, "phenology", (F.col("row") + F.col("di")).alias("r"), (F.col("col") + F.col("dj")).alias("c"))
    own = same.select("id", F.col("row").alias("r"), F.col("col").alias("c"), F.lit(1).alias("_own"))
    near = in_situ.select(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(1).alias("_near")).distinct()
    judged = around.join(own, ["id", "r", "c"], "left").join(near, ["r", "c"], "left").groupBy("id", *cell, "phenology").agg(F.count("_own").alias("inside"), F.count("_near").alias("close"))
    trimmed = judged.filter((F.col("inside") == len(steps)) & (F.col("close") == 0)).select("id", *cell, "phenology")
    out = clear.select("id", *cell, "phenology").union(trimmed).withColumn("source", F.lit("supplementary"))
    return in_situ.select("id", *cell, "phenology").withColumn("source", F.lit("in-situ")).unionByName(out)


def wkb_centroid(df: DataFrame, key: str, wkb: str) -> DataFrame:
    """(key, x, y): centroid of the outer ring of WKB polygons; other geometries give null."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def centre(raw: bytes | None) -> tuple[float | None, float | None]:
        if not raw:
            return None, None
        order = "<" if raw[0] == 1 else ">"
        if struct.unpack_from(order + "I", raw, 1)[0] % 1000 != 3:
            return None, None
        n = struct.unpack_from(order + "I", raw, 9)[0]
        flat = struct.unpack_from(f"{order}{2 * n}d", raw, 13)
        xs, ys = flat[::2], flat[1::2]
        cross = [xs[i - 1] * ys[i] - xs[i] * ys[i - 1] for i in range(n)]
        a = sum(cross)
        if not a:
            return sum(xs) / n, sum(ys) / n
        return tuple(sum((v[i - 1] + v[i]) * cross[i] for i in range(n)) / (3 * a) for v in (xs, ys))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            found = [centre(x) for x in rows[wkb]]
            yield pd.DataFrame({key: rows[key], "x": [f[0] for f in found], "y": [f[1] for f in found]})

    return df.select(key, wkb).mapInPandas(run, f"`{key}` {kinds[key]}, x double, y double")


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as a dissolve keeps attributes."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_rank = 1").drop("_rank")

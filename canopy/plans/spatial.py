"""Queries on time series, rasters, geometry and map comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import compare as cp
from canopy.operators import composites as co
from canopy.operators import geo
from canopy.operators import harmonic as hm
from canopy.operators import polygons as pg
from canopy.operators import projections as pr
from canopy.operators import raster as ra
from canopy.plans.proxies import GRID_SQL, grid, rounded, table, tiles
from canopy.plans.registry import query

_SIZE = 5
_X = ["cos(2 * pi() * t)", "sin(2 * pi() * t)", "cos(4 * pi() * t)", "sin(4 * pi() * t)", "1.0::DOUBLE"]
_SERIES_SQL = """f AS (SELECT l_suppkey AS tile_id, CAST(min(l_shipdate) AS DATE) AS first FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey AS tile_id, date_diff('day', first, CAST(l_shipdate AS DATE)) / 365.25 AS t, l_quantity AS y, 1 - l_tax AS w FROM lineitem JOIN f ON tile_id = l_suppkey)"""
_MOMENT_SQL = f"m AS (SELECT tile_id, {', '.join(f'sum(w * {_X[i]} * {_X[j]}) AS a{i}_{j}' for i in range(_SIZE) for j in range(i, _SIZE))}, {', '.join(f'sum(w * {x} * y) AS b{i}' for i, x in enumerate(_X))}, sum(w * y * y) AS yy, count(*) AS n, sum(w) AS sw FROM s GROUP BY 1)"
_STAGES, _PREVIOUS = [], "m"
for _k, _stage in enumerate(hm.elimination(_SIZE)):
    _STAGES.append(f"g{_k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _stage.items())} FROM {_PREVIOUS})")
    _PREVIOUS = f"g{_k}"
_WRAP = lambda x: f"CASE WHEN {x} <= -pi() THEN {x} + 2 * pi() ELSE {x} END"


def _series(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile_id"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("y"), (1 - F.col("l_tax")).alias("w"))
    return hm.years_since_first(df, ["tile_id"], "date")


@query(f"WITH {_SERIES_SQL}, {_MOMENT_SQL} SELECT tile_id, n, round(sw, 4) AS sw, round(yy, 4) AS yy, round(a0_0, 4) AS a0_0, round(a0_3, 4) AS a0_3, round(b1, 4) AS b1, round(b4, 4) AS b4 FROM m")
def harmonic_moments(spark, sf_dir):
    """Sums of products of the design matrix, in one aggregation."""
    return rounded(hm.moments(_series(spark, sf_dir), ["tile_id"], "y", "w").select("tile_id", "n", "sw", "yy", "a0_0", "a0_3", "b1", "b4"), 4)


@query(f"""WITH {_SERIES_SQL}, {_MOMENT_SQL}, {', '.join(_STAGES)}
SELECT tile_id, n, round(sqrt(p0 * p0 + p1 * p1), 6) AS amplitude_h1, round(sqrt(p2 * p2 + p3 * p3), 6) AS amplitude_h2, round({_WRAP('atan2(p1, p0)')}, 6) AS phase_h1, round({_WRAP('atan2(p3, p2)')}, 6) AS phase_h2, round(p4, 6) AS "offset",
round((yy - p0 * b0 - p1 * b1 - p2 * b2 - p3 * b3 - p4 * b4) / sw, 4) AS var_weighted FROM {_PREVIOUS}""")
def harmonic_ols_fit(spark, sf_dir):
    """Weighted least squares of two harmonics for each tile, without Python."""
    fit = hm.solved(hm.moments(_series(spark, sf_dir), ["tile_id"], "y", "w"))
    explained = sum((F.col(f"p{i}") * F.col(f"b{i}") for i in range(1, _SIZE)), F.col("p0") * F.col("b0"))
    variance = F.round((F.col("yy") - explained) / F.col("sw"), 4).alias("var_weighted")
    return rounded(fit.select("tile_id", "n", *[c.alias(n) for n, c in hm.features(fit).items()], variance))


@query()
def harmonic_irls_fit(spark, sf_dir):
    """Robust fit; each tile is a window of one pixel."""
    df = _series(spark, sf_dir).withColumn("pixel", F.lit(0))
    return rounded(hm.robust_fit(df, ["tile_id"], ["pixel"], "date", "y", "w"))


def _bands(spark, sf_dir):
    """Bands of 16 pixels in each tile, from all lines of orders; the lines of one pixel and date are one value, so a window is bounded by the dates."""
    lines, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    df = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    dn = {"b2": F.col("p_size") * 30, "b4": F.col("p_retailprice") / 3, "b8": F.col("l_quantity") * 60, "b11": F.col("l_extendedprice") / 40, "b12": F.col("o_totalprice") / 300, "msk_cldprb": F.col("l_tax") * 21845}
    keys = [F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") % 16).alias("pixel"), F.col("l_shipdate").cast("date").alias("date")]
    return df.groupBy(*keys).agg(*[F.round(F.avg(c.cast("double"))).cast("int").alias(b) for b, c in dn.items()])


@query()
def harmonic_feature_stack(spark, sf_dir):
    """The 24 stored features of each pixel, from bands to integers."""
    out = hm.feature_stack(_bands(spark, sf_dir), ["tile_id"], ["pixel"])
    return out.select("tile_id", F.floor(F.col("pixel") / 4).cast("int").alias("row"), (F.col("pixel") % 4).cast("int").alias("col"), *out.columns[2:])


@query()
def irls_iterations(spark, sf_dir):
    """Stored features at 1, 5 and 10 iterations."""
    return rounded(hm.compare_iterations(_bands(spark, sf_dir), ["tile_id"], ["pixel"]), 3)


#: Side of the blocks in which queries on tiles of 25 x 25 run: a multiple, so that no tile is cut.
_SIDE = 250


def _tiled(spark, sf_dir):
    """Cells in tiles of 25 x 25."""
    g = grid(spark, sf_dir)
    return g.select(ra.block_of(F.col("row"), 25).alias("tile_row"), ra.block_of(F.col("col"), 25).alias("tile_col"), "row", "col", F.col("custom").alias("value"), "prob", "ref")


_CELLS_SQL = f'{GRID_SQL}, v AS (SELECT "row" // 25 * 25 AS tile_row, col // 25 * 25 AS tile_col, "row" AS r, col AS c, custom AS value FROM grid)'


@query(f"""WITH {_CELLS_SQL}, e AS (SELECT a.tile_row, a.tile_col, count(*) FILTER (a.value <> b.value) AS edges FROM v a JOIN v b ON a.tile_row = b.tile_row AND a.tile_col = b.tile_col AND a.value > 0 AND b.value > 0 AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)) GROUP BY 1, 2),
n AS (SELECT tile_row, tile_col, count(*) FILTER (value > 0) AS valid FROM v GROUP BY 1, 2) SELECT tile_row, tile_col, valid, coalesce(edges, 0) AS edges, round(valid * 0.0001, 6) AS area_km2, round(coalesce(edges, 0) * 10 / (valid * 0.0001), 6) AS edge_density FROM n LEFT JOIN e USING (tile_row, tile_col)""")
def edge_density(spark, sf_dir):
    """Edges between classes in each tile."""
    return rounded(ra.edge_density(_tiled(spark, sf_dir), ["tile_row", "tile_col"]))


@query(f"""WITH RECURSIVE {_CELLS_SQL}, k AS (SELECT tile_row, tile_col, r, c, value, (r - tile_row) * 25 + c - tile_col AS i FROM v WHERE value IN (1, 2)),
n AS (SELECT a.tile_row, a.tile_col, a.value, a.i, b.i AS j FROM k a JOIN k b ON a.tile_row = b.tile_row AND a.tile_col = b.tile_col AND a.value = b.value AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
w AS (SELECT * FROM n UNION SELECT w.tile_row, w.tile_col, w.value, w.i, n.j FROM w JOIN n ON n.tile_row = w.tile_row AND n.tile_col = w.tile_col AND n.i = w.j),
o AS (SELECT tile_row, tile_col, value, count(*) AS patches FROM (SELECT tile_row, tile_col, value, i, min(j) AS first FROM w GROUP BY ALL) WHERE i = first GROUP BY ALL),
t AS (SELECT tile_row, tile_col, count(*) FILTER (value > 0) AS valid FROM v GROUP BY ALL)
SELECT t.tile_row, t.tile_col, CAST(k AS INT) AS class, coalesce(patches, 0) AS patches, round(coalesce(patches, 0) * 100 / nullif(valid * 0.0001, 0), 6) AS per_100km2 FROM t CROSS JOIN (VALUES (1), (2)) x(k) LEFT JOIN o ON o.tile_row = t.tile_row AND o.tile_col = t.tile_col AND o.value = k""")
def patch_counts(spark, sf_dir):
    """8-connected patches of each class in each tile."""
    return rounded(ra.patches(_tiled(spark, sf_dir), ["tile_row", "tile_col"], side=_SIDE))


_NEAR = "SELECT a.tile_row, a.tile_col, a.r, a.c, a.value, unnest(range(-1, 2)) AS i FROM v a"


@query(f"""WITH {_CELLS_SQL}, n AS (SELECT *, unnest(range(-1, 2)) AS j FROM ({_NEAR})), l AS (SELECT tile_row, tile_col, max(r) AS mr, max(c) AS mc FROM v GROUP BY 1, 2),
m AS (SELECT n.r, n.c, n.value, quantile_disc(b.value, 0.5) AS med FROM n JOIN l USING (tile_row, tile_col) JOIN v b ON b.r = least(greatest(n.r + i, n.tile_row), mr) AND b.c = least(greatest(n.c + j, n.tile_col), mc) GROUP BY ALL)
SELECT r AS "row", c AS col, CASE WHEN value > 0 AND med > 0 THEN med ELSE value END AS value FROM m""")
def median_filter(spark, sf_dir):
    """3 x 3 median inside tiles."""
    return ra.median_filter(_tiled(spark, sf_dir), ["tile_row", "tile_col"], side=_SIDE).select("row", "col", "value")


_SMOOTH_SQL = ", ".join(
    f"""{new} AS (SELECT o.tile_row, o.tile_col, o.r, o.c, sum(w * s.p) AS p FROM {old} o JOIN e USING (tile_row, tile_col) CROSS JOIN taps JOIN {old} s ON s.tile_row = o.tile_row AND s.tile_col = o.tile_col AND s.{fixed} = o.{fixed}
    AND s.{moved} = CASE WHEN o.{moved} + k < {low} THEN 2 * {low} - 1 - (o.{moved} + k) WHEN o.{moved} + k > {high} THEN 2 * {high} + 1 - (o.{moved} + k) ELSE o.{moved} + k END GROUP BY ALL)"""
    for new, old, moved, fixed, low, high in (("s1", "s0", "r", "c", "r0", "r1"), ("s2", "s1", "c", "r", "c0", "c1"))
)


@query(f"""WITH {GRID_SQL}, s0 AS (SELECT "row" // 25 * 25 AS tile_row, col // 25 * 25 AS tile_col, "row" AS r, col AS c, prob, CASE WHEN prob % 12 >= 5 THEN 1.0::DOUBLE ELSE 0 END AS p FROM grid),
e AS (SELECT tile_row, tile_col, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM s0 GROUP BY ALL), raw AS (SELECT k, exp(-0.5 * (k / 1.5) ** 2) AS w FROM range(-6, 7) x(k)), taps AS (SELECT k, w / sum(w) OVER () AS w FROM raw), {_SMOOTH_SQL},
f AS (SELECT s0.*, least(greatest(s2.p, 0), 1) AS forest FROM s0 JOIN s2 USING (tile_row, tile_col, r, c))
SELECT tile_row, tile_col, r AS "row", c AS col, round(1 - forest, 6) + 0.0 AS p_nonforest, round(least(greatest(prob / 255 * forest, 0), 1), 6) + 0.0 AS p_deciduous, round(least(greatest((255 - prob) / 255 * forest, 0), 1), 6) + 0.0 AS p_evergreen FROM f""")
def gaussian_soft_labels(spark, sf_dir):
    """Soft labels from smoothed canopy height."""
    cells = _tiled(spark, sf_dir).withColumns({"height": F.col("prob") % 12, "d": F.col("prob"), "e": 255 - F.col("prob")})
    return rounded(ra.gaussian_soft_labels(cells, ["tile_row", "tile_col"], "height", "d", "e", side=_SIDE))


_BLOCK_SQL = f"""{GRID_SQL}, x AS (SELECT *, eco >= 1 AND custom <> 255 AND ref <> 255 AS valid FROM grid), y AS (SELECT *, valid AND custom IN (1, 2) AS a, valid AND ref IN (1, 2) AS b FROM x),
c AS (SELECT "row" // 25 * 25 AS row_off, col // 25 * 25 AS col_off, count(*) FILTER (valid) AS total_comparable_pixels, count(*) FILTER (a AND NOT b) AS count_custom_only_forest, count(*) FILTER (b AND NOT a) AS count_ref_only_forest, count(*) FILTER (a AND b) AS count_both_forest, count(*) FILTER (valid AND NOT a AND NOT b) AS count_both_nonforest,
count(*) FILTER (a AND b AND custom = 1 AND ref = 1) AS tn, count(*) FILTER (a AND b AND custom = 1 AND ref = 2) AS fp, count(*) FILTER (a AND b AND custom = 2 AND ref = 1) AS fn, count(*) FILTER (a AND b AND custom = 2 AND ref = 2) AS tp FROM y GROUP BY 1, 2)"""


def _null_metrics(policy):
    z = (lambda x: f"coalesce({x}, 0)") if policy == "zero" else (lambda x: x)
    return f"""round((tn + tp) / nullif(n, 0), 6) AS overall_accuracy, round(CASE WHEN pe = 1 THEN {'CASE WHEN tn + tp = n THEN 1.0 ELSE 0.0 END' if policy == 'zero' else 'NULL'} ELSE ((tn + tp) / nullif(n, 0) - pe) / (1 - pe) END, 6) AS kappa,
round({z('tn / nullif(tn + fn, 0)')}, 6) AS precision_deciduous, round({z('tn / nullif(tn + fp, 0)')}, 6) AS recall_deciduous, round({z('2 * tn / nullif(2 * tn + fp + fn, 0)')}, 6) AS f1_deciduous,
round({z('tp / nullif(tp + fp, 0)')}, 6) AS precision_evergreen, round({z('tp / nullif(tp + fn, 0)')}, 6) AS recall_evergreen, round({z('2 * tp / nullif(2 * tp + fp + fn, 0)')}, 6) AS f1_evergreen,
round({'(' + z('2 * tn / nullif(2 * tn + fp + fn, 0)') + ' + ' + z('2 * tp / nullif(2 * tp + fp + fn, 0)') + ') / 2' if policy == 'zero' else 'list_avg([2 * tn / nullif(2 * tn + fp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0)])'}, 6) AS f1_macro"""


_PE = "(CAST(tn + fp AS DOUBLE) * (tn + fn) + CAST(fn + tp AS DOUBLE) * (fp + tp)) / nullif(CAST(tn + fp + fn + tp AS DOUBLE) * (tn + fp + fn + tp), 0) AS pe, tn + fp + fn + tp AS n"
_PERC = ", ".join(f"round(100 * count_{p} / nullif(total_comparable_pixels, 0), 6) AS perc_{p}" for p in ("custom_only_forest", "ref_only_forest", "both_forest", "both_nonforest"))


@query(f"WITH {_BLOCK_SQL}, k AS (SELECT *, {_PE} FROM c) SELECT * EXCLUDE (pe, n), {_PERC}, {_null_metrics('zero')} FROM k")
def map_compare_blocks(spark, sf_dir):
    """Agreement of two maps in blocks."""
    return rounded(cp.with_metrics(cp.compare_blocks(grid(spark, sf_dir), 25)))


_REGION_SQL = f"""{_BLOCK_SQL}, o AS (SELECT row_off, col_off, unnest(range(-1, 2)) AS i FROM c), o2 AS (SELECT *, unnest(range(-1, 2)) AS j FROM o),
f AS (SELECT row_off, col_off, eco, count(*) AS k FROM o2 JOIN grid ON grid."row" = row_off + 12 + i AND grid.col = col_off + 12 + j AND eco > 0 GROUP BY 1, 2, 3), e AS (SELECT row_off, col_off, arg_min(eco, (-k, eco)) AS eco_id FROM f GROUP BY 1, 2),
r AS (SELECT eco_id, grouping(eco_id) AS g, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM (SELECT c.*, coalesce(eco_id, 0) AS eco_id FROM c LEFT JOIN e USING (row_off, col_off)) GROUP BY GROUPING SETS ((), (eco_id))),
k AS (SELECT CASE WHEN g = 1 THEN 'national' ELSE 'eco_' || eco_id END AS eco_region, tn, fp, fn, tp, {_PE} FROM r WHERE g = 1 OR eco_id > 0)"""


def _regions(spark, sf_dir):
    g = grid(spark, sf_dir)
    return cp.compare_regions(cp.block_regions(cp.compare_blocks(g, 25), g, 25))


@query(f"WITH {_REGION_SQL} SELECT eco_region, tn, fp, fn, tp, n AS total_pixels, {_null_metrics('null')} FROM k")
def map_compare_regions(spark, sf_dir):
    """National and regional agreement of two maps."""
    return rounded(_regions(spark, sf_dir))


@query(f"WITH {_REGION_SQL}, q AS (SELECT n, {_null_metrics('null')} FROM k WHERE eco_region <> 'national') SELECT CAST(sum(n) AS BIGINT) AS pixels, round(sum(overall_accuracy * n) / sum(n), 5) AS overall_accuracy, round(sum(kappa * n) / sum(n), 5) AS kappa FROM q")
def map_compare_overall(spark, sf_dir):
    """Accuracy and kappa over regions, by pixels."""
    return rounded(cp.weighted_overall(_regions(spark, sf_dir)), 5)


_POINTS_SQL = "p AS (SELECT c_custkey, (c_custkey * 7 % 4000) / 100 AS x, (c_custkey * 13 % 4000) / 100 AS y FROM customer)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 4000 / 100).alias("x"), (F.col("c_custkey") * 13 % 4000 / 100).alias("y"))


@query(f"""WITH {_POINTS_SQL}, b AS (SELECT s_suppkey AS tile_id, s_suppkey % 10 * 4.0 AS xmin, s_suppkey // 10 % 10 * 4.0 AS ymin FROM supplier) SELECT tile_id, count(*) AS points, CAST(sum(c_custkey) AS BIGINT) AS keys FROM p JOIN b ON x >= xmin AND x < xmin + 4 AND y >= ymin AND y < ymin + 4 GROUP BY 1""")
def point_in_box_join(spark, sf_dir):
    """Points in boxes, by an equi-join on grid cells of the different places and boxes."""
    s = table(spark, sf_dir, "supplier")
    low = s.select(F.col("s_suppkey").alias("tile_id"), (F.col("s_suppkey") % 10 * 4.0).alias("xmin"), (F.floor(F.col("s_suppkey") / 10) % 10 * 4.0).alias("ymin"))
    boxes = low.withColumns({"xmax": F.col("xmin") + 4, "ymax": F.col("ymin") + 4})
    return geo.box_sums(_points(spark, sf_dir), boxes, "tile_id", "x", "y", 4.0, "c_custkey").withColumnRenamed("sum", "keys")


@query(f"""WITH {_POINTS_SQL}, c AS (SELECT s_suppkey AS region, s_suppkey % 5 * 8.0 + 0.003 AS x0, s_suppkey // 5 % 4 * 10.0 + s_suppkey // 20 * 0.01 + 0.003 AS y0 FROM supplier), t AS (SELECT c_custkey AS tile_id, x, y FROM p)
SELECT tile_id, coalesce(CAST(min(CAST(region AS VARCHAR)) FILTER (x - x0 > 0 AND y - y0 > 0 AND (x - x0) / 7 + (y - y0) / 9 < 1) AS BIGINT), -1) AS region FROM t CROSS JOIN c GROUP BY 1""")
def centroid_within_region(spark, sf_dir):
    """Tiles to the region (a triangle, of several the first name) that holds their centre."""
    at = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("region"), (F.col("s_suppkey") % 5 * 8.0 + 0.003).alias("x0"), (F.floor(F.col("s_suppkey") / 5) % 4 * 10.0 + F.floor(F.col("s_suppkey") / 20) * 0.01 + 0.003).alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    regions = at.select("region", F.array(corner(0, 0), corner(7, 0), corner(0, 9)).alias("ring"))
    points = _points(spark, sf_dir)
    boxes = points.select(F.col("c_custkey").alias("tile_id"), *[(F.col(c[0]) + d).alias(c) for c, d in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))])
    return geo.assigned(boxes, regions, "region", 8.0, "-1").select("tile_id", F.col("region").cast("long").alias("region"))


@query(f"WITH {_POINTS_SQL}, s AS (SELECT * FROM p WHERE c_custkey % 97 = 0) SELECT p.c_custkey, round(min(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)), 6) AS distance FROM p CROSS JOIN s GROUP BY 1")
def nearest_selected_distance(spark, sf_dir):
    """Distance of each candidate to the nearest selected point."""
    p = _points(spark, sf_dir)
    return rounded(geo.nearest_distance(p, p.filter("c_custkey % 97 = 0"), "c_custkey", 2.0))


@query()
def greedy_tile_selection(spark, sf_dir):
    """Ten tiles for each region, the farthest first."""
    t = tiles(spark, sf_dir)
    placed = t.select("tile_id", "eco_region", (F.col("tile_id") % 10 * 2500.0).alias("x"), (F.floor(F.col("tile_id") / 10) * 2500.0).alias("y"), (F.col("tile_id") * 37 % 101).cast("double").alias("effective_pixels"), F.lit(10).alias("needed"), (F.col("tile_id") % 25 == 0).alias("chosen"))
    return geo.farthest_selection(placed, "eco_region", "needed", 4000.0)


_RECT_SQL = 'q AS (SELECT s_suppkey AS k, s_suppkey * 17 % 110 AS x0, s_suppkey * 29 % (SELECT max("row") + 1 FROM grid) AS y0 FROM supplier)'


def _rectangles(spark, sf_dir, left, top, right, bottom):
    """A rectangle of each supplier, somewhere on the whole grid."""
    extent = grid(spark, sf_dir).agg((F.max("row") + 1).alias("height"))
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(extent))  # one row
    s = s.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 17 % 110).alias("x0"), (F.col("s_suppkey") * 29 % F.col("height")).alias("y0"))
    x0, y0 = F.col("x0"), F.col("y0")
    return s.select("k", (F.col("k") % 7 + 1).alias("v"), geo.box(x0 + left, y0 + top, x0 + right, y0 + bottom).alias("ring"))


@query(f"""WITH {GRID_SQL}, {_RECT_SQL} SELECT "row", col, coalesce(arg_max(k % 7 + 1, k), 0) AS value FROM grid LEFT JOIN q ON col + 0.5 > x0 + 0.25 AND col + 0.5 < x0 + 12.25 AND "row" + 0.5 > y0 + 0.25 AND "row" + 0.5 < y0 + 9.25 GROUP BY 1, 2""")
def rasterize_last_wins(spark, sf_dir):
    """Polygons burnt into cells by their centres; the later one wins."""
    polygons = _rectangles(spark, sf_dir, 0.25, 0.25, 12.25, 9.25)
    return ra.rasterised(grid(spark, sf_dir), polygons, "v", "k")


@query(f"""WITH {GRID_SQL}, {_RECT_SQL}, h AS (SELECT DISTINCT y0 + r AS "row", x0 + c AS col, 1 AS value FROM q CROSS JOIN range(2) a(r) CROSS JOIN range(3) b(c)) SELECT "row", col, coalesce(value, 0) AS value FROM grid LEFT JOIN h USING ("row", col)""")
def touched_mask(spark, sf_dir):
    """Cells that a polygon touches, though it holds no centre."""
    return ra.touched(grid(spark, sf_dir), _rectangles(spark, sf_dir, 0.75, 0.75, 2.25, 1.25), F.col("col") + 0.5, F.col("row") + 0.5, 1.0)


@query("""WITH m AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS i FROM lineitem GROUP BY 1, 2)
SELECT l.l_suppkey, round(avg(l.l_quantity), 6) AS mean, min(l.l_quantity) AS min, max(l.l_quantity) AS max, round(stddev_pop(l.l_quantity), 6) AS std, round(quantile_cont(l.l_quantity, 0.9), 6) AS p90, min(m.l_quantity) AS mode FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey AND i = 1 GROUP BY 1""")
def zonal_stats(spark, sf_dir):
    """Statistics of pixels in zones, with 90th percentile and mode."""
    return rounded(ra.zonal(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"))


@query("""SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, round(avg(l_extendedprice) - 273.15, 4) AS temperature, round(sum(l_quantity) * 1000, 4) AS rain, round(avg(l_discount * 1000) / 100, 6) AS soil FROM lineitem GROUP BY 1, 2""")
def yearly_climate(spark, sf_dir):
    """Yearly covariates with their units changed."""
    out = co.yearly_covariates(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", {"temperature": ("l_extendedprice", "kelvin_mean"), "rain": ("l_quantity", "metres_sum"), "soil": ("l_discount", "thousandths_mean")})
    return out.withColumns({"temperature": F.round("temperature", 4), "rain": F.round("rain", 4), "soil": F.round("soil", 6)})


@query(f"""WITH {GRID_SQL}, s AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM grid), a AS (SELECT *, unnest(range(0, h, 32)) AS row_off FROM s), b AS (SELECT *, unnest(range(0, w, 32)) AS col_off FROM a)
SELECT row_off, col_off, least(32, h - row_off) AS height, least(32, w - col_off) AS width, count(custom) AS cells FROM b LEFT JOIN grid ON "row" // 32 * 32 = row_off AND col // 32 * 32 = col_off GROUP BY ALL""")
def window_enumeration(spark, sf_dir):
    """Blocks of the grid's extent, the last ones cut, with the cells that each has."""
    g = grid(spark, sf_dir)
    height, width = g.agg(F.max("row") + 1, F.max("col") + 1).first()
    cells = g.groupBy(ra.block_of(F.col("row"), 32).alias("row_off"), ra.block_of(F.col("col"), 32).alias("col_off")).agg(F.count("*").alias("cells"))
    every = ra.windows(spark, height, width, 32).select(*[F.col(c).cast("long").alias(c) for c in ("row_off", "col_off", "height", "width")])
    return every.join(cells, ["row_off", "col_off"], "left").fillna(0, ["cells"])


_N, _SCALE, _ORIGIN = pr.LAMBERT_93._constants()
_E = pr.GRS80.e


@query(f"""WITH p AS (SELECT c_custkey, (c_custkey * 7 % 1400) / 100 - 5 AS lon, (c_custkey * 13 % 900) / 100 + 42 AS lat FROM customer),
t AS (SELECT *, {_SCALE!r} * (tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E!r} * sin(radians(lat))) / (1 + {_E!r} * sin(radians(lat))), {_E / 2!r})) ** {_N!r} AS r, {_N!r} * radians(lon - 3) AS a FROM p)
SELECT c_custkey, round(700000 + r * sin(a), 3) AS x, round(6600000 + {_ORIGIN!r} - r * cos(a), 3) AS y, round(lon, 6) + 0.0 AS lon, round(lat, 6) AS lat FROM t""")
def projected_points(spark, sf_dir):
    """Points in degrees on the national grid, and back."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (k * 7 % 1400 / 100 - 5).alias("x"), (k * 13 % 900 / 100 + 42).alias("y"))
    there = pr.reprojected(p, 4326, 2154).withColumns({"lon": F.col("x"), "lat": F.col("y")})
    back = pr.reprojected(there, 2154, 4326, "lon", "lat")
    return back.select("c_custkey", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("x", 3), ("y", 3), ("lon", 6), ("lat", 6))])


_DIAMOND_SQL = "d AS (SELECT {0} AS id, {0} * 7 % 4000 / 16.0 AS x, {0} * 13 % 4000 / 16.0 AS y, {0} % 5 / 4.0 + 0.25 AS r FROM {1})"


def _diamonds(spark, sf_dir, name, key, id_):
    """Squares on their corners: centre and half diagonal from the key."""
    k = F.col(key)
    at = table(spark, sf_dir, name).select(k.alias(id_), (k * 7 % 4000 / 16).alias("x"), (k * 13 % 4000 / 16).alias("y"), (k % 5 / 4 + 0.25).alias("r"))
    corner = lambda i, j: F.struct((F.col("x") + i * F.col("r")).alias("x"), (F.col("y") + j * F.col("r")).alias("y"))
    return at.select(id_, F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))


@query(f"""WITH {_DIAMOND_SQL.format("c_custkey", "customer").replace("d AS", "a AS")}, {_DIAMOND_SQL.format("s_suppkey", "supplier").replace("d AS", "b AS")}
SELECT a.id AS id_a, b.id AS id_b FROM a JOIN b ON abs(a.x - b.x) + abs(a.y - b.y) <= a.r + b.r""")
def polygon_intersections(spark, sf_dir):
    """Pairs of polygons that touch or overlap, by their sides and not their boxes."""
    return pg.intersecting(_diamonds(spark, sf_dir, "customer", "c_custkey", "id_a"), _diamonds(spark, sf_dir, "supplier", "s_suppkey", "id_b"), 2.0)


@query(f"""WITH {GRID_SQL}, {_RECT_SQL}, b AS (SELECT DISTINCT "row" // 25 * 25 AS tile_row, col // 25 * 25 AS tile_col FROM grid), o AS (SELECT k, tile_row, tile_col, least(x0 + 12.25, tile_col + 25) - greatest(x0 + 0.25, tile_col) AS w, least(y0 + 9.25, tile_row + 25) - greatest(y0 + 0.25, tile_row) AS h FROM q CROSS JOIN b)
SELECT k, tile_row, tile_col, round(CAST(w * h AS DOUBLE), 6) AS area FROM o WHERE w > 0 AND h > 0""")
def clipped_polygons(spark, sf_dir):
    """Area of each polygon in each tile that it reaches into."""
    blocks = grid(spark, sf_dir).select(ra.block_of(F.col("row"), 25).alias("tile_row"), ra.block_of(F.col("col"), 25).alias("tile_col")).distinct()
    boxes = blocks.select("*", F.col("tile_col").cast("double").alias("xmin"), F.col("tile_row").cast("double").alias("ymin"), (F.col("tile_col") + 25.0).alias("xmax"), (F.col("tile_row") + 25.0).alias("ymax"))
    parts = pg.clipped(_rectangles(spark, sf_dir, 0.25, 0.25, 12.25, 9.25).select("k", "ring"), boxes, 25.0)
    return rounded(parts.select("k", "tile_row", "tile_col", geo.area(F.col("ring")).alias("area")).filter("area > 0"))


@query("""SELECT o_custkey AS pixel, round(quantile_cont(o_totalprice, 0.5), 6) AS b2, count(*) AS n_dates FROM orders WHERE month(o_orderdate) IN (9, 10, 11) AND o_orderkey % 100 <= 40 GROUP BY 1""")
def seasonal_composite(spark, sf_dir):
    """Median of the clear dates of a season for each pixel."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pixel"), F.col("o_totalprice").alias("b2"), "o_orderdate", (F.col("o_orderkey") % 100).alias("cloud"))
    return rounded(co.seasonal_composite(o, ["pixel"], ["b2"], "o_orderdate", [9, 10, 11], "cloud", 40))

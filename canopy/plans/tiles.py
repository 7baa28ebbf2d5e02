"""Queries on tiles of cells: labelled pixels, resampling, patches, training tiles and reports on tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import classification as c
from canopy.operators import compare as cp
from canopy.operators import patching as pa
from canopy.operators import raster as ra
from canopy.operators import stats as st
from canopy.plans.classification import _BUNDLE, _COUNTS, _RATIOS
from canopy.plans.proxies import GRID_SQL, PIXELS_SQL, grid, pixels, rounded, table
from canopy.plans.registry import query
from canopy.plans.spatial import _BLOCK_SQL, _PE, _RECT_SQL, _SIDE, _rectangles, _tiled
from canopy.plans.stats import _CONTEXT_SQL, _context


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT tile_id, min(eco_region) AS eco_region, {_COUNTS} FROM pixels GROUP BY 1), m AS ({_RATIOS} FROM c) SELECT tile_id, eco_region, tn, fp, fn, tp, {_BUNDLE} FROM m""")
def tile_metrics(spark, sf_dir):
    """Metrics of each tile with its region."""
    counts = pixels(spark, sf_dir).groupBy("tile_id").agg(F.min("eco_region").alias("eco_region"), *c.confusion_counts(F.col("y_true"), F.col("y_pred")))
    return rounded(counts.withColumns(c.binary_metrics()))


@query(f'WITH {GRID_SQL} SELECT "row", col, custom, prob, eco FROM grid WHERE custom <> 0')
def labelled_pixels(spark, sf_dir):
    """Cells with a label, with their bands."""
    return ra.labelled_pixels(grid(spark, sf_dir), "custom", ["prob", "eco"])


_COARSE_SQL = 'k AS (SELECT "row" // 4 AS r, col // 4 AS c, max(eco) AS eco FROM grid GROUP BY 1, 2)'


@query(f'WITH {GRID_SQL}, {_COARSE_SQL} SELECT g."row", g.col, coalesce(k.eco, -1) AS eco FROM grid g LEFT JOIN k ON r = floor((g."row" * 10 - 15) / 40.0) AND c = floor((g.col * 10 - 25) / 40.0)')
def mask_resample(spark, sf_dir):
    """A coarse mask on the cells of a finer grid; its corner lies elsewhere."""
    g = grid(spark, sf_dir)
    coarse = g.groupBy(F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col")).agg(F.max("eco").alias("eco"))
    return ra.resampled(g.select("row", "col"), coarse, "eco", 10.0, 40.0, (30.0, 20.0), -1)


@query(f'WITH {GRID_SQL} SELECT "row" - 20 AS "row", col - 30 AS col, custom FROM grid WHERE "row" BETWEEN 20 AND 77 AND col BETWEEN 30 AND 89')
def cropped_box(spark, sf_dir):
    """The cells that a box touches (a crop)."""
    return ra.cropped(grid(spark, sf_dir).select("row", "col", "custom"), (303.0, 200.0, 900.0, 777.0), 10.0)


@query(f"""WITH {GRID_SQL}, v AS (SELECT *, CASE WHEN ("row" * 125 + col) % 9973 = 0 THEN 'nan'::DOUBLE ELSE prob END AS f FROM grid), s AS (SELECT max("row") + 1 AS h FROM grid),
a AS (SELECT o, unnest(range(o, h - 63, 56)) AS row_off FROM s CROSS JOIN (VALUES (0), (28)) t(o)), p AS (SELECT row_off, unnest(range(o, 125 - 63, 56)) AS col_off FROM a)
SELECT CAST(row_off AS INT) AS row_off, CAST(col_off AS INT) AS col_off, count(*) AS n FROM p JOIN v ON "row" >= row_off AND "row" < row_off + 64 AND col >= col_off AND col < col_off + 64 GROUP BY 1, 2 HAVING bool_or(custom > 0) AND bool_and(isfinite(f))""")
def patch_validity(spark, sf_dir):
    """Training patches with a label and without missing features."""
    g = grid(spark, sf_dir).withColumn("f", F.when((F.col("row") * 125 + F.col("col")) % 9973 == 0, float("nan")).otherwise(F.col("prob").cast("double")))
    height = g.agg(F.max("row")).first()[0] + 1
    return ra.valid_patches(g, pa.patch_grid(spark, height, 125), "custom", ["f"])


_ATTRIBUTES = {"phenology": "k % 2 + 1", "genus": "k % 7 + 1", "species": "k % 23 + 1", "source": "k % 3 + 1", "year": "2000 + k % 20"}


@query(f"""WITH {GRID_SQL}, {_RECT_SQL} SELECT "row", col, prob, {', '.join(f'coalesce(arg_max({e}, k), 0) AS {a}' for a, e in _ATTRIBUTES.items())}
FROM grid LEFT JOIN q ON col + 0.5 >= x0 + 0.5 AND col + 0.5 < x0 + 8.5 AND "row" + 0.5 > y0 + 0.75 AND "row" + 0.5 < y0 + 11.25 GROUP BY 1, 2, 3""")
def training_tile(spark, sf_dir):
    """Features with five attributes of polygons burnt beside them; 0 where there is no polygon."""
    polygons = _rectangles(spark, sf_dir, 0.5, 0.75, 8.5, 11.25).select("k", "ring", *[F.expr(e).alias(a) for a, e in _ATTRIBUTES.items()])
    return ra.training_tile(grid(spark, sf_dir).select("row", "col", "prob"), polygons, list(_ATTRIBUTES), "k", 1.0)


@query(f"""WITH {GRID_SQL}, v AS (SELECT *, CASE WHEN ("row" * 125 + col) % 9973 = 0 THEN 'nan'::DOUBLE ELSE prob END AS f FROM grid), s AS (SELECT max("row") + 1 AS h FROM grid),
a AS (SELECT o, unnest(range(o, h - 63, 56)) AS row_off FROM s CROSS JOIN (VALUES (0), (28)) t(o)), p AS (SELECT row_off, unnest(range(o, 125 - 63, 56)) AS col_off FROM a),
c AS (SELECT row_off, col_off, f, eco, custom, ("row" - row_off) * 64 + col - col_off AS i FROM p JOIN v ON "row" >= row_off AND "row" < row_off + 64 AND col >= col_off AND col < col_off + 64)
SELECT row_off, col_off, CAST(count(*) AS INT) * 2 AS n, CAST(sum(i % 1000 * f) AS BIGINT) AS first_band, CAST(sum(i % 1000 * eco) AS BIGINT) AS second_band, CAST(sum(i % 1000 * custom) AS BIGINT) AS labels FROM c GROUP BY 1, 2 HAVING bool_or(custom > 0) AND bool_and(isfinite(f)) AND count(*) = 4096""")
def patch_tensors(spark, sf_dir):
    """Training patches as arrays of two bands and labels, as sums over their places."""
    f = F.when((F.col("row") * 125 + F.col("col")) % 9973 == 0, float("nan")).otherwise(F.col("prob").cast("double"))
    cells = grid(spark, sf_dir).select("row", "col", f.alias("f"), "eco", "custom")
    found = pa.patch_tensors(cells, [], pa.features_of(cells.columns, selected=["f", "eco"]), "custom")

    def weighed(array, begin):
        part = F.transform(F.slice(array, begin + 1, 4096), lambda v, i: v.cast("double") * (i % 1000))
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v).cast("long")

    return found.select("row_off", "col_off", F.size("pixels").alias("n"), weighed("pixels", 0).alias("first_band"), weighed("pixels", 4096).alias("second_band"), weighed("label", 0).alias("labels"))


@query()
def coherence_variants(spark, sf_dir):
    """Area, edges, forest and patches of two maps and of a smoothed one in each tile."""
    cells = _tiled(spark, sf_dir)
    second = cells.withColumn("value", F.when(F.col("ref") == 255, 0).otherwise(F.col("ref")))
    return rounded(ra.coherence_variants(cells, second, ["tile_row", "tile_col"], side=_SIDE))


_RANKED = "rank() OVER (PARTITION BY target, feature ORDER BY {0}) + (count(*) OVER (PARTITION BY target, feature, {0}) - 1) / 2.0"


@query(f"""WITH {_CONTEXT_SQL}, w AS (SELECT *, coalesce(z_accuracy < 1, false) AS i FROM x), l AS (SELECT i, unnest(['price', 'tax', 'lines', 'balance']) AS feature, unnest([price, tax, lines, balance]) AS v FROM w), m AS (SELECT feature, avg(v) FILTER (i) AS mean, avg(v) FILTER (NOT i) AS reference FROM l GROUP BY 1),
t AS (SELECT 'delta_accuracy' AS target, delta_accuracy AS d, unnest(['price', 'tax', 'lines', 'balance']) AS feature, unnest([price, tax, lines, balance]) AS v FROM w WHERE i UNION ALL SELECT 'delta_f1_macro', delta_f1_macro, unnest(['price', 'tax', 'lines', 'balance']), unnest([price, tax, lines, balance]) FROM w WHERE i),
r AS (SELECT *, {_RANKED.format('d')} AS rd, {_RANKED.format('v')} AS rv FROM t WHERE d IS NOT NULL AND v IS NOT NULL), kk AS (SELECT feature, target, CASE WHEN count(*) >= 3 AND stddev_pop(d) > 0 AND stddev_pop(v) > 0 THEN corr(d, v) END AS pearson, CASE WHEN count(*) >= 3 AND stddev_pop(rd) > 0 AND stddev_pop(rv) > 0 THEN corr(rd, rv) END AS spearman FROM r GROUP BY 1, 2),
q AS (SELECT feature, {', '.join(f"round(max({m}) FILTER (target = '{t}'), 6) AS {m}_{t}" for t in ('delta_accuracy', 'delta_f1_macro') for m in ('pearson', 'spearman'))} FROM kk GROUP BY 1)
SELECT feature, round(mean, 6) AS mean, round(reference, 6) AS reference, round(mean - reference, 6) AS difference, round(CASE WHEN abs(reference) >= 1e-8 THEN 100 * (mean - reference) / reference END, 6) AS percent, q.* EXCLUDE (feature) FROM m LEFT JOIN q USING (feature)""")
def driver_correlations(spark, sf_dir):
    """Covariates of the tiles that did not improve against the others, and their correlations with the deltas."""
    subset = F.coalesce(F.col("z_accuracy") < 1, F.lit(False))
    return rounded(st.driver_correlations(_context(spark, sf_dir), subset, ["delta_accuracy", "delta_f1_macro"], ["price", "tax", "lines", "balance"]))


@query("""WITH w AS (SELECT l_suppkey AS tile_id, CASE WHEN l_linenumber % 7 <> 0 THEN l_tax END AS weight FROM lineitem), t AS (SELECT tile_id, 100 * avg(CASE WHEN weight IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS p FROM w GROUP BY 1 ORDER BY p DESC, tile_id LIMIT 10)
SELECT tile_id, round(p, 6) AS missing_pct FROM t UNION ALL SELECT NULL, round(100 * avg(CASE WHEN weight IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) FROM w""")
def weight_inspection(spark, sf_dir):
    """Missing weights of all rows and of the ten worst tiles (a top-k report)."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile_id"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_tax")).alias("weight"))
    return rounded(st.missing_weights(w, "tile_id", "weight"))


@query("""SELECT s_suppkey, s_nationkey % 3 <> 0 AND s_suppkey % 4 = 0 AS same FROM supplier""")
def grid_alignment(spark, sf_dir):
    """Whether two grids have the same cells."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    fields = lambda crs, shift: F.struct(crs.alias("crs"), (key * 10.0 + shift).alias("x0"), F.lit(5.0).alias("y0"), F.lit(10.0).alias("size_x"), F.lit(-10.0).alias("size_y"), F.lit(64).alias("height"), F.lit(64).alias("width"))
    both = s.withColumns({"a": fields(F.lit("2154"), F.lit(0.0)), "b": fields(F.when(F.col("s_nationkey") % 3 != 0, "2154"), F.when(key % 4 == 0, 1e-9).otherwise(0.5))})
    return both.select("s_suppkey", ra.same_grid("a", "b").alias("same"))


@query("""SELECT p_partkey, p_size AS band FROM part WHERE p_size % 3 = 1""")
def two_band_rasters(spark, sf_dir):
    """The first band of rasters that have two; others are skipped."""
    part = table(spark, sf_dir, "part")
    bands = F.when(F.col("p_size") % 3 == 1, F.array("p_size", F.lit(0))).otherwise(F.array("p_size"))
    return ra.first_band(part.select("p_partkey", bands.alias("bands")))


@query(f"WITH {_BLOCK_SQL}, k AS (SELECT *, {_PE} FROM c) SELECT round(min(a), 6) AS low, round(max(a), 6) AS high FROM (SELECT coalesce((tn + tp) / nullif(n, 0), 0) AS a FROM k)")
def block_metric_range(spark, sf_dir):
    """Least and largest accuracy of blocks, the limits of a colour scale."""
    blocks = cp.with_metrics(cp.compare_blocks(grid(spark, sf_dir), 25))
    accuracy = F.coalesce("overall_accuracy", F.lit(0.0))
    return rounded(blocks.agg(F.min(accuracy).alias("low"), F.max(accuracy).alias("high")))

"""Queries that write tables in the formats of the workflows, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopy.operators import geo
from canopy.operators.lineage import cut, shared_folder
from canopy.plans.proxies import GRID_SQL, grid, rounded
from canopy.plans.registry import query
from canopy.plans.spatial import _RECT_SQL, _rectangles
from canopy.sources import rasters, shapefiles, tables, vectors


def _through(spark, write, read):
    """What ``read`` finds in a new shared folder that ``write`` has filled; the folder goes."""
    path = f"{shared_folder(spark)}/canopy-files/{uuid.uuid4().hex}"
    write(path)
    out = cut(read(path))
    fs, at = tables._fs(spark, path)
    fs.delete(at, True)
    return out


@query(f"""WITH {GRID_SQL}, t AS (SELECT "row" // 400 AS tile, "row" % 400 AS r, col AS c, custom, prob FROM grid), s AS (SELECT tile, max(r) AS h, max(c) AS w FROM t GROUP BY 1), a AS (SELECT tile, w, unnest(range(0, h + 1)) AS r FROM s), e AS (SELECT tile, r, unnest(range(0, w + 1)) AS c FROM a)
SELECT tile, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(coalesce(custom, 9) AS DOUBLE) AS custom, CAST(coalesce(prob, 9) AS DOUBLE) AS prob FROM e LEFT JOIN t USING (tile, r, c)""")
def geotiff_round_trip(spark, sf_dir):
    """The grid as GeoTIFFs of 400 lines, tiled and compressed, and back by windows that aren't the files' own."""
    cells = grid(spark, sf_dir).select(F.floor(F.col("row") / 400).alias("tile"), (F.col("row") % 400).alias("row"), "col", "custom", "prob")
    rasters.register(spark)
    back = _through(
        spark,
        lambda path: rasters.write_geotiffs(cells, "tile", ["custom", "prob"], path, block=64, dtype="uint16", fill=9, epsg=2154),
        lambda path: spark.read.format("raster").option("block", 100).load(path),
    )
    return back.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("tile"), "row", "col", F.col("band_1").alias("custom"), F.col("band_2").alias("prob"))


_AREA_SQL = f"""WITH {GRID_SQL}, {_RECT_SQL} SELECT k, 'Polygon' AS kind, 108.0::DOUBLE AS area, round(CAST(x0 + 0.25 AS DOUBLE), 6) AS xmin, round(CAST(y0 + 9.25 AS DOUBLE), 6) AS ymax FROM q"""


def _areas(layer):
    """Area and bounds of the polygons that came back."""
    b = geo.bounds(F.col("ring"))
    return rounded(vectors.outer_rings(layer).select("k", "kind", geo.area(F.col("ring")).alias("area"), b["xmin"].alias("xmin"), b["ymax"].alias("ymax")))


def _layer(spark, sf_dir):
    return _rectangles(spark, sf_dir, 0.25, 0.25, 12.25, 9.25).select("k", "ring")


@query(_AREA_SQL)
def shapefile_round_trip(spark, sf_dir):
    """Polygons as shapefiles, and back by ranges of records."""
    return _areas(_through(spark, lambda path: shapefiles.write_shapefiles(_layer(spark, sf_dir), path), lambda path: shapefiles.read_shapefile(spark, path, 50)))


@query(_AREA_SQL)
def geopackage_round_trip(spark, sf_dir):
    """Polygons as GeoPackages, and back by ranges of rows."""
    return _areas(_through(spark, lambda path: vectors.write_geopackages(_layer(spark, sf_dir), path), lambda path: vectors.read_geopackage(spark, path, rows=50)))


@query(_AREA_SQL)
def geoparquet_round_trip(spark, sf_dir):
    """Polygons as GeoParquet, and back."""
    return _areas(_through(spark, lambda path: vectors.write_geoparquet(_layer(spark, sf_dir), path), lambda path: vectors.read_geoparquet(spark, path, columns=["k"])))


@query(_AREA_SQL)
def geojson_round_trip(spark, sf_dir):
    """Polygons as GeoJSON features, one a line, and back."""
    return _areas(_through(spark, lambda path: tables.geojson(_layer(spark, sf_dir)).write.text(path), lambda path: vectors.read_geojson(spark, path, "k long", lines=True)))

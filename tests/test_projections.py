"""Projections against published points, and forth and back."""

import math

import pytest
from pyspark.sql import functions as F

from canopy.operators import projections as pr

FOOT = 1200 / 3937
CLARKE, AIRY = pr.Ellipsoid(6378206.4, 294.97870), pr.Ellipsoid(6377563.396, 299.32496)
TEXAS = pr.LambertConic(CLARKE, 27 + 5 / 6, -99.0, (28 + 23 / 60, 30 + 17 / 60), 2_000_000 * FOOT, 0.0)
BRITAIN = pr.TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)


def test_published_points():
    """The worked examples of the guidance note: Texas South Central in feet, and the British grid."""
    x, y = TEXAS.forward(-96.0, 28.5, math)
    assert (x / FOOT, y / FOOT) == pytest.approx((2963503.91, 254759.80), abs=0.01)
    assert TEXAS.inverse(2963503.91 * FOOT, 254759.80 * FOOT, math) == pytest.approx((-96.0, 28.5), abs=1e-7)
    assert BRITAIN.forward(0.5, 50.5, math) == pytest.approx((577274.99, 69740.50), abs=0.01)
    assert BRITAIN.inverse(577274.99, 69740.50, math) == pytest.approx((0.5, 50.5), abs=1e-6)


def test_origins():
    assert pr.LAMBERT_93.forward(3.0, 46.5, math) == pytest.approx((700_000, 6_600_000), abs=1e-6)
    assert pr.SYSTEMS[32631].forward(3.0, 0.0, math) == pytest.approx((500_000, 0), abs=1e-6)


def test_forth_and_back_in_columns(spark):
    points = [(lon / 4, lat / 4) for lon in range(-20, 40, 3) for lat in range(164, 206, 3)] + [(None, 45.0)]
    df = spark.createDataFrame(points, "x double, y double").withColumns({"lon": F.col("x"), "lat": F.col("y")})
    for code in (2154, 32631, 32730):
        system = pr.SYSTEMS[code]
        there = pr.reprojected(df, 4326, code)
        for r in there.collect():
            if r.lon is not None:
                assert (r.x, r.y) == pytest.approx(system.forward(r.lon, r.lat, math), abs=1e-6)
        for r in pr.reprojected(there, code, 4326).collect():
            assert r.x is None if r.lon is None else (r.x, r.y) == pytest.approx((r.lon, r.lat), abs=1e-9)
    both = pr.reprojected(pr.reprojected(df, 4326, 2154), 2154, 32631)
    direct = {(r.lon, r.lat): (r.x, r.y) for r in pr.reprojected(df, 4326, 32631).collect()}
    assert all(r.lon is None or (r.x, r.y) == pytest.approx(direct[r.lon, r.lat], abs=1e-3) for r in both.collect())


def test_range_test_of_coordinates(spark):
    df = spark.createDataFrame([(3.0, 46.5), (None, None), (-180.0, 90.0)], "x double, y double")
    assert pr.looks_geographic(df) and not pr.looks_geographic(pr.reprojected(df.limit(1), 4326, 2154))


def test_crops_by_corners(spark):
    low, high = pr.LAMBERT_93.forward(2.0, 46.0, math), pr.LAMBERT_93.forward(2.01, 46.01, math)
    box = pr.corners_box((2.0, 46.0, 2.01, 46.01), 2154)
    assert box[0] <= min(low[0], high[0]) and box[3] >= max(low[1], high[1])
    cells = spark.range(40_000).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"))
    origin = (box[0] - 305.0, box[1] - 205.0)
    out = pr.cropped_to_degrees(cells, (2.0, 46.0, 2.01, 46.01), 2154, 10.0, origin).agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    assert tuple(out) == (0, 0, math.ceil((box[3] - origin[1]) / 10) - 1 - 20, math.ceil((box[2] - origin[0]) / 10) - 1 - 30)


def test_warped_cells_take_the_source_cell_that_holds_their_centre(spark):
    from itertools import product

    low = pr.LAMBERT_93.forward(2.0, 46.0, math)
    cells = spark.createDataFrame(list(product(range(20), range(20))), "row int, col int")
    source = spark.createDataFrame([(r, c, r * 100 + c) for r, c in product(range(40), range(40))], "row int, col int, v int")
    grids = ((low[0], low[1], 500.0), (1.99, 45.99, 0.002))
    out = pr.warped(cells, source, ["v"], (2154, 4326), grids).collect()
    assert len(out) == 400 and any(r.v is None for r in out)
    for r in out:
        lon, lat = pr.LAMBERT_93.inverse(low[0] + (r.col + 0.5) * 500, low[1] + (r.row + 0.5) * 500, math)
        a, b = math.floor((lat - 45.99) / 0.002), math.floor((lon - 1.99) / 0.002)
        assert r.v == (a * 100 + b if 0 <= a < 40 and 0 <= b < 40 else None)

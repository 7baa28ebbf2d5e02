"""Equal places, boxes and rings meet once, and the results are those of every row by itself."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import geo, polygons


@pytest.fixture
def counted(spark):
    """A condition that holds always, and how often it was asked."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def holds(_):
        asked.add(1)
        return True

    return holds, asked


def test_centres_at_one_place_are_looked_up_once(spark, monkeypatch, counted):
    holds, asked = counted
    monkeypatch.setattr(geo, "contains", lambda ring, x, y: holds(ring[0]["x"] + x))
    tiles = spark.range(500).select(F.col("id").alias("tile_id"), *[(F.col("id") * 0 + v).alias(c) for c, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 2.0), ("ymax", 2.0))])
    regions = spark.range(4).select(F.concat(F.lit("r"), "id").alias("region"), geo.box(F.lit(0), F.lit(0), F.lit(3), F.lit(3)).alias("ring"))
    out = geo.assigned(tiles, regions, "region", 8.0).collect()
    assert len(out) == 500 and {r.region for r in out} == {"r0"} and asked.value <= 4


def test_equal_rings_are_tested_once(spark, monkeypatch, counted):
    holds, asked = counted
    monkeypatch.setattr(polygons, "rings_meet", lambda a, b: holds(F.col(f"{a}.xmin") + F.col(f"{b}.xmin")))
    copies = lambda n, name: spark.range(n).select(F.col("id").alias(name), geo.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("ring"))
    out = polygons.intersecting(copies(60, "id_a"), copies(50, "id_b"), 4.0).collect()
    assert len(out) == len(set(out)) == 3000 and asked.value == 1


def test_sums_in_boxes_equal_those_of_pairs(spark):
    rng = random.Random(2)
    points = [(rng.randrange(8) / 2, rng.randrange(8) / 2, k) for k in range(300)]
    boxes = [(k, x, y, x + 1.5, y + 1.0) for k in range(80) for x, y in [(float(rng.randrange(5)), float(rng.randrange(5)))]]
    got = geo.box_sums(spark.createDataFrame(points, "x double, y double, v long"), spark.createDataFrame(boxes, "id long, xmin double, ymin double, xmax double, ymax double"), "id", "x", "y", 2.0, "v").collect()
    want = {}
    for k, x0, y0, x1, y1 in boxes:
        held = [v for x, y, v in points if x0 <= x < x1 and y0 <= y < y1]
        if held:
            want[k] = (len(held), sum(held))
    assert {r.id: (r.points, r.sum) for r in got} == want and len(got) == len(want)

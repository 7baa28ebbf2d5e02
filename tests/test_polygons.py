"""Polygons burnt, met and clipped, against brute force on random convex and concave rings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import geo, patching, polygons, raster, scanline


def _star(rng, cx, cy, r, n):
    """A ring that is concave as a rule."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(a), cy + r * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]


def _inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _frame(spark, rings, name="id"):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in enumerate(rings)]
    return spark.createDataFrame(rows, f"{name} int, ring array<struct<x:double,y:double>>")


def test_burnt_cells_equal_centres_inside(spark):
    rng = random.Random(1)
    rings = [_star(rng, rng.uniform(0, 40), rng.uniform(0, 30), rng.uniform(1, 15), rng.randint(3, 12)) for _ in range(25)]
    rings += [[(2.5, 3.5), (6.5, 3.5), (6.5, 7.5), (2.5, 7.5)], [(1, 1), (1, 1), (1, 1)], [(0, 0), (5, 0)], [(-50, -50), (-40, -50), (-45, -40)], [(3, 3), (9, 9), (9, 3), (3, 9)]]
    frame = _frame(spark, rings).withColumns({"order": (F.col("id") * 7) % 30, "a": F.col("id") + 1, "b": F.col("id") % 3 + 5})
    for size, origin in ((1.0, (0.0, 0.0)), (0.7, (-3.0, 2.0))):
        cells = spark.createDataFrame([(r, c, r * c) for r in range(30) for c in range(40)], "row int, col int, keep int")
        got = {(r.row, r.col): (r.keep, r.a, r.b) for r in scanline.burnt(cells, frame, {"a": "a", "b": "b"}, ["order"], size, origin).collect()}
        assert len(got) == 1200
        for (r, c), (keep, a, b) in got.items():
            hits = [k for k, ring in enumerate(rings) if _inside(ring, origin[0] + (c + 0.5) * size, origin[1] + (r + 0.5) * size)]
            best = max(hits, key=lambda k: (k * 7 % 30, k), default=None)
            assert (keep, a, b) == (r * c, *((best + 1, best % 3 + 5) if best is not None else (0, 0)))


def test_spans_of_long_lines_meet_all_blocks(spark):
    wide = _frame(spark, [[(0, 0), (1000, 0), (1000, 2), (0, 2)]]).withColumn("v", F.lit(4))
    cells = spark.range(1100).select(F.lit(1).alias("row"), F.col("id").cast("int").alias("col"))
    assert raster.rasterised(cells, wide, "v", "v").agg(F.sum("value")).first()[0] == 4000
    assert raster.rasterised(cells, wide.limit(0), "v", "v", background=9).agg(F.min("value"), F.count("*")).first() == (9, 1100)


def _segments_meet(p, q, r, s):
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    d = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
    if d[0] * d[1] < 0 and d[2] * d[3] < 0:
        return True
    return any(t == 0 and on(a, b, c) for t, (a, b, c) in zip(d, ((p, q, r), (p, q, s), (r, s, p), (r, s, q)), strict=True))


def _rings_meet(a, b):
    sides = lambda r: list(zip(r, r[1:] + r[:1], strict=True))
    return any(_segments_meet(*s, *t) for s in sides(a) for t in sides(b)) or _inside(b, *a[0]) or _inside(a, *b[0])


def test_intersections_equal_brute_force(spark):
    rng = random.Random(3)
    a = [_star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0.5, 6), rng.randint(3, 9)) for _ in range(60)]
    b = [_star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0.5, 3), rng.randint(3, 9)) for _ in range(60)]
    a += [[(0, 0), (20, 0), (20, 20), (0, 20)], [(50, 0), (52, 0), (52, 2), (50, 2)], [(0, 40), (6, 40), (6, 46), (4, 46), (4, 42), (0, 42)]]
    b += [[(5, 5), (6, 5), (6, 6)], [(52, 1), (53, 1), (53, 3)], [(52, 2), (54, 2), (54, 4)], [(1, 43), (3, 43), (3, 45)]]  # inside, a side touched, a corner touched, only in the box
    got = {tuple(r) for r in polygons.intersecting(_frame(spark, a, "id_a"), _frame(spark, b, "id_b"), 4.0).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if _rings_meet(p, q)} and len(got) > 100
    assert (60, 60) in got and (61, 61) in got and (61, 62) in got and (62, 63) not in got


def test_clipped_areas_add_up(spark):
    rng = random.Random(5)
    rings = [_star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(1, 9), rng.randint(3, 14)) for _ in range(40)] + [[(0, 0), (10, 0), (10, 10), (0, 10)]]
    frame = _frame(spark, rings)
    boxes = spark.createDataFrame([(f"{i},{j}", float(i), float(j), i + 5.0, j + 5.0) for i in range(-20, 60, 5) for j in range(-20, 60, 5)], "tile string, xmin double, ymin double, xmax double, ymax double")
    parts = polygons.clipped(frame, boxes, 5.0)
    area = F.abs(F.sum(geo.signed_area(F.col("ring"))))
    got = {r.id: r.a for r in parts.groupBy("id").agg(area.alias("a")).collect()}
    want = {r.id: abs(r.a) for r in frame.select("id", geo.signed_area(F.col("ring")).alias("a")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for r in parts.select("xmin", "ymin", "xmax", "ymax", *geo.bounds(F.col("ring")).values()).collect():
        assert r[0] - 1e-9 <= r[4] and r[1] - 1e-9 <= r[5] and r[6] <= r[2] + 1e-9 and r[7] <= r[3] + 1e-9


def test_patch_arrays_equal_slices(spark):
    rng = np.random.default_rng(7)
    grids = {"a": (40, 50), "b": (17, 90), "c": (16, 16), "d": (10, 80)}
    data = {t: (rng.normal(size=(2, *s)), rng.integers(0, 2, s) * (rng.random(s) < 0.01)) for t, s in grids.items()}
    data["b"][0][1, 3, 40] = np.nan
    rows = [(t, r, c, float(x[0, r, c]), float(x[1, r, c]), int(y[r, c])) for t, (x, y) in data.items() for r in range(y.shape[0]) for c in range(y.shape[1]) if (t, r, c) != ("a", 20, 20)]
    cells = spark.createDataFrame(rows, "t string, row int, col int, ndvi_a double, ndvi_b double, label int")
    got = {(r.t, r.row_off, r.col_off): r for r in patching.patch_tensors(cells, ["t"], patching.features_of(cells.columns, "ndvi"), "label", 16, 14).collect()}
    want = set()
    for t, (h, w) in grids.items():
        places = {(r.row_off, r.col_off) for r in patching.patch_grid(spark, h, w, 16, 14).collect()}
        assert places == {(r, c) for o in (0, 7) for r in range(o, h - 15, 14) for c in range(o, w - 15, 14)}
        for r, c in places:
            x, y = (v[..., r : r + 16, c : c + 16] for v in data[t])
            if np.isfinite(x).all() and y.any() and not (t == "a" and r <= 20 < r + 16 and c <= 20 < c + 16):
                want.add((t, r, c))
                assert np.array_equal(np.array(got[t, r, c].pixels, np.float32).reshape(2, 16, 16), x.astype(np.float32)) and np.array_equal(np.reshape(got[t, r, c].label, (16, 16)), y)
    assert got.keys() == want and len(want) > 5
    with pytest.raises(ValueError, match="no features"):
        patching.features_of(cells.columns, "evi")
    with pytest.raises(ValueError, match="missing: x"):
        patching.features_of(cells.columns, selected=["ndvi_a", "x"])


@pytest.mark.parametrize("case", ["far", "spread", "one place", "by"])
def test_nearest_distance_of_near_and_far_points(spark, case):
    rng = random.Random(case)
    points = [(k, k % 2, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(300)]
    if case == "far":  # all selected ones in a corner, far from most
        chosen = [(k % 2, 1000 + rng.gauss(0, 3), 1000 + rng.gauss(0, 3)) for k in range(400)]
    elif case == "spread":
        chosen = [(k % 2, rng.uniform(-500, 1500), rng.uniform(-500, 1500)) for k in range(250)]
    elif case == "one place":
        chosen = [(k % 2, -4000.0, 77.0) for k in range(100)]
    else:
        chosen = [(0, rng.uniform(0, 1000), rng.uniform(0, 50)) for k in range(60)]
    p = spark.createDataFrame(points, "id int, g int, x double, y double")
    s = spark.createDataFrame(chosen, "g int, x double, y double")
    by = ("g",) if case == "by" else ()
    got = {r.id: r.distance for r in geo.nearest_distance(p, s, "id", 2.0, by).collect()}
    assert len(got) == 300
    for k, g, x, y in points:
        want = min((math.hypot(x - a, y - b) for h, a, b in chosen if not by or h == g), default=None)
        assert got[k] == (None if want is None else pytest.approx(want)), k

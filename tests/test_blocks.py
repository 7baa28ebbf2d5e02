"""Block-wise kernels give what a kernel on the whole raster gives, whatever the side of the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import blocks, raster


def _flood(mask):
    seen, n = np.zeros_like(mask), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not seen[start]:
            n, todo = n + 1, [start]
            seen[start] = True
            while todo:
                r, k = todo.pop()
                for i in range(max(r - 1, 0), min(r + 2, mask.shape[0])):
                    for j in range(max(k - 1, 0), min(k + 2, mask.shape[1])):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            todo.append((i, j))
    return n


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.4, 0.6):
        mask = rng.random((30, 40)) < share
        n, label = blocks.labels(mask)
        assert n == _flood(mask) and ((label >= 0) == mask).all() and set(label[mask]) == set(range(n))
        assert all(_flood(label == k) == 1 for k in range(n))


def _cells(spark, grids):
    """Rasters (name -> (grid, row of its first line, column of its first)); negative values are missing cells."""
    rows = [(k, r + top, c + left, int(g[r, c])) for k, (g, top, left) in grids.items() for r in range(g.shape[0]) for c in range(g.shape[1]) if g[r, c] >= 0]
    return spark.createDataFrame(rows, "t string, row int, col int, value int")


def _spiral(n):
    """One component that winds through all blocks."""
    g = np.zeros((n, n), int)
    r0, r1, c0, c1, r, c = 0, n - 1, 0, n - 1, 0, 0
    while r0 <= r1 and c0 <= c1:
        g[r0, c0 : c1 + 1] = 1
        g[r0 : r1 + 1, c1] = 1
        g[r1, c0 + 2 : c1 + 1] = 1
        g[r0 + 2 : r1 + 1, c0 + 2] = 1
        r0, r1, c0, c1 = r0 + 2, r1 - 2, c0 + 2, c1 - 2
    return g


@pytest.mark.parametrize("side", [5, 8, 256])
def test_patches_of_any_block_side(spark, side):
    rng = np.random.default_rng(side)
    grids = {"a": (rng.integers(0, 3, (33, 27)), 0, 0), "b": (rng.choice([-1, 0, 1, 2], (21, 30), p=[0.1, 0.5, 0.3, 0.1]), -7, 13), "c": (_spiral(30), 3, 1), None: (np.eye(20, dtype=int) + np.eye(20, dtype=int)[::-1], 2, 2), "d": (np.zeros((3, 3), int), 0, 0)}
    out = {(r["t"], r["class"]): (r["patches"], r["per_100km2"]) for r in raster.patches(_cells(spark, grids), ["t"], side=side).collect()}
    assert set(out) == {(t, k) for t in grids for k in (1, 2)}
    for (t, k), (n, density) in out.items():
        g = grids[t][0]
        assert n == _flood(g == k), (t, k)
        assert density == (pytest.approx(n * 1e6 / (g > 0).sum()) if (g > 0).any() else None)


def test_links_that_hook_in_chains(spark):
    edges = [("x", k, k + 1) for k in range(60)] + [("x", 100 + k, 100) for k in range(1, 30)] + [("y", 5, 3), ("y", 3, 5), ("y", 4, 4), ("y", 9, 4), ("y", 9, 3)]
    out = dict(map(tuple, blocks.links_left(spark.createDataFrame(edges, "g string, a long, b long"), "g").collect()))
    assert out == {"x": 60 + 29, "y": 3}


def _median(g):
    wide = np.pad(g, 1, mode="edge")
    return np.array([[(m if g[r, c] > 0 and (m := np.sort(wide[r : r + 3, c : c + 3].ravel())[4]) > 0 else g[r, c]) for c in range(g.shape[1])] for r in range(g.shape[0])])


@pytest.mark.parametrize("side", [4, 9, 256])
def test_median_of_any_block_side(spark, side):
    rng = np.random.default_rng(1)
    grids = {"a": (rng.integers(0, 3, (19, 23)), 0, 0), "b": (rng.integers(0, 3, (1, 14)), -3, 6), None: (rng.integers(0, 3, (10, 4)), 5, 5)}
    out = raster.median_filter(_cells(spark, grids), ["t"], side=side).collect()
    assert len(out) == sum(g.size for g, _, _ in grids.values())
    want = {t: _median(g) for t, (g, _, _) in grids.items()}
    assert all(r.value == want[r.t][r.row - grids[r.t][1], r.col - grids[r.t][2]] for r in out)


def _smoothed(g, sigma=1.5):
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        g = np.apply_along_axis(lambda v: np.convolve(np.pad(v, radius, mode="symmetric"), w, mode="valid"), axis, g)
    return g


@pytest.mark.parametrize("side", [7, 16, 256])
def test_gaussian_of_any_block_side(spark, side):
    rng = np.random.default_rng(2)
    grids = {"a": (rng.integers(0, 12, (30, 25)), 0, 0), "b": (rng.integers(0, 12, (3, 40)), 9, -4)}
    cells = _cells(spark, grids).withColumns({"d": F.lit(100), "e": F.lit(255)})
    out = raster.gaussian_soft_labels(cells, ["t"], "value", "d", "e", side=side).collect()
    assert len(out) == 750 + 120
    want = {t: np.clip(_smoothed((g >= 5).astype(float)), 0, 1) for t, (g, _, _) in grids.items()}
    for r in out:
        forest = want[r.t][r.row - grids[r.t][1], r.col - grids[r.t][2]]
        assert (r.p_nonforest, r.p_deciduous, r.p_evergreen) == pytest.approx((1 - forest, forest * 100 / 255, forest), abs=1e-12)


def test_borders_no_wider_than_blocks(spark):
    with pytest.raises(ValueError, match="wider"):
        raster.gaussian_soft_labels(_cells(spark, {"a": (np.ones((2, 2), int), 0, 0)}), ["t"], "value", "value", "value", side=4)


def test_empty_rasters(spark):
    cells = _cells(spark, {"a": (np.ones((1, 1), int), 0, 0)}).limit(0)
    assert raster.patches(cells, ["t"]).count() == 0 and raster.median_filter(cells, ["t"]).count() == 0


def test_the_smoothed_map_is_made_once(spark):
    cells = spark.createDataFrame([(0, r, c, (r * c) % 3) for r in range(12) for c in range(9)], "tile int, row long, col long, value int")
    out = raster.coherence_variants(cells, cells, ["tile"], side=4)
    assert "median" in " ".join(r.variant for r in out.collect()) and out.count() == 3
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()

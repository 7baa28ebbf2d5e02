"""Robust fits of several measures and limits in one run, against the plain algorithm one by one."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import harmonic


def _plain(y, w, t, max_iter, tolerance):
    """One measure of a window, all dates dense; y, w: (dates, pixels)."""
    x = np.stack([f(2 * np.pi * k * t) for k in (1, 2) for f in (np.cos, np.sin)] + [np.ones_like(t)], axis=1)
    missing = np.isnan(y)
    y, w = np.where(missing, np.nanmean(y, axis=0), y), np.where(missing, 0.0, w)
    p = (np.linalg.pinv(x) @ y).T
    for _ in range(max_iter):
        rest = y - x @ p.T
        limit = 1.345 * rest.std(axis=0, ddof=1)
        weight = w * np.where(np.abs(rest) <= limit, 1.0, limit / (np.abs(rest) + 1e-9))
        new = np.linalg.solve(np.einsum("tn,ti,tj->nij", weight, x, x), np.einsum("tn,ti->ni", weight * y, x)[..., None])[..., 0]
        change = np.percentile(np.abs(new - p) / np.maximum(np.abs(p), 1e-5), 75)
        p = new
        if tolerance is not None and change < tolerance:
            break
    a, b = p[:, 0:-1:2], p[:, 1::2]
    return np.concatenate([np.hypot(a, b), np.arctan2(b, a), p[:, -1:], (y - x @ p.T).var(axis=0)[:, None]], axis=1)


@pytest.mark.parametrize("tolerance", [None, 0.05, 0.5])
def test_measures_together_equal_each_alone(tolerance):
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(1000, 120, replace=False)) / 365.25
    y = rng.normal(size=(3, 5, 120)) * np.array([0.1, 1, 3])[:, None, None] + np.cos(2 * np.pi * t)
    y[:, rng.random((5, 120)) < 0.5] = np.nan
    y[1, 2, :40] = np.nan  # one measure lacks more
    w = rng.random((5, 120))
    limits = (1, 4, 10)
    for limit, found in zip(limits, harmonic.fit_together(y, w, t, limits=limits, tolerance=tolerance), strict=True):
        for k in range(3):
            assert found[k] == pytest.approx(_plain(y[k].T, w.T, t, limit, tolerance), abs=1e-8)


def test_fits_cost_what_is_there():
    rng = np.random.default_rng(5)
    t = np.sort(rng.choice(9000, 3000, replace=False)) / 365.25
    y = rng.normal(size=(3, 40, 3000)) + np.sin(2 * np.pi * t)
    y[:, rng.random((40, 3000)) > 0.02] = np.nan
    w = rng.random((40, 3000))
    tracemalloc.start()
    found = harmonic.fit_together(y, w, t, limits=(3, 8), tolerance=None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < y.nbytes  # no tables of all dates of all pixels
    for limit, fit in zip((3, 8), found, strict=True):
        for k in range(3):
            assert fit[k] == pytest.approx(_plain(y[k].T, w.T, t, limit, None), abs=1e-8)


def test_pixels_without_values_of_one_value_or_on_all_dates():
    rng = np.random.default_rng(6)
    t = np.sort(rng.choice(700, 40, replace=False)) / 365.25
    y = rng.normal(size=(1, 4, 40))
    y[0, 1] = np.nan
    y[0, 2, 1:] = np.nan
    y[0, 3, :30] = np.nan
    none, one, *rest = (harmonic.fit_together(y, np.ones((4, 40)), t, limits=(5,), tolerance=None)[0][0][k] for k in (1, 2, 0, 3))
    assert np.isnan(none).all() and (one[:5] == 0).all() and one[5] == pytest.approx(0)  # one value has no robust fit
    assert np.array(rest) == pytest.approx(_plain(y[0, [0, 3]].T, np.ones((40, 2)), t, 5, None), abs=1e-8)


def test_a_window_reaches_python_once(spark):
    dates = [(tile, px, f"2020-{m:02d}-{d:02d}", 300 + 40 * m, 500, 2000 + 100 * m, 1500 + d, 900, 100 * px) for tile in range(2) for px in range(3) for m in range(1, 13) for d in (3, 17)]
    series = spark.createDataFrame(dates, "tile int, px int, date string, b2 int, b4 int, b8 int, b11 int, b12 int, msk_cldprb int").withColumn("date", F.to_date("date"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    both = harmonic.compare_iterations(series, ["tile"], ["px"])
    assert plan(both).count("FlatMapGroupsIn") == 1
    assert {(r.max_iter, r.total) for r in both.collect()} == {(k, 6) for k in (1, 5, 10)} and both.count() == 72
    stacks = {r.max_iter: r for r in harmonic.feature_stacks(series, ["tile"], ["px"], limits=(1, 10), tolerance=None).filter("tile = 0 AND px = 1").collect()}
    for n, r in stacks.items():
        alone = harmonic.feature_stack(series, ["tile"], ["px"], max_iter=n, tolerance=None).filter("tile = 0 AND px = 1").first()
        assert {k: v for k, v in r.asDict().items() if k != "max_iter"} == alone.asDict()

"""Small cases with answers computed by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import indices as ix
from canopy.functions import scaling as sc
from canopy.operators import classification as c
from canopy.operators import geo, harmonic, ml, qa, raster, relations, sampling, similarity, stats


def row(df):
    return df.first().asDict()


def counts(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_kappa_and_empty(spark):
    r = row(counts(spark, 40, 10, 5, 45).withColumns(c.agreement() | c.binary_metrics()))
    assert r["overall_accuracy"] == pytest.approx(0.85) and r["kappa"] == pytest.approx(0.7)
    assert [r[k] for k in ("precision_deciduous", "precision_evergreen", "recall_deciduous", "recall_evergreen")] == pytest.approx([0.888889, 0.818182, 0.8, 0.9], abs=1e-6)
    assert set(row(counts(spark, 0, 0, 0, 0).select(*c.binary_metrics().values())).values()) == {0.0}
    assert set(row(counts(spark, 0, 0, 0, 0).select(*(c.agreement("null") | c.binary_metrics("null")).values())).values()) == {None}
    assert row(counts(spark, 9, 0, 0, 0).select(c.agreement()["kappa"].alias("k")))["k"] == 1.0


def test_reliability(spark):
    df = spark.createDataFrame(zip([0.0, 0.1, 0.1, 0.1 + 0.2, 0.95, 1.0], [1, 1, 2, 2, 2, 2], strict=True), "prob double, y_true int")
    curve = c.reliability(df)
    found = {r.bin: (r.n, r.confidence, r.empirical) for r in curve.collect() if r.n}
    assert found[0] == pytest.approx((3, 0.0666667, 0.333333), abs=1e-6) and found[2][0] == 1 and found[9] == pytest.approx((2, 0.975, 1.0))
    r = row(c.calibration_error(curve))
    assert (r["ece"], r["mce"]) == pytest.approx((0.258333, 0.7), abs=1e-6)


def test_weights(spark):
    df = spark.createDataFrame([("A",)] * 6 + [("B",)] * 3 + [("U",)], "r string")
    areas = spark.createDataFrame([("A", 30.0), ("B", 60.0)], "r string, area double")
    out = {r.r: r for r in sampling.area_weights(df, areas, "r").collect()}
    assert sum(r.weight * r.n for r in out.values()) == pytest.approx(10) and out["U"].weight == 0
    assert out["B"].weight / out["A"].weight == pytest.approx(4)


def test_shannon(spark):
    df = spark.createDataFrame([(1, 1, "a")] * 3 + [(1, 2, "a")], "tile int, label int, region string")
    r = row(stats.label_stats(df, "tile", "label", "region", [1, 2]))
    assert (r["ratio_1"], r["ratio_2"], r["shannon"]) == pytest.approx((0.75, 0.25, 0.562335), abs=1e-6)


def test_scaling(spark):
    df = spark.createDataFrame([(x,) for x in (-0.2, 0.0, 0.3, 1.0, 1.7)], "x double")
    assert [r[0] for r in df.select(sc.scale(F.col("x"), 0, 1)).collect()] == [0, 0, 19660, 65535, 65535]
    p = spark.createDataFrame([(-1.0,)], "x double").withColumn("u", sc.scale_phase(F.col("x"))).withColumn("p", sc.unscale_phase(F.col("u"))).withColumn("q", sc.unscale_phase(F.col("u"), True)).first()
    assert p.u == 22337 and p.p == pytest.approx(2.141566, abs=1e-5) and math.cos(p.p) == pytest.approx(-0.540280, abs=1e-5) and p.q == pytest.approx(-1.0, abs=1e-4)
    assert [r[0] for r in spark.createDataFrame([(2.5 / 255,), (3.5 / 255,)], "x double").select(sc.to_byte(F.col("x"))).collect()] == [2, 4]
    with pytest.raises(ValueError):
        sc.kind_of("ndvi_slope")


def test_indices(spark):
    bands = spark.createDataFrame([(300.0, 400.0, 2400.0, 1500.0, 800.0)], "b2 double, b4 double, b8 double, b11 double, b12 double")
    r = row(bands.select(*[x.alias(n) for n, x in ix.all_indices(*[F.col(b) for b in ("b2", "b4", "b8", "b11", "b12")]).items()]))
    assert r == pytest.approx({"ndvi": 0.714286, "evi": 1.0, "nbr": 0.5, "crswir": 1.007775}, abs=1e-5)


def test_sanitising(spark):
    df = spark.createDataFrame([([float("inf"), float("-inf"), float("nan"), 2.0],)], "v array<double>")
    r = df.select(sc.sanitised(F.col("v")).alias("a"), sc.clipped(F.col("v")).alias("b"), sc.guarded(F.col("v")).alias("c")).first()
    assert (r.a, r.b, r.c) == ([0, 0, 0, 1], [1, -1, 0, 1], [None, None, None, 1])


def test_forest_class(spark):
    df = spark.createDataFrame([(1, 128), (1, 127), (0, 200), (1, 255)], "m int, p int")
    assert [r[0] for r in df.select(ix.forest_class(F.col("m"), F.col("p"))).collect()] == [1, 2, 0, 0]
    soft = df.select(*[x.alias(n) for n, x in ix.soft_labels(F.col("m"), F.col("p")).items()])
    assert all(abs(sum(r) - 255) <= 1 for r in soft.collect())


def _year(spark, y):
    dates = [f"2023-{m:02d}-15" for m in range(1, 13)]
    t = np.array([(np.datetime64(d) - np.datetime64(dates[0])).astype(int) / 365.25 for d in dates])
    return spark.createDataFrame([(1, k, d, float(v), 1.0) for k in range(2) for d, v in zip(dates, y(t), strict=True)], "tile int, pixel int, d string, y double, w double").withColumn("date", F.to_date("d"))


def test_harmonics(spark):
    df = _year(spark, lambda t: 0.6 + 0.25 * np.cos(2 * np.pi * t - 0.8) + 0.05 * np.cos(4 * np.pi * t + 0.5))
    want = {"amplitude_h1": 0.25, "amplitude_h2": 0.05, "phase_h1": 0.8, "phase_h2": -0.5, "offset": 0.6}
    robust = row(harmonic.robust_fit(df, ["tile"], ["pixel"], "date", "y", "w"))
    assert {k: robust[k] for k in want} == pytest.approx(want, abs=1e-6) and robust["var_residual"] == pytest.approx(0, abs=1e-10)
    fit = harmonic.solved(harmonic.moments(harmonic.years_since_first(df, ["tile"], "date"), ["tile", "pixel"], "y", "w"))
    assert row(fit.select(*[x.alias(n) for n, x in harmonic.features(fit).items()])) == pytest.approx(want, abs=1e-6)


def test_robust_fit_resists_outliers_and_gaps():
    t = np.arange(24) / 12
    y = 1 + 0.5 * np.cos(2 * np.pi * t)
    cube = np.stack([y, y, np.full(24, np.nan)], axis=1)
    cube[3, 0] = 9.0
    cube[5:8, 1] = np.nan
    steps = []
    out = harmonic.fit_series(cube, np.ones_like(cube), t, 2, 100, None, on_step=lambda i, p: steps.append(p))
    plain = harmonic.fit_series(cube, np.ones_like(cube), t, 2, 0)
    assert abs(out[0, 0] - 0.5) < abs(plain[0, 0] - 0.5) / 5 and out[1, :1] == pytest.approx([0.5], abs=1e-6) and np.isnan(out[2]).all() and len(steps) == 100


GRID = ["1120", "1220", "0112", "2012"]


def cells(spark):
    return spark.createDataFrame([(1, r, k, int(v)) for r, line in enumerate(GRID) for k, v in enumerate(line)], "tile int, row int, col int, value int")


def test_edges_and_patches(spark):
    r = row(raster.edge_density(cells(spark), ["tile"]))
    assert r["edges"] == 7 and r["area_km2"] == pytest.approx(0.0012) and r["edge_density"] == pytest.approx(58333.333333)
    found = {r["class"]: r.patches for r in raster.patches(cells(spark), ["tile"]).collect()}
    assert found == {1: 1, 2: 2}
    assert sum(r.per_100km2 for r in raster.patches(cells(spark), ["tile"]).collect()) == pytest.approx(250000)
    empty = row(raster.edge_density(spark.createDataFrame([(1, 0, 0, 0)], "tile int, row int, col int, value int"), ["tile"]))
    assert empty["edge_density"] is None and empty["valid"] == 0


def test_windows_and_mode(spark):
    w = raster.windows(spark, 5, 3, 2).collect()
    assert len(w) == 6 and w[-1].asDict() == {"row_off": 4, "col_off": 2, "height": 1, "width": 1}
    g = spark.createDataFrame([(r, k, v) for r, k, v in ((0, 0, 2), (0, 1, 1), (1, 1, 2), (2, 2, 1), (1, 0, 0))], "row int, col int, eco int")
    centres = spark.createDataFrame([(1, 1), (9, 9)], "row int, col int")
    assert {(r.row, r.v) for r in raster.centre_mode(g, centres, "eco").collect()} == {(1, 1), (9, 0)}


def test_weighted_r2(spark):
    df = spark.createDataFrame([(1.0, 1.1, 1.0), (2.0, 1.9, 2.0), (3.0, 3.2, 1.0), (4.0, 3.7, 2.0)], "y double, p double, w double")
    assert row(similarity.weighted_r2(df, "y", "p", "w"))["r2"] == pytest.approx(0.965909, abs=1e-6)
    assert row(similarity.weighted_r2(df.withColumn("w", F.lit(0.0)), "y", "p", "w"))["r2"] is None
    assert row(similarity.weighted_r2(df.withColumn("w", F.lit(0.0)), "y", "p", "w", unit_weights=True))["r2"] == pytest.approx(1 - 0.15 / 5)


def test_ridge_from_sums_equals_ridge_on_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = x @ [1.0, -2.0] + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([("r", int(k % 8), float(a), float(b), float(v), 1.0) for k, ((a, b), v) in enumerate(zip(x, y, strict=True))], "eco string, tile int, a double, b double, y double, w double")
    r2 = similarity.ridge_similarity(df, "eco", "tile", ["a", "b"], ["y"], "w").collect()
    assert len(r2) == 8 and min(r.r2 for r in r2) > 0.98 and r2[0].coefficients == pytest.approx([1 / 3, 2 / 3], abs=0.05)


def test_fold_sizes(spark):
    df = spark.createDataFrame([("a", k) for k in range(7)] + [("b", 100 + k) for k in range(3)], "eco string, tile int")
    sizes = {}
    for r in sampling.balanced_folds(df, "eco", "tile", 5).collect():
        sizes.setdefault(r.eco, {}).setdefault(r.fold, []).append(r.tile)
    assert sorted(map(len, sizes["a"].values()), reverse=True) == [2, 2, 1, 1, 1] and len(sizes["b"]) == 3


def test_quartiles_and_correlations(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (10.0, 5.0)], "x double, y double")
    r = row(df.agg(*c.spread("x")))
    assert (r["x_q25"], r["x_median"], r["x_q75"]) == (1.75, 2.5, 4.75)
    t = row(stats.correlation_table(df, ["x"], ["y"]))
    assert t["spearman"] == pytest.approx(0.8) and t["pearson"] == pytest.approx(np.corrcoef([1, 2, 3, 10], [1, 4, 9, 5])[0, 1])
    assert row(stats.correlation(df.withColumn("y", F.lit(1.0)), "x", "y"))["r"] is None


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    x, y = geo.centroid(ring)
    r = spark.range(1).select(geo.area(ring).alias("a"), x.alias("x"), y.alias("y"), geo.contains(ring, F.lit(1.0), F.lit(1.0)).alias("i"), geo.contains(ring, F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (r.a, r.x, r.y, r.i, r.o) == (12, 2, 1.5, True, False)
    import struct

    wkb = struct.pack("<BIII10d", 1, 3, 1, 5, 0, 0, 4, 0, 4, 3, 0, 3, 0, 0)
    out = geo.wkb_centroid(spark.createDataFrame([(1, bytearray(wkb)), (2, None)], "k int, g binary"), "k", "g").collect()
    assert (out[0].x, out[0].y) == (2, 1.5) and out[1].x is None


def test_overlaps_report_each_pair_once(spark):
    rng = np.random.default_rng(2)
    boxes = [[(k, *p, p[0] + float(rng.uniform(0, 9)), p[1] + float(rng.uniform(0, 9))) for k, p in enumerate(map(tuple, rng.uniform(-20, 20, (40, 2)).tolist()))] for _ in range(2)]
    a, b = (spark.createDataFrame(x, f"id_{s} int, xmin double, ymin double, xmax double, ymax double") for x, s in zip(boxes, "ab", strict=True))
    got = sorted(map(tuple, geo.overlapping(a, b, 3.0).collect()))
    want = sorted((p[0], q[0]) for p in boxes[0] for q in boxes[1] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert got == want


def test_reference_set(spark):
    square = lambda i, r0, c0, n, p: [(i, r, k, p) for r in range(r0, r0 + n) for k in range(c0, c0 + n)]
    schema = "id int, row int, col int, phenology int"
    in_situ = spark.createDataFrame(square(1, 0, 0, 4, 1), schema)
    more = spark.createDataFrame(square(2, 20, 20, 3, 2) + square(3, 2, 2, 4, 2) + square(4, 3, 0, 9, 1), schema)
    out = geo.reference_set(in_situ, more, 1).collect()
    kept = {i: {(r.row, r.col) for r in out if r.id == i} for i in (1, 2, 3, 4)}
    assert len(kept[1]) == 16 and len(kept[2]) == 9 and not kept[3]
    assert kept[4] == {(r, k) for r in range(4, 11) for k in range(1, 8)} - {(r, k) for r in range(5) for k in range(4)}


def test_farthest_selection(spark):
    tiles = spark.createDataFrame([(k, "a", float(k), 0.0, 1.0, 3, k == 0) for k in range(11)], "tile_id int, eco string, x double, y double, effective_pixels double, needed int, chosen boolean")
    out = [r.tile_id for r in sorted(geo.farthest_selection(tiles, "eco", "needed", 2.0).collect(), key=lambda r: r.step)]
    assert out == [10, 5, 2]
    rows = [(k, "ab"[k % 2], float(k), 0.0, 1.0, 2, False) for k in range(12)] + [(20, None, 0.0, 0.0, 1.0, 1, False)]
    out = geo.farthest_selection(spark.createDataFrame(rows, tiles.schema), "eco", "needed", 2.0).collect()
    assert {(r.eco, r.step, r.tile_id) for r in out} == {("a", 1, 0), ("a", 2, 10), ("b", 1, 1), ("b", 2, 11)}
    assert not geo.farthest_selection(tiles.limit(0), "eco", "needed", 2.0).collect()


def test_edges_between_blocks(spark, monkeypatch):
    value = lambda r, c: (r * 7 + c * 5) % 3
    edges = sum(value(r, c) != value(*n) and value(r, c) > 0 < value(*n) for r in range(9) for c in range(9) for n in ((r + 1, c), (r, c + 1)) if max(n) < 9)
    table = spark.createDataFrame([(r, c, value(r, c)) for r in range(9) for c in range(9)], "row int, col int, value int")
    for block in (1, 2, 4, 512):
        monkeypatch.setattr(raster, "EDGE_BLOCK", block)
        assert raster.edge_density(table, []).first().edges == edges > 0


def test_incomplete_features_go(spark):
    rows = [(1, 1.0, 2.0), (2, float("nan"), 1.0), (1, None, 1.0), (2, float("-inf"), 1.0), (2, 3.0, 4.0)]
    out = ml.labelled(spark.createDataFrame(rows, "y_true int, a double, b double"), "y_true", ["a", "b"])
    assert sorted((r.label, r.a, r.b) for r in out.collect()) == [(0.0, 1.0, 2.0), (1.0, 3.0, 4.0)]
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == "true"


def test_relations(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        relations.one_to_one(a, a, ["k"])
    assert relations.codes(a, "v").orderBy("v").collect()[1].code == 2
    out = relations.suffixed(a.limit(1), a.limit(1), ["k"], ("_a", "_b"))
    assert out.columns == ["k", "v_a", "v_b"]


def test_band_stats(spark):
    df = spark.createDataFrame([(0.0, 1.0), (300.0, 0.0), (500.0, 0.0)], "b2 double, b4 double").withColumn("b8", F.lit(0.0))
    r = {x.feature: x for x in qa.band_stats(df, [], ["b2", "b4", "b8"]).collect()}
    assert r["b2"].mean == 400 and r["b2"].std == 100 and r["b2"].no_data_pct == pytest.approx(100 / 3) and r["b8"].no_data_pct == 100 and r["b8"].mean is None


def test_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k % 20), int(1 + (a + b > 0)), float(a), float(b), float(rng.normal()), 1 + k % 2) for k, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "tile_id int, y_true int, a double, b double, c double, fold int")
    held = ml.out_of_fold(df, ml.forest(10, 4), ["a", "b", "c"], 2)
    assert held.count() == 400 and ml.accuracy(held).first().accuracy > 0.85
    assert held.filter("abs(prob_class_1 + prob_class_2 - 1) > 1e-9").count() == 0
    curve = ml.elimination(df, ml.forest(5, 4), ["a", "b", "c"], 2, step=1, least=2)
    assert [x["n_features"] for x in curve] == [3, 2] and curve[-1]["features"] == sorted(curve[-1]["features"], key=lambda f: -curve[0]["importances"][f]) and "c" not in curve[-1]["features"]
    model = ml.model_of(ml.forest(5, 3), ["a", "b"]).fit(ml.labelled(df, "y_true", ["a", "b"]))
    ml.save_model(model, ["a", "b"], f"file://{tmp_path}/m")
    again, features = ml.load_model(spark, f"file://{tmp_path}/m")
    assert features == ["a", "b"] and ml.parameter_count(again) == ml.parameter_count(model)
    assert ml.infer(again, df.withColumn("a", F.lit(float("inf"))).drop("b"), features).filter("prob_byte between 0 and 255").count() == 400


def test_monge_map_moves_moments(spark):
    rng = np.random.default_rng(2)
    source = rng.normal(size=(500, 2)) @ [[2.0, 0.3], [0.0, 1.0]] + [5, -1]
    target = rng.normal(size=(500, 2)) @ [[1.0, -0.5], [0.0, 0.5]]
    s, t = (spark.createDataFrame(x.tolist(), "a double, b double") for x in (source, target))
    moved = np.array(ml.aligned(s, t, ["a", "b"]).select("a", "b").collect())
    assert moved.mean(axis=0) == pytest.approx(target.mean(axis=0), abs=1e-6) and np.cov(moved.T) == pytest.approx(np.cov(target.T), abs=1e-3)


def test_robust_fit_makes_no_pixels(spark):
    days = [f"2023-{m:02d}-15" for m in range(1, 13)]
    rows = [(1, r, c, d, float(10 + (k % 4) + r), 1.0) for r, c in ((0, 0), (5, 9)) for k, d in enumerate(days)]
    rows += [(1, 5, 9, days[0], None, 1.0)]
    df = spark.createDataFrame(rows, "tile int, row int, col int, date string, y double, w double").withColumn("date", F.to_date("date"))
    out = {(r.row, r.col): r for r in harmonic.robust_fit(df, ["tile"], ["row", "col"], "date", "y", "w").collect()}
    assert set(out) == {(0, 0), (5, 9)} and abs(out[5, 9].offset - out[0, 0].offset - 5) < 1e-6


def test_grids_meet_by_index(spark):
    cells = spark.createDataFrame([(r, k) for r in range(4) for k in range(4)], "row int, col int")
    mask = spark.createDataFrame([(10 + r, 20 + k, 7) for r in (1, 2) for k in (0, 3)], "row int, col int, v int")
    placed = raster.placed_in_block(cells, mask, "v", 10, 20, -1)
    assert {(r.row, r.col) for r in placed.filter("v = 7").collect()} == {(1, 0), (1, 3), (2, 0), (2, 3)} and placed.count() == 16
    coarse = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3)], "row int, col int, v int")
    got = {(r.row, r.col): r.v for r in raster.resampled(cells, coarse, "v", 10.0, 20.0).collect()}
    assert got == {(r, k): {(0, 0): 1, (0, 1): 2, (1, 0): 3}.get((r // 2, k // 2)) for r in range(4) for k in range(4)}
    part = raster.cropped(cells, (15.0, 0.0, 30.0, 11.0), 10.0)
    assert {(r.row, r.col) for r in part.collect()} == {(r, k) for r in (0, 1) for k in (0, 1)}


def test_coherence_of_a_tile(spark):
    grid = [[1, 1, 0, 2], [0, 1, 2, 2], [1, 0, 0, 0]]
    cells = spark.createDataFrame([(1, r, k, v) for r, line in enumerate(grid) for k, v in enumerate(line)] + [(2, 0, 0, 0)], "tile int, row int, col int, value int")
    out = {r.tile: r for r in raster.coherence(cells, ["tile"]).collect()}
    r = out[1]
    assert (r.patch_count_deciduous, r.patch_count_evergreen, r.patch_count_total) == (1, 1, 2)
    assert math.isclose(r.area_km2, 7e-4) and math.isclose(r.forest_fraction, 7 / 12) and math.isclose(r.edge_density, 10 / 7e-4) and math.isclose(r.patch_density_total, 200 / 7e-4)
    assert out[2].forest_fraction == 0 and out[2].edge_density is None and out[2].patch_count_total is None and out[2].area_km2 is None


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 5)) + 1e4
    df = spark.createDataFrame([(k % 3, *map(float, v)) for k, v in enumerate(x)] + [(0, None, 1.0, 1.0, 1.0, 1.0)], "d int, a double, b double, c double, e double, f double")
    for (d,), (mean, cov) in ml._moments(df, list("abcef"), ["d"]).items():
        part = x[d::3]
        assert np.allclose(mean, part.mean(axis=0)) and np.allclose(cov, np.cov(part.T, bias=True))


def test_schema_guards(spark):
    from canopy import schemas

    a, b = (spark.createDataFrame([(k,) for k in v], "k int") for v in ((1, 2, -3, None), (3, 4)))
    schemas.require_disjoint(a, b, ["k"])
    with pytest.raises(ValueError):
        schemas.require_disjoint(a, spark.createDataFrame([(2,)], "k int"), ["k"])
    assert sorted(r.k for r in schemas.positive_targets(a, "k").collect()) == [1, 2]
    assert schemas.column_report(b, ["k", "x"]) == {"k": [3, 4], "x": None}
    assert schemas.band_of(["a", "b"], ["b", "z"], "none") == {"b": 2, "z": None}
    with pytest.raises(ValueError):
        schemas.band_of(["a"], ["z"])


def test_quantiles_equal_numpy(spark, monkeypatch):
    from canopy.operators import quantiles as qu

    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=997), "b": np.full(300, 2.5), None: rng.integers(0, 5, 400).astype(float), "one": np.array([-7.0]), "two": np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    for pieces, small in ((2, 0), (5, 350), (64, 0), (64, 200_000)):
        monkeypatch.setattr(qu, "PIECES", pieces)
        monkeypatch.setattr(qu, "SMALL", small)
        got = {r.g: (r.n, r.q) for r in qu.quantiles(df, ["g"], "v", shares).collect()}
        assert set(got) == set(values)
        for g, vs in values.items():
            assert got[g][0] == len(vs) and got[g][1] == pytest.approx(np.quantile(vs, shares).tolist(), abs=1e-12)
        every = qu.quantiles(df, [], "v", shares).collect()
        assert len(every) == 1 and every[0].q == pytest.approx(np.quantile(np.concatenate(list(values.values())), shares).tolist(), abs=1e-12)
    assert qu.quantiles(df.limit(0), [], "v", [0.5]).count() == 0
    out = qu.with_quantiles(df.groupBy("g").count(), df, ["g"], "v", {"median": 0.5})
    assert {r.g: r.median for r in out.collect()}["empty"] is None and out.count() == 6
    assert stats.stretched(spark.createDataFrame([(1, -1.0)], "k int, v double"), "v").count() == 1


def test_touched_cells(spark):
    cells = spark.createDataFrame([(r, k) for r in range(8) for k in range(8)], "row int, col int")
    ring = [(1.2, 1.2), (5.1, 1.6), (2.2, 4.3)]
    thin = [(6.4, 5.0), (6.6, 5.0), (6.6, 7.9), (6.4, 7.9)]
    polygons = spark.createDataFrame([(ring,), (thin,)], "ring array<struct<x:double,y:double>>")
    x, y = F.col("col") + 0.5, F.col("row") + 0.5

    def inside(points, px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    fine = (np.arange(200) + 0.5) / 200
    want = {(r, k) for r in range(8) for k in range(8) for p in (ring, thin) if any(inside(p, k + a, r + b) for a in fine[::5] for b in fine[::5]) or inside(p, k + 0.5, r + 0.5)}
    got = {(r.row, r.col) for r in raster.touched(cells, polygons, x, y, 1.0).collect() if r.value}
    assert want <= got and all(any(abs(k + 0.5 - px) <= 0.5 and abs(r + 0.5 - py) <= 0.5 for p in (ring, thin) for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]) for t in np.linspace(0, 1, 2001) for px, py in [(ax + t * (bx - ax), ay + t * (by - ay))]) for r, k in got - want)
    centres = {(r.row, r.col) for r in raster.touched(cells, polygons, x, y, 1.0, all_touched=False).collect() if r.value}
    assert centres == {(r, k) for r in range(8) for k in range(8) for p in (ring, thin) if inside(p, k + 0.5, r + 0.5)} < got


def test_splits_with_fallbacks(spark):
    rows = [(k, "ab"[k % 2], k % 4 if k else 9) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, region string, label int")
    split, used = sampling.split_with_fallbacks(df, ["region", "label"], ["k"], 0.7)
    assert used == ["region"] and split.filter("part = 'train'").groupBy("region").count().collect()[0]["count"] == 14
    assert sampling.split_with_fallbacks(df.filter("k > 0"), ["region", "label"], ["k"], 0.7)[1] == ["region", "label"]
    split, used = sampling.split_with_fallbacks(df, ["k"], ["k"], 0.5)
    assert used == [] and split.count() == 40 and split.select("part").distinct().count() == 2


def test_folds_borrow_a_tile(spark):
    tiles = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "tile int, fold int")
    rows = {(r.fold, r.tile): r.part for r in sampling.fold_splits(tiles, "tile", 4).collect()}
    assert len(rows) == 12 and rows[1, 1] == rows[1, 2] == rows[2, 3] == "val"
    assert [sum(rows[f, t] == "val" for t in (1, 2, 3)) for f in (1, 2, 3, 4)] == [2, 1, 1, 1]


def test_names_of_features():
    from canopy import schemas

    assert len(schemas.feature_names()) == 32 and schemas.feature_names(["evi"], circular=False) == [f for f in schemas.HARMONIC_FEATURES if f.startswith("evi_")]
    assert schemas.feature_names(["ndvi"])[2:6] == ["ndvi_phase_h1_cos", "ndvi_phase_h1_sin", "ndvi_phase_h2_cos", "ndvi_phase_h2_sin"]
    assert schemas.feature_names(selected=["nbr_offset", "nbr_phase_h1", "evi_phase_h2_cos"]) == ["nbr_offset", "nbr_phase_h1_cos", "nbr_phase_h1_sin", "evi_phase_h2_cos"]


def test_context_and_first_values(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    context = spark.createDataFrame([(1, "cx", 5.0), (2, "cy", None)], "k int, v string, w double")
    assert sorted(map(tuple, relations.with_context(left, context, ["k"]).collect())) == [(1, "x", "cx", 5.0), (2, "y", "cy", None), (3, "z", None, None)]
    with pytest.raises(ValueError, match="duplicate"):
        relations.with_context(left, context.union(context), ["k"])
    df = spark.createDataFrame([("a", 2, 0.2), ("a", 1, None), ("a", 3, 0.1), ("b", 1, None), (None, 1, 0.3)], "g string, o int, w double")
    assert [tuple(r) for r in relations.first_of_group(df, "g", "w", ["o"]).collect()] == [("a", 0.2)]

"""Extra trees, ranks of any length, adaptation by folds and regional scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import extra_trees, ml, ranks, relations, stats
from canopy.plans import models


def _blobs(spark, n=900, seed=1, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = ((x[:, 0] + x[:, 1] + 0.3 * x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(int) + 1
    rows = [(k, *map(float, x[k] + shift), int(y[k]), k % 3 + 1, f"r{k % 2}", 1.0 + k % 4) for k in range(n)]
    return spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double, y_true int, fold int, region string, w double")


FEATURES = list("abcde")


def test_extra_trees_are_as_good_as_a_forest(spark):
    df = _blobs(spark)
    score = lambda e: ml.fold_metrics(ml.out_of_fold(df, e, FEATURES, 3), []).first()["f1_macro"]
    forest, extra = score(ml.forest(20, 6)), score(extra_trees.ExtraTrees(numTrees=20, maxDepth=7))
    assert extra > forest - 0.02 and extra > 0.8


def test_extra_trees_do_not_depend_on_how_rows_are_dealt(spark):
    df = ml.labelled(_blobs(spark, 300), "y_true", FEATURES)
    one = ml.model_of(extra_trees.ExtraTrees(numTrees=5, maxDepth=5, weightCol="w"), FEATURES)
    a, b = (one.fit(d).stages[-1].model for d in (df.coalesce(1), df.repartition(7)))
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "cut", "left", "roots")) and np.allclose(a.weight, b.weight)
    other = ml.model_of(extra_trees.ExtraTrees(numTrees=5, maxDepth=5, seed=7), FEATURES).fit(df).stages[-1].model
    assert not np.array_equal(a.cut[:5], other.cut[:5])
    assert (np.diff(a.roots) == 1).all() and a.weight[a.roots].sum(1) == pytest.approx(df.agg(F.sum("w")).first()[0])
    inner = np.flatnonzero(a.feature >= 0)  # a node's classes are those of its children
    assert np.allclose(a.weight[inner], a.weight[a.left[inner]] + a.weight[a.left[inner] + 1])


def test_the_driver_gets_a_row_an_open_node(spark, monkeypatch):
    df, sent = ml.labelled(_blobs(spark, 600), "y_true", FEATURES).repartition(5), []
    kind = type(df)
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: sent.append(plain(self)) or sent[-1])
    model = ml.model_of(extra_trees.ExtraTrees(numTrees=4, maxDepth=5), FEATURES).fit(df).stages[-1].model
    assert (model.feature >= 0).sum() > 20 and sum(t.num_rows for t in sent) == len(model.feature)


def test_extra_trees_by_hand():
    t = extra_trees.Trees(np.array([0, -1, -1]), np.array([1.5, 0, 0]), np.array([1, -1, -1]), np.array([[3.0, 1], [3, 0], [0, 1]]), np.array([0]))
    assert t.leaves(np.array([[1.5], [2.0]])).tolist() == [[1], [2]] and t.probabilities(np.array([[1.0], [9.0]])).tolist() == [[1, 0], [0, 1]]


def test_extra_trees_of_one_class_and_constant_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, 1)] * 9 + [(1.0, 2.0, 1, 2)] * 9, "a double, b double, y_true int, fold int")
    out = ml.out_of_fold(df, extra_trees.ExtraTrees(numTrees=3), ["a", "b"], 2).collect()
    assert len(out) == 18 and {(r.y_pred, r.prob_class_1) for r in out} == {(1, 1.0)}


def test_tuner_runs_whole_grids(spark):
    out = ml.tune(_blobs(spark, 150), {"extra": (extra_trees.ExtraTrees(numTrees=3), [{"maxDepth": 2}, {"maxDepth": 6}]), "logistic": (ml.estimators()["logistic"][0], [{"regParam": 0.1}])}, FEATURES, 3)
    assert len(out) == 3 and sorted(x["mean"] for x in out)[::-1] == [x["mean"] for x in out] and all(x["tn"] + x["fp"] + x["fn"] + x["tp"] == 150 for x in out)
    assert sum(len(grid) for _, grid in ml.estimators().values()) == 19


def test_average_ranks_across_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 400), ("b", 3), (None, 120)) for v in rng.integers(0, 60, n)] + [("a", None), ("b", math.nan), ("a", -0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v if not math.isnan(r.v) else "nan"): r["rank"] for r in ranks.average_ranks(df, ["g"], "v").collect()}
    for g in ("a", "b", None):
        values = np.array([v for k, v in rows if k == g and v is not None])
        for v in set(values[~np.isnan(values)].tolist()):
            assert got[g, v] == (values < v).sum() + ((values == v).sum() + 1) / 2
    assert got["b", "nan"] == 4


def test_correlations_by_ranges_equal_those_by_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 2, int(a), float(b), float(a + b) if k % 7 else None) for k, (a, b) in enumerate(zip(rng.integers(0, 9, 300), rng.normal(size=300), strict=True))]
    df = spark.createDataFrame(rows, "g int, x int, y double, z double")
    a, b = ({(r.g, r.target, r.covariate): (r.n, round(r.pearson, 9), round(r.spearman, 9)) for r in stats.correlation_table(df, ["x"], ["y", "z"], ["g"], any_length=k).collect()} for k in (False, True))
    assert a == b and len(a) == 4


def test_numbers_by_ranges_equal_those_by_windows(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{k * 37 % 101}",) for k in range(200)], "v string")
    found = []
    for limit in (ranks.WINDOW_ROWS, 0):
        monkeypatch.setattr(ranks, "WINDOW_ROWS", limit)
        found.append(sorted(map(tuple, relations.codes(df, "v").collect())))
    assert found[0] == found[1] and [c for _, c in found[0]] == list(range(1, 102))


def test_adaptation_moves_shifted_regions_together(spark):
    near, far = _blobs(spark, 400, 1), _blobs(spark, 400, 2, shift=6.0).withColumn("region", F.lit("far"))
    df = near.withColumn("region", F.lit("near")).unionByName(far)
    score = lambda held: {r.region: r.f1_macro for r in ml.fold_metrics(held, ["region"]).collect()}
    only = score(ml.transfer(df, ml.forest(20, 8), FEATURES, F.col("region") == "near"))
    adapted = score(ml.adapted_folds(df, ml.forest(20, 8), FEATURES, "region", 3))
    assert adapted["far"] > 0.75 > only["far"] and adapted["near"] > 0.75
    assert ml.adapted_folds(df, ml.forest(2, 2), FEATURES, "region", 3).count() == 800


def test_elimination_scores_regions_and_saves_the_best(spark, tmp_path):
    curve = ml.elimination(_blobs(spark, 300), ml.forest(10, 6), FEATURES, 3, step=[2], least=2, region="region")
    assert [x["n_features"] for x in curve] == [5, 2] and all(set(x["regions"]) == {"r0", "r1"} for x in curve)
    assert all(min(x["regions"].values()) - 0.05 <= x["mean"] <= max(x["regions"].values()) + 0.05 and x["tn"] + x["fp"] + x["fn"] + x["tp"] == 300 for x in curve)
    best = ml.save_top_features(spark, curve, 2, f"{tmp_path}/top")
    assert set(best) == {"a", "b"} and [r.value for r in spark.read.text(f"{tmp_path}/top").collect()] == best


def test_tables_are_let_go(spark):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = _blobs(spark, 60)
    ml.out_of_fold(df, ml.forest(2, 2), FEATURES, 3).count()
    ml.adapted_folds(df, ml.forest(2, 2), FEATURES, "region", 3).count()
    ml.pca(df, FEATURES)[0].count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_rows_are_kept_in_few_parts(spark):
    parts = 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("f")).repartition(50 * parts, "id")
    kept = ml.complete(rows, ["f"])
    assert kept.rdd.getNumPartitions() <= parts and kept.count() == 1000
    kept.unpersist()


def test_halving_runs_few_tasks_a_stage(spark):
    sc, grid = spark.sparkContext, [{"numTrees": t, "maxDepth": d} for t in (2, 4) for d in (2, 4)]
    few = 2 * sc.defaultParallelism
    rows = _blobs(spark, 900).repartition(20 * few, "k")
    sc.setJobGroup("halving", "stages of a halving search")
    try:
        out = ml.halving(rows, ml.forest(2, 2), FEATURES, grid, folds=3)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("halving") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s]
    assert len(tasks) > 50 and max(tasks) <= 3 * few  # the held-out rows of three folds are read in one stage
    assert [r for _, _, r in out] == [1, 0, 0, 0, 0] and out[0][0] == out[1][0] and [x for _, x, _ in out[1:]] == sorted((x for _, x, _ in out[1:]), reverse=True)


@pytest.fixture
def scored(monkeypatch):
    """How many rows each call of ``ml.fold_metrics`` scores."""
    seen, plain = [], ml.fold_metrics
    monkeypatch.setattr(ml, "fold_metrics", lambda held, by=("fold",): seen.append(held.count()) or plain(held, by))
    return seen


@pytest.mark.parametrize(("settings", "factor", "rounds"), [(1, 3, [0]), (4, 3, [1, 0, 0, 0, 0]), (5, 2, [2, 1, 1, 0, 0, 0, 0, 0])])
def test_halving_ends_on_all_rows(spark, scored, settings, factor, rounds):
    out = ml.halving(_blobs(spark, 600), ml.forest(1, 1), FEATURES, [{"maxDepth": d} for d in range(1, settings + 1)], folds=3, factor=factor)
    assert [r for _, _, r in out] == rounds and scored[-1] == 600
    for n, r in zip(scored, reversed(rounds), strict=True):
        assert n == pytest.approx(600 * factor ** (r - max(rounds)), rel=0.25)


def test_halving_search_scores_every_row(spark, scored):
    assert models.halving_search(spark, "/root/testdata/sf0.001").count() == 5
    assert scored[-1] == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_adaptation_reads_rows_once_for_its_maps(spark, monkeypatch):
    df, asked, plain = _blobs(spark), [], ml._products
    monkeypatch.setattr(ml, "_products", lambda *a: asked.append(plain(*a)) or asked[-1])
    ml.adapted_folds(df, ml.forest(3, 3), FEATURES, "region", 3).count()
    (centre, sums), = asked
    rows = df.filter("fold <> 2 AND region = 'r1'").toPandas()[FEATURES].to_numpy()
    mean, cov = ml._moments_of(centre, sums[1, "r1"] + sums[3, "r1"])
    assert mean == pytest.approx(rows.mean(0)) and cov == pytest.approx(np.cov(rows.T, ddof=0))

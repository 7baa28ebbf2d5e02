"""Queries on models; they have no SQL twin, and tests hold them to invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from canopy.operators import classification as c
from canopy.operators import harmonic as hm
from canopy.operators import ml
from canopy.operators import sampling as s
from canopy.operators.lineage import cut
from canopy.operators.patching import features_of
from canopy.plans.proxies import rounded, table
from canopy.plans.registry import query
from canopy.plans.spatial import _bands
from canopy.schemas import INDICES

_FEATURES = [f"e{k}" for k in range(64)]


def _samples(spark, sf_dir):
    """Embeddings as labelled pixels with folds."""
    e = table(spark, sf_dir, "embeddings")
    df = e.select("vec_id", F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string")).alias("eco_region"), (F.col("vec_id") % 30).alias("tile_id"), F.when(F.col("label") < 5, 1).otherwise(2).alias("y_true"), *[F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(_FEATURES)])
    folds = s.balanced_folds(df.select("eco_region", "tile_id"), "eco_region", "tile_id", 3)
    return s.with_folds(df, folds, "tile_id")


@query()
def rf_cv_metrics(spark, sf_dir):
    """Random forest by folds, with class weights."""
    df = ml.class_balanced(_samples(spark, sf_dir), "y_true")
    return rounded(ml.fold_metrics(ml.out_of_fold(df, ml.forest(10, 5, "class_weight"), _FEATURES, 3)))


@query()
def lr_cv_metrics(spark, sf_dir):
    """L1 logistic regression on scaled features by folds."""
    df = _samples(spark, sf_dir)
    return rounded(ml.fold_metrics(ml.out_of_fold(df, ml.lasso(300.0), _FEATURES, 3, scaled=True)))


@query()
def rfe_curve(spark, sf_dir):
    """Scores of shrinking feature sets, over all and by region."""
    curve = ml.elimination(_samples(spark, sf_dir), ml.forest(5, 4), _FEATURES, 3, step=0.5, least=2, region="eco_region")
    rows = [(x["n_features"], ",".join(sorted(x["features"])), x["mean"], x["std"], *[x[k] for k in ("tn", "fp", "fn", "tp")], x["regions"]) for x in curve]
    return rounded(spark.createDataFrame(rows, "n_features int, features string, f1_mean double, f1_std double, tn long, fp long, fn long, tp long, f1_regions map<string,double>"))


@query()
def pca_2d(spark, sf_dir):
    """Two principal components; their signs are arbitrary, so squares are given."""
    out, _ = ml.pca(_samples(spark, sf_dir), _FEATURES)
    return rounded(out.select("vec_id", (F.col("pc1") ** 2).alias("pc1_squared"), (F.col("pc2") ** 2).alias("pc2_squared")))


@query()
def monge_alignment(spark, sf_dir):
    """Means and deviations after each region is moved onto the first one."""
    df = _samples(spark, sf_dir)
    moved = ml.aligned_domains(df, _FEATURES, "eco_region", df.filter("eco_region = 'r0'"))
    return rounded(moved.groupBy("eco_region").agg(F.count("*").alias("n"), *[f(x).alias(f"{x}_{n}") for x in _FEATURES[:2] for n, f in (("mean", F.avg), ("std", F.stddev_pop))]), 4)


@query()
def north_south_transfer(spark, sf_dir):
    """Trained in some regions, tested in the others."""
    df = _samples(spark, sf_dir)
    held = ml.transfer(df, ml.forest(10, 5), _FEATURES, F.col("eco_region").isin("r0", "r1"))
    return rounded(held.agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred"))).withColumns(c.binary_metrics()))


@query()
def calibration_cv(spark, sf_dir):
    """Reliability of out-of-fold probabilities."""
    held = ml.out_of_fold(_samples(spark, sf_dir), ml.forest(10, 5), _FEATURES, 3)
    return rounded(c.reliability(held.withColumn("prob", F.col("prob_class_2"))))


@query()
def halving_search(spark, sf_dir):
    """Successive halving over a small grid."""
    found = ml.halving(_samples(spark, sf_dir), ml.forest(5, 3), _FEATURES, [{"numTrees": t, "maxDepth": d} for t in (3, 6) for d in (2, 4)], folds=3)
    rows = [(str(sorted(p.items())), score, r) for p, score, r in found]
    return rounded(spark.createDataFrame(rows, "settings string, f1_macro double, round int"))


@query()
def tabular_tuner(spark, sf_dir):
    """All settings of all estimators on the same folds, the best first."""
    rows = [(x["name"], str(sorted(x["settings"].items())), x["mean"], x["std"], x["tn"], x["fp"], x["fn"], x["tp"]) for x in ml.tune(_samples(spark, sf_dir), ml.estimators(), _FEATURES, 3)]
    return rounded(spark.createDataFrame(rows, "name string, settings string, f1_mean double, f1_std double, tn long, fp long, fn long, tp long"))


@query()
def genus_cv_metrics(spark, sf_dir):
    """Random forest of several classes by folds."""
    df = _samples(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4 + 1).cast("int").alias("genus")), "vec_id")
    held = ml.out_of_fold(df, ml.forest(10, 5), _FEATURES, 3, y="genus")
    return rounded(c.multiclass_summary(c.per_class(held, "genus", "y_pred")))


@query()
def cross_year_metrics(spark, sf_dir):
    """Metrics in years that differ more and more from the one that the folds' models were trained in."""
    df = _samples(spark, sf_dir)
    years = df.withColumns({f: F.col(f) for f in _FEATURES}).select("*", F.explode(F.array(F.lit(2018), F.lit(2020), F.lit(2022))).alias("year"))
    drift = (2023 - F.col("year")) * 0.01
    years = years.withColumns({f: F.col(f) + drift for f in _FEATURES})
    return rounded(ml.fold_metrics(ml.frozen_folds(df, years, ml.forest(10, 5), _FEATURES, 3), ["year"]))


@query()
def aligned_transfer_metrics(spark, sf_dir):
    """Trained in one region moved onto the others, tested there."""
    df = _samples(spark, sf_dir)
    held = ml.aligned_transfer(df.filter("eco_region = 'r0'"), df.filter("eco_region <> 'r0'"), ml.forest(10, 5), _FEATURES)
    return rounded(held.agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred"))).withColumns(c.binary_metrics()))


@query()
def extra_trees_cv_metrics(spark, sf_dir):
    """Extremely randomised trees by folds."""
    return rounded(ml.fold_metrics(ml.out_of_fold(_samples(spark, sf_dir), ml.ExtraTrees(numTrees=20, maxDepth=8), _FEATURES, 3)))


@query()
def adapted_cv_metrics(spark, sf_dir):
    """Models of regions moved onto each other, by folds, scored by region."""
    held = ml.adapted_folds(_samples(spark, sf_dir), ml.forest(10, 5), _FEATURES, "eco_region", 3)
    return rounded(ml.fold_metrics(held, ["eco_region"]))


def _harmonics(spark, sf_dir):
    """The stored features of pixels with folds by tile; classes from the lines' tax, a genus from the tile."""
    stack = hm.feature_stack(_bands(spark, sf_dir), ["tile_id"], ["pixel"]).withColumn("eco_region", F.lit("all"))
    tax = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") % 16).alias("pixel")).agg(F.avg("l_tax").alias("tax"))
    labels = tax.select("tile_id", "pixel", F.when(F.col("tax") > 0.04, 2).otherwise(1).alias("y_true"), (F.col("tile_id") % 3 + 1).cast("int").alias("genus"))
    df = cut(stack.join(labels, ["tile_id", "pixel"]))
    return s.with_folds(df, s.balanced_folds(df.select("eco_region", "tile_id").distinct(), "eco_region", "tile_id", 3), "tile_id")


@query()
def index_cv_metrics(spark, sf_dir):
    """A forest on the harmonics of each index by itself, by folds."""
    df, parts = _harmonics(spark, sf_dir), []
    for index in INDICES:
        held = ml.out_of_fold(df, ml.forest(10, 5), features_of(df.columns, index), 3)
        parts.append(ml.fold_metrics(held).withColumn("index", F.lit(index)))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@query()
def genus_harmonic_metrics(spark, sf_dir):
    """A forest of several classes on the harmonics of all indices by folds."""
    df = _harmonics(spark, sf_dir)
    held = ml.out_of_fold(df, ml.forest(10, 5), [f for i in INDICES for f in features_of(df.columns, i)], 3, y="genus")
    return rounded(c.multiclass_summary(c.per_class(held, "genus", "y_pred")))

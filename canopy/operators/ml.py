"""Training, tuning, inference and transfer with Spark ML.

Models take the columns of a table by name; folds are columns made by ``canopy.operators.sampling``.
Extra trees are grown by ``canopy.operators.extra_trees``; kernel machines and neural networks are left out.  Tables that models read many
times are kept in memory until the result is written, which is read from the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import INF, clip, finite, ratio
from canopy.functions.scaling import to_byte
from canopy.operators import classification as c
from canopy.operators.extra_trees import ExtraTrees
from canopy.operators.lineage import cut

SEED = 42


def forest(trees: int = 50, depth: int = 10, weight: str | None = None, leaf: int = 1) -> RandomForestClassifier:
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED)
    return rf.setWeightCol(weight) if weight else rf


def estimators(weight: str | None = None) -> dict[str, tuple[object, list[dict]]]:
    """Estimators of the tabular tuner by name, with their grids."""
    lr = LogisticRegression(labelCol="label", maxIter=50)
    svm = LinearSVC(labelCol="label", maxIter=50)
    gbt = GBTClassifier(labelCol="label", maxIter=20, seed=SEED)
    for e in (lr, svm, gbt):
        if weight:
            e.setWeightCol(weight)
    return {
        "logistic": (lr, [{"regParam": r, "elasticNetParam": e} for r in (0.01, 0.1) for e in (0.0, 0.5, 1.0)]),
        "svm": (svm, [{"regParam": r} for r in (0.01, 0.1, 1.0)]),
        "boosting": (gbt, [{"maxDepth": d} for d in (3, 5)]),
        "forest": (forest(weight=weight), [{"numTrees": t, "maxDepth": d} for t in (20, 50) for d in (5, 10)]),
        "extra": (ExtraTrees(weightCol=weight), [{"numTrees": t, "maxDepth": d} for t in (20, 50) for d in (5, 10)]),
    }


def lasso(rows: float, strength: float = 1.0, weight: str | None = None) -> LogisticRegression:
    """L1 logistic regression; ``strength`` is the inverse of the penalty over ``rows`` (weighted) rows."""
    lr = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=1 / (strength * max(rows, 1.0)), maxIter=100)
    return lr.setWeightCol(weight) if weight else lr


def model_of(estimator: object, features: list[str], scaled: bool = False) -> Pipeline:
    stages: list = [VectorAssembler(inputCols=features, outputCol="raw" if scaled else "features", handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator])


def class_balanced(df: DataFrame, y: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``class_weight`` = (weight) * rows / (classes * rows of the class)."""
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(1))
    counts = counts.select(y, (F.sum("_n").over(everything) / (F.count("*").over(everything) * F.col("_n"))).alias("_w"))
    return df.join(F.broadcast(counts), y).withColumn("class_weight", F.col("_w") * (F.col(weight) if weight else 1.0)).drop("_w")


def complete(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose features are all finite, as doubles; kept, as models read them many times.

    They are kept in at most two parts a core: each of a model's many jobs sends the driver a result a part, and a join read where it was
    shuffled leaves as many parts as there are shuffle partitions, however small they are.

    Catalyst would derive facts for every mixture of the features' old and new names from the one condition on all of them,
    which doubles with each feature.  So it is planned without such facts.
    """
    every = F.forall(F.array(*[F.col(f).cast("double") for f in features]), lambda x: F.coalesce(F.abs(x) < INF, F.lit(False)))
    out = df.filter(every).withColumns({f: F.col(f).cast("double") for f in features}).coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return out.persist()  # plans it
    finally:
        conf.set(name, before)


def labelled(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """Finite features only, and classes 1..k as labels 0..k-1."""
    return complete(df.withColumn("label", (F.col(y) - 1).cast("double")), features)


def predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with y_pred and, if the model gives them, prob_class_1, prob_class_2, ..."""
    out = model.transform(df)
    out = out.withColumn("y_pred", (F.col("prediction") + 1).cast("int"))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumns({f"prob_class_{k + 1}": p[k] for k in range(model.stages[-1].numClasses)})
    return out.drop("raw", "features", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, estimator: object, features: list[str], folds: int = 5, y: str = "y_true", scaled: bool = False, fold: str = "fold") -> DataFrame:
    """Predictions of each row by the model that didn't see its fold; a written table."""
    ready = labelled(df, y, features)
    return _written(held_out(ready, estimator, features, folds, scaled, fold), ready)


def _written(out: DataFrame, *ready: DataFrame) -> DataFrame:
    """``out`` written down, after which the tables that it was read from are let go."""
    out = cut(out)
    for t in ready:
        t.unpersist()
    return out


def held_out(df: DataFrame, estimator: object, features: list[str], folds: int, scaled: bool = False, fold: str = "fold") -> DataFrame:
    """``out_of_fold`` of rows that ``labelled`` has made ready."""
    out = None
    for k in range(1, folds + 1):
        part = predictions(model_of(estimator, features, scaled).fit(df.filter(F.col(fold) != k)), df.filter(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def fold_metrics(predicted: DataFrame, by: list[str] = ("fold",)) -> DataFrame:
    return predicted.groupBy(*by).agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred"))).withColumns(c.binary_metrics())


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Importance of each feature: of a forest's splits, or of absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    return dict(zip(features, values.tolist(), strict=True))


def top_features(scores: dict[str, float], k: int) -> list[str]:
    return sorted(scores, key=lambda f: (-scores[f], f))[:k]


def elimination(
    df: DataFrame, estimator: object, features: list[str], folds: int = 5, step: int | float | list[int] = 1, least: int = 1, y: str = "y_true", metric: str = "f1_macro",
    scorer: Callable[[DataFrame], float] | None = None, region: str | None = None,
) -> list[dict]:
    """Recursive elimination: scores of shrinking feature sets, ranked by mean importance over folds.

    step: how many go each time, a share of what is left, or a list of set sizes.  Every set is scored, the least too,
    with its confusion cells summed over folds (with a scorer of one's own, the score alone).  region: a column by which
    each set is scored too, as ``regions``: the metric of each region's held-out rows of all folds.
    """
    df = labelled(df, y, features)
    sizes = iter(step) if isinstance(step, list) else None
    out = []
    while True:
        ranks, score, cells = dict.fromkeys(features, 0.0), [], dict.fromkeys(("tn", "fp", "fn", "tp"), 0)
        by_region: dict[str, dict[str, int]] = {}
        for k in range(1, folds + 1):
            model = model_of(estimator, features).fit(df.filter(F.col("fold") != k))
            for f, v in importances(model, features).items():
                ranks[f] += v / folds
            held = predictions(model, df.filter(F.col("fold") == k))
            if scorer:
                score.append(scorer(held))
                continue
            found = fold_metrics(held, [region] if region else []).collect()  # a row, or one a region
            one = {k: sum(r[k] for r in found) for k in cells}
            score.append(found[0][metric] if not region else _scores(df.sparkSession, {"all": one}, metric)["all"])
            cells = {k: n + one[k] for k, n in cells.items()}
            for r in found if region else ():
                own = by_region.setdefault(r[region], dict.fromkeys(cells, 0))
                by_region[r[region]] = {k: n + r[k] for k, n in own.items()}
        regional = {"regions": _scores(df.sparkSession, by_region, metric)} if region and not scorer else {}
        out.append({"n_features": len(features), "features": features, "mean": float(np.mean(score)), "std": float(np.std(score, ddof=1)) if folds > 1 else 0.0, "importances": ranks, **({} if scorer else cells), **regional})
        if sizes is not None:
            size = next((s for s in sizes if s < len(features)), 0)
        else:
            size = len(features) - max(1, int(step * len(features)) if isinstance(step, float) else step)
        if len(features) <= least:
            df.unpersist()
            return out
        features = top_features(ranks, max(size, least))


def _scores(spark: SparkSession, cells: dict[str, dict[str, int]], metric: str) -> dict[str, float]:
    """The metric of each name's confusion cells."""
    rows = [(name, *(n[k] for k in ("tn", "fp", "fn", "tp"))) for name, n in cells.items()]
    table = spark.createDataFrame(rows, "name string, tn long, fp long, fn long, tp long").withColumns(c.binary_metrics())
    return {r.name: r[metric] for r in table.collect()}


def save_top_features(spark: SparkSession, curve: list[dict], k: int, path: str) -> list[str]:
    """The k most important features of the whole set of an elimination, written one a line, the best first."""
    best = top_features(curve[0]["importances"], k)
    spark.createDataFrame([(f,) for f in best], "value string").coalesce(1).write.mode("overwrite").text(path)
    return best


def best_set(curve: list[dict]) -> list[str]:
    return max(curve, key=lambda x: x["mean"])["features"]


def halving(df: DataFrame, estimator: object, features: list[str], grid: list[dict], folds: int = 3, factor: int = 3, y: str = "y_true", scaled: bool = False) -> list[tuple[dict, float, int]]:
    """Successive halving: all settings on a hash sample of rows, the best 1 / factor on factor times as many, and so on.

    The last setting is scored on all rows; ``folds`` are all that the table has, as rows of others would train and never be scored.
    Returns (settings, score, round), the best of the last round first.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    rounds, left = 0, len(grid)
    while left > 1:
        rounds, left = rounds + 1, left // factor
    alive, out = list(grid), []
    for r in range(rounds + 1):
        share = factor ** (r - rounds)
        some = df.filter(F.pmod(F.xxhash64(F.lit(SEED + r), *features), F.lit(10_000)) < int(10_000 * share)) if share < 1 else df
        ready = labelled(some, y, features)
        scored = []
        for settings in alive:
            held = held_out(ready, with_settings(estimator, settings), features, folds, scaled)
            scored.append((settings, float(fold_metrics(held, []).first()["f1_macro"]), r))
        ready.unpersist()
        scored.sort(key=lambda x: -x[1])
        out = scored + out
        alive = [s for s, _, _ in scored[: max(1, len(alive) // factor)]]
    return out


def with_settings(estimator: object, settings: dict) -> object:
    return estimator.copy({estimator.getParam(k): v for k, v in settings.items()})


def tune(df: DataFrame, candidates: dict[str, tuple[object, list[dict]]], features: list[str], folds: int = 5, y: str = "y_true", metric: str = "f1_macro", parallel: int = 4) -> list[dict]:
    """(name, settings, mean, std, tn, fp, fn, tp) of each setting of each estimator, the best mean over folds first.

    All are scored on the same folds, on features scaled by each fold's training rows; confusion cells are summed over folds.
    ``parallel`` settings are tried at a time.
    """
    ready = labelled(df, y, features)

    def tried(one: tuple[str, object, dict]) -> dict:
        name, estimator, settings = one
        rows = fold_metrics(held_out(ready, with_settings(estimator, settings), features, folds, scaled=True)).collect()  # a row a fold
        scores = [r[metric] for r in rows]
        cells = {k: sum(r[k] for r in rows) for k in ("tn", "fp", "fn", "tp")}
        return {"name": name, "settings": settings, "mean": float(np.mean(scores)), "std": float(np.std(scores, ddof=1)) if len(scores) > 1 else 0.0} | cells

    ready.count()  # read once, before several settings ask for it
    with ThreadPool(parallel) as pool:
        out = pool.map(tried, [(name, estimator, settings) for name, (estimator, grid) in candidates.items() for settings in grid], 1)
    ready.unpersist()
    return sorted(out, key=lambda x: -x["mean"])


def save_model(model: PipelineModel, features: list[str], path: str) -> None:
    """The model, and its ordered features beside it as a one-line text file."""
    model.write().overwrite().save(path)
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": features}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_config")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    return PipelineModel.load(path), json.loads(spark.read.text(f"{path}_config").first()["value"])["features"]


def infer(model: PipelineModel, pixels: DataFrame, features: list[str]) -> DataFrame:
    """Pixels with the probability of class 1 in bytes and the class; missing and non-finite features count as 0."""
    filled = pixels.withColumns({f: F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)) if f in pixels.columns else F.lit(0.0) for f in features})
    out = predictions(model, filled)
    return out.withColumn("prob_byte", to_byte(clip(F.col("prob_class_1"), 0, 1)))


def parameter_count(model: PipelineModel) -> int:
    """Nodes of a forest times (2 + classes), or the non-zero coefficients of a linear model."""
    last = model.stages[-1]
    if hasattr(last, "trees"):
        return sum(t.numNodes for t in last.trees) * (2 + last.numClasses)
    matrix = last.coefficientMatrix.toArray()
    return int(np.count_nonzero(matrix) + np.count_nonzero(last.interceptVector.toArray()))


def pca(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """``df`` with pc1..pck of standardised features (rows with missing ones go), and the explained shares."""
    df = complete(df, features)
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), PCA(k=k, inputCol="_std", outputCol="_pc")]
    model = Pipeline(stages=stages).fit(df)
    pc = vector_to_array("_pc")
    return _written(model.transform(df).withColumns({f"pc{i + 1}": pc[i] for i in range(k)}).drop("_raw", "_std", "_pc"), df), model.stages[-1].explainedVariance.toArray().tolist()


def _products(df: DataFrame, features: list[str], domain: list[str]) -> tuple[np.ndarray, dict[tuple, np.ndarray]]:
    """Means of the features of all (complete) rows, and the sums of products of 1 and the features less these means, in each domain.

    Each task adds a matrix of products for each domain; those are added in an aggregation, and (p + 1) squared
    numbers for each domain reach the driver.  As means of all rows are taken off first, the products stay small.
    """
    p = len(features)
    centre = np.array([x or 0.0 for x in df.agg(*[F.avg(f) for f in features]).first()], float)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple, np.ndarray] = {}
        for rows in batches:
            for name, part in rows.groupby(domain, sort=False, dropna=False):
                x = np.column_stack((np.ones(len(part)), part[features].to_numpy(float) - centre))
                own[name] = own.get(name, 0) + x.T @ x
        for name, sums in own.items():
            yield pd.DataFrame({**{d: [v] for d, v in zip(domain, name, strict=True)}, "sums": [sums.ravel()]})

    gram = df.select(*domain, *features).mapInPandas(products, ", ".join(f"`{d}` {kinds[d]}" for d in domain) + ", sums array<double>")
    added = gram.select(*domain, F.posexplode("sums").alias("at", "x")).groupBy(*domain, "at").agg(F.sum("x").alias("x"))
    rows = added.groupBy(*domain).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("sums")).collect()
    return centre, {tuple(r[d] for d in domain): np.array([s["x"] for s in r["sums"]], float).reshape(p + 1, p + 1) for r in rows}


def _moments_of(centre: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = g[0, 1:] / g[0, 0]
    return centre + mean, g[1:, 1:] / g[0, 0] - np.outer(mean, mean)


def _moments(df: DataFrame, features: list[str], domain: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the features of each domain, over rows with all features."""
    df = complete(df.select(*domain, *features), features)
    centre, sums = _products(df, features, domain)
    df.unpersist()
    return {name: _moments_of(centre, g) for name, g in sums.items()}


def _root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def monge_map(source: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray], reg: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) of the affine optimal-transport map between Gaussians: x -> A x + b."""
    (ms, cs), (mt, ct) = source, target
    eye = reg * np.eye(len(ms))
    root = _root(cs + eye)
    inverse = np.linalg.inv(root)
    a = inverse @ _root(root @ (ct + eye) @ root) @ inverse
    return a, mt - a @ ms


def mapped(df: DataFrame, features: list[str], maps: dict, domain: str | None = None) -> DataFrame:
    """Features through the affine map (A, b) of each row's domain (without a domain: the map of None), as products of matrices."""
    kinds = {f.name: "double" if f.name in features else f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, part in rows.groupby(domain, sort=False) if domain else [(None, rows)]:
                a, b = maps[name]
                yield part.assign(**dict(zip(features, (part[features].to_numpy(float) @ a.T + b).T, strict=True)))[list(kinds)]

    return df.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def aligned(source: DataFrame, target: DataFrame, features: list[str]) -> DataFrame:
    """``source`` moved onto ``target`` by the affine Monge map."""
    everything = F.lit(1).alias("_d")
    s, t = (next(iter(_moments(d.select("*", everything), features, ["_d"]).values())) for d in (source, target))
    return mapped(source, features, {None: monge_map(s, t)})


def aligned_domains(df: DataFrame, features: list[str], domain: str, target: DataFrame) -> DataFrame:
    """Every domain of ``df`` moved onto ``target`` by a map of its own; rows without a domain go."""
    goal = next(iter(_moments(target.select("*", F.lit(1).alias("_d")), features, ["_d"]).values()))
    df = df.filter(F.col(domain).isNotNull())
    return mapped(df, features, {name: monge_map(found, goal) for (name,), found in _moments(df, features, [domain]).items()}, domain)


def transfer(df: DataFrame, estimator: object, features: list[str], source: Column, y: str = "y_true") -> DataFrame:
    """Predictions of the rows outside of ``source`` by a model of those inside."""
    df = labelled(df, y, features)
    return _written(predictions(model_of(estimator, features).fit(df.filter(source)), df.filter(~source)), df)


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.count("*").alias("n"), ratio(F.count_if(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("accuracy"))


def frozen_folds(trained: DataFrame, other: DataFrame, estimator: object, features: list[str], folds: int = 5, y: str = "y_true") -> DataFrame:
    """Predictions of the rows of another year by the model that didn't see their fold in the year it was trained in."""
    trained = labelled(trained, y, features)
    other = complete(other, features)
    out = None
    for k in range(1, folds + 1):
        part = predictions(model_of(estimator, features).fit(trained.filter(F.col("fold") != k)), other.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return _written(out, trained, other)


def adapted_folds(df: DataFrame, estimator: object, features: list[str], domain: str, folds: int = 5, y: str = "y_true", fold: str = "fold") -> DataFrame:
    """Predictions of each row by a model of the other folds, all domains moved onto those folds' rows as one domain.

    The maps are made of the training rows alone, and a held-out row goes through its domain's map; rows of domains that the training
    rows lack, or without one, are left out.
    """
    df, out = complete(df.filter(F.col(domain).isNotNull()), features), None
    centre, sums = _products(df, features, [fold, domain])  # each row once; a fold's training rows are the sums of the others
    ready = [df]
    for k in range(1, folds + 1):
        trained: dict[object, np.ndarray] = {}
        for (f, name), g in sums.items():
            if f is not None and f != k:
                trained[name] = trained.get(name, 0) + g
        goal = _moments_of(centre, sum(trained.values()))
        maps = {name: monge_map(_moments_of(centre, g), goal) for name, g in trained.items()}
        moved = labelled(mapped(df.filter(F.col(fold) != k), features, maps, domain), y, features)
        held = mapped(df.filter((F.col(fold) == k) & F.col(domain).isin(list(maps))), features, maps, domain)
        ready.append(moved)
        part = predictions(model_of(estimator, features).fit(moved), held)
        out = part if out is None else out.unionByName(part)
    return _written(out, *ready)


def aligned_transfer(source: DataFrame, target: DataFrame, estimator: object, features: list[str], y: str = "y_true") -> DataFrame:
    """Predictions of ``target`` by a model of ``source`` moved onto it by the Monge map; the target's labels aren't used."""
    moved = labelled(aligned(source, target, features), y, features)
    model = model_of(estimator, features).fit(moved)
    moved.unpersist()
    return predictions(model, target)

"""How well harmonic features explain embeddings: ridge regression from sums of products, and correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import ratio
from canopy.operators.lineage import cut
from canopy.operators.quantiles import _same
from canopy.operators.stats import correlation

ALPHAS = tuple(10.0**k for k in range(-3, 4))


def weighted_r2(df: DataFrame, y: str, predicted: str, w: str, by: list[str] = (), unit_weights: bool = False) -> DataFrame:
    """(by, r2): 1 - SSE / SST with weights; without weight or spread null (unit_weights: without weight, each row counts 1)."""
    if unit_weights:
        total = df.groupBy(*by).agg(F.sum(w).alias("_sw"))
        df = df.join(total, list(by)) if by else df.crossJoin(F.broadcast(total))
        df = df.withColumn(w, F.when(F.col("_sw") > 0, F.col(w)).otherwise(1.0))
    mean = df.groupBy(*by).agg(ratio(F.sum(F.col(w) * F.col(y)), F.sum(w), "null").alias("_mean"), F.sum(w).alias("_w"))
    df = df.drop("_sw").join(mean, list(by)) if by else df.drop("_sw").crossJoin(F.broadcast(mean))
    sums = df.groupBy(*by).agg(F.sum(F.col(w) * (F.col(y) - F.col(predicted)) ** 2).alias("sse"), F.sum(F.col(w) * (F.col(y) - F.col("_mean")) ** 2).alias("sst"), F.first("_w").alias("_w"))
    return sums.select(*by, F.when((F.col("_w") > 0) & (F.col("sst") > 0), 1 - F.col("sse") / F.col("sst")).alias("r2"))


def product_sums(features: list[str], targets: list[str], w: Column) -> list[Column]:
    """Weighted sums of products of (features, 1) with themselves and the targets, and of squared targets."""
    x = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]
    y = [F.col(c).cast("double") for c in targets]
    gram = F.array(*[F.sum(w * a * b) for i, a in enumerate(x) for b in x[i:]])
    cross = F.array(*[F.sum(w * a * b) for b in y for a in x])
    return [gram.alias("gram"), cross.alias("cross"), F.array(*[F.sum(w * b * b) for b in y]).alias("squares"), F.sum(w).alias("weight"), F.count("*").alias("n")]


def _square(flat: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def _ridge(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients and intercept on features standardised by the sums themselves; cross: (features + 1, targets)."""
    p = len(gram) - 1
    n = gram[p, p]
    mean = gram[:p, p] / n
    scale = np.sqrt(np.maximum(np.diag(gram)[:p] / n - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    centred = gram[:p, :p] - n * np.outer(mean, mean)
    right = cross[:p] - np.outer(mean, cross[p])
    b = np.linalg.solve(centred / np.outer(scale, scale) + alpha * np.eye(p), right / scale[:, None]) / scale[:, None]
    return np.vstack([b, cross[p] / n - mean @ b])


def _error(beta: np.ndarray, gram: np.ndarray, cross: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Sum of squared errors of each target."""
    return squares - 2 * (beta * cross).sum(axis=0) + np.einsum("it,ij,jt->t", beta, gram, beta)


_SUMS = ("gram", "cross", "squares")
_SUM_COLUMNS = "gram array<double>, cross array<double>, squares array<double>"


def _added(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.sum(np.stack(rows[c].to_list()), axis=0) for c in _SUMS]


def _fold_sums(sums: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """Sums of the rows (keys, sums) by keys: each task adds up its own rows, and one row a task and key is left to add."""
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _SUM_COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}

        def given() -> pd.DataFrame:
            return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=[*keys, *_SUMS])

        for rows in batches:
            for row in rows.itertuples(index=False):
                key, values = tuple(None if v is None or v != v else v for v in row[: len(keys)]), [np.asarray(v, float) for v in row[len(keys) :]]
                held[key] = [x + y for x, y in zip(held[key], values, strict=True)] if key in held else values
            if len(held) > KEPT_SUMS:
                yield given()
                held = {}
        yield given()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*rows[keys].iloc[0], *_added(rows))], columns=[*keys, *_SUMS])

    return sums.select(*keys, *_SUMS).mapInPandas(run, schema).groupBy(*keys).applyInPandas(add, schema)


#: Sums that a task keeps before it hands them on.
KEPT_SUMS = 2_000


def _fitted(total: Callable[[list, int, int, int], list[np.ndarray]], train: list, targets: int, alphas: tuple[float, ...]) -> np.ndarray:
    """(features + 1, targets): coefficients by the weighted sums, with each target's alpha chosen over the inner folds."""
    best, chosen = None, np.full(targets, alphas[0])
    for alpha in alphas:
        error = 0.0
        for i in range(5):
            fit, held = total(train, 0, i, -1), total(train, 0, -1, i)
            if fit and held and fit[0][-1, -1] > 0:
                error = error + _error(_ridge(fit[0], fit[1], alpha), *held)
        if best is None or np.isscalar(best):
            best = error
        else:
            chosen = np.where(error < best, alpha, chosen)
            best = np.minimum(best, error)
    fit = total(train, 1, -1, -1)
    return np.hstack([_ridge(fit[0], fit[1][:, j : j + 1], chosen[j]) for j in range(targets)])


def ridge_similarity(df: DataFrame, region: str, tile: str, features: list[str], targets: list[str], weight: str, folds: int = 5, alphas: tuple[float, ...] = ALPHAS, seed: int = 42) -> DataFrame:
    """(region, tile, target, r2, coefficients): out-of-fold R2 of each tile, folds keeping tiles whole; a written table.

    One aggregation makes the sums of products of each tile (by inner fold, for the choice of alpha).  Tasks add them up by fold
    of a region; a region's models need the sums of its few folds alone, and each tile is scored by itself, so no task
    holds a region's tiles.
    """
    size, p = len(features) + 1, len(features)
    inner = F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(5)).cast("int")
    sums = lambda kind, w: F.struct(F.lit(kind).alias("kind"), *product_sums(features, targets, w))
    both = df.withColumn("inner", inner).groupBy(region, tile, "inner").agg(F.array(sums(0, F.lit(1.0)), sums(1, F.col(weight).cast("double"))).alias("sums"))
    both = both.select(region, tile, "inner", F.inline("sums")).select(region, tile, "kind", "inner", *_SUMS).persist()  # until the result is written
    kinds = {f.name: f.dataType.simpleString() for f in df.schema} | {"fold": "int", "kind": "int", "inner": "int"}

    # tiles in their order are dealt to the folds in turn
    tiles = both.select(region, tile).distinct()
    nth = F.row_number().over(Window.partitionBy(region).orderBy(tile)) - 1
    n = F.count("*").over(Window.partitionBy(region))
    placed = tiles.select(region, tile, F.pmod(nth, F.least(n, F.lit(folds))).cast("int").alias("fold"))
    dealt = _same(both, placed, [region, tile])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        held = {(r.fold, r.kind, r.inner): (_square(np.array(r.gram), size), np.array(r.cross).reshape(len(targets), size).T, np.array(r.squares)) for r in rows.itertuples()}
        known = sorted({f for f, _, _ in held})

        def total(some: list, kind: int, skip: int, only: int) -> list[np.ndarray]:
            parts = [v for (f, k, i), v in held.items() if f in some and k == kind and i != skip and (only < 0 or i == only)]
            return [np.sum([x[j] for x in parts], axis=0) for j in range(3)] if parts else []

        betas = [_fitted(total, [x for x in known if x != f] or known, len(targets), alphas).ravel() for f in known]
        return pd.DataFrame({"region": [rows[region].iloc[0]] * len(known), "fold": known, "beta": betas})

    models = cut(_fold_sums(dealt, [region, "fold", "kind", "inner"], kinds).groupBy(region).applyInPandas(fit, f"region {kinds[region]}, fold int, beta array<double>"))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each row of sums adds to the squared errors and to the spread of each target, as both are sums over rows."""
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                g, c, s, beta = _square(np.array(r.gram), size), np.array(r.cross).reshape(len(targets), size).T, np.array(r.squares), np.array(r.beta).reshape(size, len(targets))
                out += zip([r[0]] * len(targets), [r[1]] * len(targets), [r.fold] * len(targets), range(len(targets)), _error(beta, g, c, s).tolist(), s.tolist(), c[-1].tolist(), [g[-1, -1]] * len(targets), strict=True)
            yield pd.DataFrame(out, columns=[region, tile, "fold", "at", "error", "square", "sum", "weight"])

    met = _same(dealt.filter("kind = 1").select(region, tile, "fold", *_SUMS), models.withColumnRenamed("region", region), [region, "fold"])
    rows = met.mapInPandas(errors, f"`{region}` {kinds[region]}, `{tile}` {kinds[tile]}, fold int, at int, error double, square double, sum double, weight double")
    total = rows.groupBy(region, tile, "fold", "at").agg(*[F.sum(x).alias(x) for x in ("error", "square", "sum", "weight")])
    spread = F.when(F.col("weight") > 0, F.col("square") - F.col("sum") ** 2 / F.col("weight"))
    scored = total.withColumn("spread", spread).filter("spread > 0")
    target = F.array(*[F.lit(t) for t in targets])[F.col("at")].alias("target")
    # a coefficient's share of a target's absolute ones, the intercept left out
    known = models.select(F.col("region").alias(region), "fold", F.posexplode(F.array(*[F.array(*[F.abs(F.col("beta")[i * len(targets) + j]) for i in range(p)]) for j in range(len(targets))])).alias("at", "size"))
    known = known.withColumn("all", F.aggregate("size", F.lit(0.0), lambda a, x: a + x)).select(region, "fold", "at", F.transform("size", lambda x: x / F.greatest("all", F.lit(1e-300))).alias("coefficients"))
    out = cut(_same(scored, known, [region, "fold", "at"]).select(F.col(region).alias("region"), F.col(tile).alias("tile"), target, (1 - F.col("error") / F.col("spread")).alias("r2"), "coefficients"), models)
    both.unpersist()
    return out


def tile_means(r2: DataFrame) -> DataFrame:
    """(region, tile, mean, std, n) of R2 over targets and folds."""
    return r2.groupBy("region", "tile").agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.count("*").alias("n"))


def region_means(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("region").agg(F.avg("r2_mean").alias("r2_mean"), F.stddev_pop("r2_mean").alias("r2_std"), F.count("*").alias("n_tiles"))


def feature_correlations(df: DataFrame, by: list[str], targets: list[str], features: list[str], least: int = 20) -> DataFrame:
    """(by, target, feature, n, r): Pearson's r of each target with each feature; undefined: 0."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(t).cast("double").alias("x"), F.col(f).cast("double").alias("y")) for t in targets for f in features])
    return correlation(df.select(*by, F.inline(pairs)), "x", "y", [*by, "target", "feature"], least).fillna(0.0, ["r"])


def closest_feature(correlations: DataFrame, by: list[str]) -> DataFrame:
    """(by, target, feature, r): the strongest, ties to the first name."""
    best = F.min_by(F.struct("feature", "r"), F.struct(-F.abs("r"), "feature"))
    return correlations.groupBy(*by, "target").agg(best.alias("b")).select(*by, "target", "b.*")


def vector_columns(df: DataFrame, array: str, size: int, prefix: str) -> DataFrame:
    return df.select("*", *[F.col(array)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])

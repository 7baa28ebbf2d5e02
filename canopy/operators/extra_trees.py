"""Extremely randomised trees: every node tries random cuts of random features, and the best one stays.

All trees grow a level at a time.  Tasks count the classes on either side of all candidate cuts of all open nodes in one
pass over their rows, and the counts of a node meet in one task, which picks its best cut; the driver, which holds the trees alone, gets
that cut and the node's classes.  A node's cuts are drawn between the ends that its ancestors' cuts have left of a feature's range, by a hash of seed, tree, node and try, so trees
don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Nodes of all trees: feature (-1: leaf), cut, left child (the right one follows it) and weights of classes."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    weight: np.ndarray
    roots: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the node in which each row ends."""
        at = np.tile(self.roots, (len(x), 1))
        while True:
            going = self.feature[at] >= 0
            if not going.any():
                return at
            row, tree = np.nonzero(going)
            node = at[row, tree]
            at[row, tree] = self.left[node] + (x[row, self.feature[node]] > self.cut[node])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        share = self.weight / np.maximum(self.weight.sum(1, keepdims=True), 1e-300)
        return share[self.leaves(x)].mean(1)


def _draw(seed: int, node: np.ndarray, tries: int, what: int) -> np.ndarray:
    """(nodes, tries) numbers from 0 to 1 by hashing."""
    with np.errstate(over="ignore"):
        x = (node[:, None].astype(np.uint64) * np.uint64(1_000_003) + np.arange(tries, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 7919 + what) % (1 << 32))
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def grown(rows: DataFrame, width: int, classes: int, trees: int, depth: int, leaf: float, seed: int) -> Trees:
    """Trees on rows (x: array of ``width`` doubles, y: class from 0, w: weight)."""
    tries = int(np.ceil(np.sqrt(width)))
    ends = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()  # a row a feature
    low, high = np.zeros(width), np.zeros(width)
    for r in ends:
        low[r.k], high[r.k] = r.low, r.high
    model = Trees(np.full(trees, -1), np.zeros(trees), np.full(trees, -1), np.zeros((trees, classes)), np.arange(trees))
    box = {n: (low, high) for n in range(trees)}
    name = np.arange(1, trees + 1, dtype=np.uint64) << np.uint64(40)  # of each node, by its way from the root
    open_nodes = np.arange(trees)
    for level in range(depth + 1):
        feature = (_draw(seed, name[open_nodes], tries, 1) * width).astype(int).clip(0, width - 1)
        bounds = np.array([[(box[n][0][f], box[n][1][f]) for f in fs] for n, fs in zip(open_nodes.tolist(), feature, strict=True)]).reshape(len(open_nodes), tries, 2)
        cut = bounds[..., 0] + _draw(seed, name[open_nodes], tries, 2) * (bounds[..., 1] - bounds[..., 0])
        slot = np.full(len(model.feature), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        model.weight[open_nodes], best = _chosen(rows, model, slot, feature, cut, width, classes, leaf)
        if level == depth:
            break
        split = np.flatnonzero(best >= 0)
        if not len(split):
            break
        children = len(model.feature) + 2 * np.arange(len(split))
        parents, f, c = open_nodes[split], feature[split, best[split]], cut[split, best[split]]
        model.feature[parents], model.cut[parents], model.left[parents] = f, c, children
        n = 2 * len(split)
        model.feature, model.left = (np.concatenate([a, np.full(n, -1)]) for a in (model.feature, model.left))
        model.cut, model.weight = np.concatenate([model.cut, np.zeros(n)]), np.concatenate([model.weight, np.zeros((n, classes))])
        with np.errstate(over="ignore"):
            name = np.concatenate([name, np.stack([name[parents] * np.uint64(2) + np.uint64(1), name[parents] * np.uint64(2) + np.uint64(2)], 1).ravel()])
        for p, child, k, v in zip(parents.tolist(), children.tolist(), f.tolist(), c.tolist(), strict=True):
            a, b = box.pop(p)
            left, right = b.copy(), a.copy()
            left[k], right[k] = v, v
            box[child], box[child + 1] = (a, left), (right, b)
        open_nodes = np.stack([children, children + 1], 1).ravel()
    return model


def _best(counts: np.ndarray, leaf: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes, and the best cut (-1: none), of nodes with (nodes, tries, sides, classes) weights."""
    total, own = counts.sum(3), counts[:, 0].sum(1)
    impurity = (total - (counts**2).sum(3) / np.maximum(total, 1e-300)).sum(2)
    impurity[(total < leaf).any(2)] = np.inf
    before = own.sum(1) - (own**2).sum(1) / np.maximum(own.sum(1), 1e-300)
    return own, np.where(np.isfinite(impurity.min(1)) & (before > 1e-9), impurity.argmin(1), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _chosen(rows: DataFrame, model: Trees, slot: np.ndarray, feature: np.ndarray, cut: np.ndarray, width: int, classes: int, leaf: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes of each open node and its best candidate cut (-1: none)."""
    nodes, tries = feature.shape
    own = tries * 2 * classes
    size = nodes * own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = _matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False).astype(int), batch.column(2).to_numpy(zero_copy_only=False)
            at = slot[model.leaves(x)]
            row, tree = np.nonzero(at >= 0)
            node = at[row, tree]
            for k in range(tries):
                right = x[row, feature[node, k]] > cut[node, k]
                out += np.bincount(((node * tries + k) * 2 + right) * classes + y[row], w[row], size)
        out = out.reshape(nodes, own)
        some = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), _lists(out[some])], names=["node", "n"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(1)  # of each node, the counts of each task that has rows of it
            first = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())[:-1]])
            counts = np.add.reduceat(_matrix(parts.flatten(), own), first, axis=0)
            weight, best = _best(counts.reshape(-1, tries, 2, classes), leaf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int64()), _lists(weight)], names=["node", "best", "weight"])

    counted = rows.select("x", "y", "w").mapInArrow(count, "node long, n array<double>").groupBy("node").agg(F.collect_list("n").alias("n"))  # a list a task
    found = counted.mapInArrow(pick, "node long, best long, weight array<double>").toArrow()  # a row an open node
    weight, best = np.zeros((nodes, classes)), np.full(nodes, -1)
    at = found.column("node").to_numpy()
    best[at] = found.column("best").to_numpy()
    weight[at] = np.array(found.column("weight").to_pylist(), float).reshape(-1, classes)
    return weight, best


class _TreeParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least weight of a child", TypeConverters.toFloat)


class ExtraTrees(Estimator, _TreeParams):
    """An estimator for pipelines, with the names of Spark's own forest."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, numTrees: int = 50, maxDepth: int = 10, minInstancesPerNode: float = 1.0, seed: int = 42) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(numTrees=50, maxDepth=10, minInstancesPerNode=1.0, seed=42)

    def setWeightCol(self, value: str) -> ExtraTrees:
        return self._set(weightCol=value)

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"), weight.alias("w"))
        shape = rows.agg(F.max(F.size("x")).alias("width"), (F.max("y") + 1).alias("classes")).first()
        get = self.getOrDefault
        model = grown(rows, shape.width, max(shape.classes, 2), get("numTrees"), get("maxDepth"), get("minInstancesPerNode"), get("seed"))
        return self._copyValues(ExtraTreesModel(model))


class ExtraTreesModel(Model, _TreeParams):
    def __init__(self, model: Trees) -> None:
        super().__init__()
        self.model = model

    @property
    def numClasses(self) -> int:
        return self.model.weight.shape[1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.model)  # the trees alone

        @F.arrow_udf("array<double>")
        def probabilities(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            return pa.array(list(shared.value.probabilities(_matrix(x, len(x[0])))), pa.list_(pa.float64()))

        out = dataset.withColumn("_p", probabilities(vector_to_array(self.getFeaturesCol())))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumn("probability", array_to_vector("_p")).withColumn("prediction", best).drop("_p")

"""Kernels on rasters of any size: blocks of cells that carry what lies around them, dealt once.

No tile needs to fit in a task: a group holds a block of ``side`` x ``side`` cells and a border as wide as the kernel reaches.
Results don't depend on the side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.lineage import cut, release

SIDE = 256


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by), F.lit(True))


def with_borders(cells: DataFrame, by: list[str], columns: list[str], border: int, side: int = SIDE) -> DataFrame:
    """(by, row, col, columns, _r, _c, _top, _bottom, _left, _right): each cell in its block and in those it borders on, with the extent of its raster."""
    if border > side:
        raise ValueError("a border can't be wider than a block")

    def blocks(c: str) -> Column:
        at, inner = F.floor(F.col(c) / side), F.pmod(F.col(c), F.lit(side))
        near = F.array(at, F.when(inner < border, at - 1), F.when(inner >= side - border, at + 1))
        return F.explode(F.filter(near, lambda b: b.isNotNull()))

    extent = cells.groupBy(*by).agg(F.min("row").alias("_top"), F.max("row").alias("_bottom"), F.min("col").alias("_left"), F.max("col").alias("_right"))
    dealt = cells.select(*by, "row", "col", *columns, blocks("row").alias("_r")).withColumn("_c", blocks("col"))
    met = dealt.alias("cell").join(extent.alias("extent"), _same("cell", "extent", by)) if by else dealt.alias("cell").crossJoin(F.broadcast(extent))  # one row
    return met.select("cell.*", "_top", "_bottom", "_left", "_right")


def by_block(
    cells: DataFrame, by: list[str], inputs: list[str], outputs: str, kernel: Callable[..., tuple[np.ndarray, ...]], border: int, edge: str, side: int = SIDE
) -> DataFrame:
    """Each cell with what ``kernel`` makes of the arrays of the inputs; outputs: a schema string.

    The kernel gets arrays that are ``border`` wider on each side than those it returns.  Cells that are missing in a raster's
    extent are 0; beyond the extent its edge goes on by numpy's pad mode ``edge``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    keys = [*by, "row", "col"]
    names = [c.split()[0] for c in outputs.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        own, window, pad = rows, [], []
        for axis, block, low, high in (("row", "_r", "_top", "_bottom"), ("col", "_c", "_left", "_right")):
            begin = int(first[block]) * side
            a, b = max(begin, int(first[low])), min(begin + side - 1, int(first[high]))  # the block inside the extent
            x, y = max(begin - border, int(first[low])), min(begin + side - 1 + border, int(first[high]))  # and with its border
            window.append((x, y))
            pad.append((border - (a - x), border - (y - b)))
            own = own[(own[axis] >= a) & (own[axis] <= b)]
        if own.empty:
            return own[keys].assign(**dict.fromkeys(names, 0))
        arrays = []
        for c in inputs:
            grid = np.zeros([y - x + 1 for x, y in window], np.asarray(rows[c]).dtype)
            grid[rows["row"] - window[0][0], rows["col"] - window[1][0]] = rows[c]
            arrays.append(np.pad(grid, pad, mode=edge))
        at = own["row"] - window[0][0] - border + pad[0][0], own["col"] - window[1][0] - border + pad[1][0]
        return own[keys].assign(**{n: out[at] for n, out in zip(names, kernel(*arrays), strict=True)})

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys]) + ", " + outputs
    return with_borders(cells, by, inputs, border, side).groupBy(*by, "_r", "_c").applyInPandas(run, schema)


def labels(mask: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of 8-connected components of true cells, and each cell's component from 0 (-1 outside), by union of runs of neighbouring rows."""
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs: list[tuple[int, int, int]] = []
    before: list[tuple[int, int, int]] = []
    for r, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now, k = [], 0
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            me = len(parent)
            parent.append(me)
            while k < len(before) and before[k][1] < start:
                k += 1
            i = k
            while i < len(before) and before[i][0] <= end:
                parent[find(before[i][2])] = find(me)
                i += 1
            now.append((start, end, me))
            runs.append((r, start, end))
        before = now
    roots = [find(i) for i in range(len(parent))]
    dense = {root: n for n, root in enumerate(dict.fromkeys(roots))}
    out = np.full(mask.shape, -1, np.int64)
    for (r, start, end), root in zip(runs, roots, strict=True):
        out[r, start:end] = dense[root]
    return len(dense), out


def links_left(edges: DataFrame, group: str) -> DataFrame:
    """(group, merged): by how many the edges (group, a, b) lessen the number of components; a small table, written.

    Each round hooks every larger node to its smallest neighbour, follows the hooks to their ends by pointer jumping, and goes on with the
    edges between the ends, until none is left.  A hook lessens the components by one.
    """
    spark = edges.sparkSession
    ordered = lambda e: e.filter("a <> b").select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, counts = cut(ordered(edges)), []
    while not left.isEmpty():
        hooks = cut(left.groupBy(group, "b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node"))
        counts.append(cut(hooks.groupBy(group).agg(F.count("*").alias("merged"))))
        while True:
            onward = hooks.select(group, F.col("node").alias("root"), F.col("root").alias("next"))
            longer = cut(hooks.join(onward, [group, "root"], "left").select(group, "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            release(hooks)
            hooks = longer
            if hooks.filter("moved").isEmpty():
                break
        for end in ("a", "b"):
            ends = hooks.select(group, F.col("node").alias(end), F.col("root").alias("_root"))
            left_now = left.join(ends, [group, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
            left, old = left_now, left
            if end == "a":
                first = old
        left = cut(ordered(left), first, hooks)
    release(left)
    if not counts:
        return spark.createDataFrame([], edges.select(group).schema.add("merged", "long"))
    return cut(reduce(DataFrame.union, counts).groupBy(group).agg(F.sum("merged").alias("merged")), *counts)


def component_counts(cells: DataFrame, by: list[str], classes: tuple[int, ...], value: str, side: int = SIDE) -> DataFrame:
    """(by, class, components, valid): 8-connected components of each class in each raster, and its positive cells; a small table, written.

    Blocks are labelled apart; labels of neighbouring cells of two blocks are joined along the blocks' sides, and merged.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    bits = (2 * side * side - 1).bit_length()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = int(rows["_r"].iloc[0]) * side, int(rows["_c"].iloc[0]) * side
        grid = np.zeros((side, side), np.asarray(rows[value]).dtype)
        r, c = rows["row"].to_numpy() - top, rows["col"].to_numpy() - left
        grid[r, c] = rows[value]
        out = []
        for k in classes:
            n, label = labels(grid == k)
            at = np.argwhere((label >= 0) & np.pad(np.zeros((side - 2, side - 2), bool), 1, constant_values=True))
            out.append((n, [{"row": int(a) + top, "col": int(b) + left, "label": int(label[a, b])} for a, b in at]))
        found = pd.DataFrame({"class": classes, "n": [n for n, _ in out], "valid": int((grid > 0).sum()), "border": [b for _, b in out]})
        return pd.concat([pd.DataFrame({k: [rows[k].iloc[0]] * len(classes) for k in (*by, "_r", "_c")}), found], axis=1)

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["_r long", "_c long", "`class` int", "n long", "valid long", "border array<struct<row:long,col:long,label:long>>"])
    dealt = cells.select(*by, "row", "col", value, F.floor(F.col("row") / side).alias("_r"), F.floor(F.col("col") / side).alias("_c"))
    found = cut(dealt.groupBy(*by, "_r", "_c").applyInPandas(run, schema))
    group = F.struct(*by, "class").alias("_g")
    # a component's number: that of its block, and its own in it
    node = F.shiftleft(F.col("_r") + (1 << 20), 42) + F.shiftleft(F.col("_c") + (1 << 20), bits) + F.col("b.label") if bits <= 21 else None
    if node is None:
        raise ValueError("blocks are too large")
    border = found.select(group, "_r", "_c", F.explode("border").alias("b")).select("_g", F.col("b.row").alias("row"), F.col("b.col").alias("col"), node.alias("node"))
    last = lambda c: F.pmod(F.col(c), F.lit(side)) == side - 1
    beside = lambda i, j: F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"))
    none = F.array().cast("array<struct<row:bigint,col:bigint>>")
    below, right = F.array(*[beside(1, j) for j in (-1, 0, 1)]), F.array(*[beside(i, 1) for i in (-1, 0, 1)])
    around = F.array_union(F.when(last("row"), below).otherwise(none), F.when(last("col"), right).otherwise(none))
    out = border.select("_g", F.col("node").alias("a"), F.inline(around)).join(border.withColumnRenamed("node", "b"), ["_g", "row", "col"])
    merged = links_left(out.select("_g", "a", "b"), "_g")
    sums = found.groupBy(*by, "class").agg(F.sum("n").alias("n"), F.sum("valid").alias("valid")).withColumn("_g", group)
    left = F.col("n") - F.coalesce("merged", F.lit(0))
    return cut(sums.join(merged, "_g", "left").select(*by, "class", left.alias("components"), "valid"), found, merged)

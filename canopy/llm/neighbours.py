"""Approximate nearest neighbours by NN-descent, searched greedily.

Equal vectors are one node.  A forest of random hyperplanes gives each node a first list of neighbours: nodes are
sorted by their signs, and neighbours on the sorted line are compared in leaves of bounded size.  NN-descent then
lets neighbours of neighbours meet: Spark joins bring the vectors of all that a node points to, and of all that
point to it, together; every two of them at least one of which is new are compared, and whoever is nearer than
the worst neighbour known takes its place.  Nodes that very many point to are met in several groups, others in each
round; of the edges that a node gets, each task passes on its best ``degree``.

A query starts at its own node and walks greedily: in each step the nodes among its nearest ``beam`` that were not
opened yet are opened, their neighbours (with links both ways) that it hasn't met are compared with it, and the
nearest ``beam`` of all stay, until all of those are opened.  There is no limit of steps: each opens nodes that were
not opened before, so the walk ends by itself.  What a query has met is one row, its beam at most ``beam`` rows.
Scores are cosines in double precision on the original vectors, float or double.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
different lengths are never compared; rows that repeat an id and vector count as several candidates; ties in the
score go to the smaller id; queries with fewer candidates than ``k`` get them all; an empty table gives an empty
result; other columns are ignored; rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.batches import bounded_batches, tidy
from canopy.llm.store import drop, keep, save, scratch

DEGREE, TREES, LEAF, ROUNDS = 32, 8, 256, 3
BEAM, GROUP = 128, 128

_EDGE = "node long, other long, sim float, fresh boolean"


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, node, vector) of the rows that take part; node names the vector.  Floats stay floats, others become doubles."""
    kind = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = bounded_batches(table).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector")).filter("vec_id is not null and vector is not null")
    v = F.col("vector")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.select("vec_id", F.xxhash64("vector").alias("node"), "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long vectors, of length one."""
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _edges(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float32()), pa.array(np.ones(len(node), bool))],
        names=["node", "other", "sim", "fresh"],
    )


def _signs(trees: int, bits: int):
    """mapInArrow function: each node once for each tree, with its signs and a projection to sort by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((trees, bits + 1, dim)).astype(np.float32)
                m = _matrix(part.column(1))
                for tree in range(trees):
                    at = m @ planes[dim][tree].T
                    code = (at[:, :-1] > 0) @ (1 << np.arange(bits)[::-1]) if bits else np.zeros(len(m), np.int64)
                    n = len(m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree] * n, pa.int32()), pa.array([dim] * n, pa.int32()), pa.array(code, pa.int64()), pa.array(at[:, -1], pa.float32()), part.column(0), part.column(1)],
                        names=["tree", "dim", "code", "at", "node", "vector"],
                    )

    return run


def _leaves(degree: int, leaf: int):
    """mapInArrow function: compare sorted nodes within leaves."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        node, m = rows.column("node").to_numpy(), _matrix(rows.column("vector").combine_chunks())
        sims = m @ m.T
        np.fill_diagonal(sims, -2)
        k = min(degree, len(node) - 1)
        if k > 0:
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            yield _edges(np.repeat(node, k), node[best].ravel(), np.take_along_axis(sims, best, 1).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None  # rows of one tree and length that are not compared yet
        for batch in batches:
            table = pa.table(batch)
            keys = np.stack([table.column(c).to_numpy() for c in ("tree", "dim")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held is not None and key != tuple(keys[a]):
                    yield from compare(held)
                    held = None
                key = tuple(keys[a])
                part = table.slice(a, b - a).select(["node", "vector"])
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= 2 * leaf:  # the last leaf of a line is no shorter than the others
                    yield from compare(held.slice(0, leaf))
                    held = held.slice(leaf)
        if held is not None and held.num_rows:
            yield from compare(held)

    return run


def _meet(degree: int):
    """mapInArrow function: groups of (node, worst, fresh, vector), where whoever is nearer than the other's worst neighbour is
    one of its new neighbours, the best ``degree`` of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                group = batch.column(0)[k].values
                node, worst, fresh = (group.field(f).to_numpy(zero_copy_only=False) for f in ("node", "worst", "fresh"))
                _, first = np.unique(node, return_index=True)
                if len(first) < 2:
                    continue
                young = np.zeros(len(first), bool)
                np.logical_or.at(young, np.searchsorted(node[first], node), fresh.astype(bool))
                vectors = group.field("vector").take(pa.array(first))
                sizes = vectors.value_lengths().to_numpy()
                for dim in np.unique(sizes):  # vectors of different lengths meet nowhere but here
                    at = np.flatnonzero(sizes == dim)
                    own, low, new = node[first[at]], worst[first[at]], young[at]
                    sims = _matrix(vectors.take(pa.array(at)))
                    sims = sims @ sims.T
                    np.fill_diagonal(sims, -2)
                    sims[(sims <= low[:, None]) | ~(new[:, None] | new[None, :])] = -2
                    if len(at) > degree:
                        sims[sims < np.partition(sims, len(at) - degree, axis=1)[:, len(at) - degree, None]] = -2
                    i, j = np.nonzero(sims > -2)
                    if len(i):
                        yield _edges(own[i], own[j], sims[i, j])

    return run


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The best edges of each node; of two equal edges the older one stays."""
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= degree).drop("rank")


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """(node, other, sim, fresh): the neighbour graph of nodes (node, vector)."""
    spark = nodes.sparkSession
    n = nodes.count()
    bits = max(0, (n // leaf).bit_length())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kind = nodes.schema["vector"].dataType.simpleString()
    lined = nodes.mapInArrow(tidy(_signs(trees, bits)), f"tree int, dim int, code long, at float, node long, vector {kind}")
    lined = lined.repartitionByRange(max(1, min(tasks, n * trees // (4 * leaf))), "tree", "dim", "code", "at").sortWithinPartitions("tree", "dim", "code", "at")
    graph = save(_nearest(lined.mapInArrow(tidy(_leaves(degree, leaf)), _EDGE), degree), "graph")
    for turn in range(rounds):
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        both = graph.select(F.col("node").alias("centre"), F.col("other").alias("node"), "fresh").union(graph.select(F.col("other").alias("centre"), "node", "fresh"))
        groups = save(both.groupBy("centre").agg(F.ceil(F.count("*") / GROUP).alias("groups")).filter("groups > 1"), "groups")
        part = F.when(F.col("groups").isNotNull(), F.pmod(F.xxhash64("node", F.lit(turn)), "groups")).otherwise(F.lit(0).cast("long"))
        both = both.join(groups, "centre", "left").withColumn("part", part)
        met = (
            both.join(nodes.join(worst, "node"), "node")
            .groupBy("centre", "part")
            .agg(F.collect_list(F.struct("node", "worst", "fresh", "vector")).alias("members"))
            .select("members")
            .mapInArrow(tidy(_meet(degree)), _EDGE)
        )
        after = save(_nearest(graph.withColumn("fresh", F.lit(False)).union(met), degree), "graph")
        drop(graph)
        drop(groups)
        graph = after
        if not graph.filter("fresh").limit(1).count():
            break
    return graph


def _within_range(m: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles are multiplied by a power of two, which loses nothing."""
    most = np.abs(m).max(axis=1)
    far = (most > 1e100) | (most < 1e-100)
    if far.any():
        m = m.copy()
        m[far] = np.ldexp(m[far], -np.frexp(most[far])[1][:, None])
    return m


def _scored(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (query, node) and their cosine in double precision; queries: (query, own vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = np.full(batch.num_rows, -2.0)
            left, right = batch.column(2), batch.column(3)
            a_len, b_len = left.value_lengths().to_numpy(), right.value_lengths().to_numpy()
            for dim in np.unique(a_len[a_len == b_len]).tolist():
                at = np.flatnonzero((a_len == dim) & (b_len == dim))
                a, b = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(np.float64) for c in (left, right))
                a, b = _within_range(a), _within_range(b)
                dot = (a * b).sum(axis=1)
                sims[at] = dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["query", "node", "score"])

    own = queries.select("query", F.col("vector").alias("left"))
    return (
        pairs.join(nodes, "node")
        .join(own, "query")
        .select("query", "node", "left", F.col("vector").alias("right"))
        .mapInArrow(tidy(run), "query long, node long, score double")
        .filter("score >= -1.5")
    )


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(query, node, score) of the best ``beam`` nodes found for each of queries (query, node, vector), a saved table."""
    back = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    turned = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim").withColumn("rank", F.row_number().over(back)).filter(F.col("rank") <= degree)
    links = save(graph.select("node", "other").union(turned.select("node", "other")).groupBy("node").agg(F.collect_set("other").alias("others")), "links")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    best = save(queries.select("query", "node", F.lit(1.0).alias("score"), F.lit(False).alias("opened")), "beam")
    met = save(queries.select("query", F.array("node").alias("met")), "met")
    while best.filter("not opened").limit(1).count():
        around = best.filter("not opened").join(links, "node").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("around"))
        step = save(around.join(met, "query").select("query", F.array_except("around", "met").alias("new"), F.array_union("met", "around").alias("met")), "met")
        scored = _scored(step.select("query", F.explode("new").alias("node")), queries, nodes).withColumn("opened", F.lit(False))
        every = best.withColumn("opened", F.lit(True)).union(scored)
        after = save(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= beam).drop("rank"), "beam")
        for x in (best, met):
            drop(x)
        best, met = after, step
    for x in (links, met):
        drop(x)
    return best.select("query", "node", "score")


def nearest_neighbours(
    table: DataFrame, query_filter: str, k: int = 5, degree: int = DEGREE, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row that ``query_filter`` holds for; a saved table.

    query_filter: a condition on vec_id.
    """
    with scratch(table.sparkSession):
        return keep(save(_neighbours(table, query_filter, k, degree, beam, id_col, vector_col), "neighbours"))


def _neighbours(table: DataFrame, query_filter: str, k: int, degree: int, beam: int, id_col: str, vector_col: str) -> DataFrame:
    rows = save(usable(table, id_col, vector_col), "vectors")
    nodes = save(rows.groupBy("node").agg(F.first("vector").alias("vector")), "nodes")
    graph = neighbour_graph(nodes, degree)
    asked = rows.filter(query_filter)
    queries = save(asked.groupBy("node").agg(F.first("vector").alias("vector")).select(F.col("node").alias("query"), "node", "vector"), "queries")
    found = greedy_search(queries, graph, nodes, degree, max(beam, k + 1))
    drop(graph)
    # rows of one vector: only the smallest ids can be among the nearest
    ids = Window.partitionBy("node").orderBy("vec_id")
    few = rows.select("node", "vec_id").withColumn("copy", F.row_number().over(ids)).filter(F.col("copy") <= k + 1)
    own = queries.select("query", "node", "vector")
    top = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "copy")
    self_score = _scored(own.select("query", "node"), queries, nodes)
    scored = found.filter("query <> node").union(self_score)
    best = scored.join(few, "node").withColumn("at", F.row_number().over(top)).filter(F.col("at") <= k + 1).select("query", "node", "vec_id", "copy", "score")
    # of its own vector's rows, a query leaves out itself
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).withColumn("copy_of", F.row_number().over(Window.partitionBy("query", "query_id").orderBy("query")))
    pairs = asked.join(best, "query").withColumn("same", F.row_number().over(Window.partitionBy("query_id", "copy_of", "query", "vec_id").orderBy(F.col("node") != F.col("query"), "copy")))
    pairs = pairs.filter((F.col("vec_id") != F.col("query_id")) | (F.col("node") != F.col("query")) | (F.col("same") > 1))
    rank = F.row_number().over(Window.partitionBy("query_id", "query", "copy_of").orderBy(F.col("score").desc(), "vec_id", "copy"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

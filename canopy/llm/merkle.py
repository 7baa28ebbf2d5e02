"""Merkle manifest of a dataset: a digest for each row, a tree of digests for each source, and one root.

A leaf is the digest of a row's fields.  Leaves of a source are numbered by doc_id; the number divided by ``fanout``
is the number of the parent, whose digest is that of its children in order, level by level, until one node is left:
the source's subroot.  Subroots, ordered by source, make the root in the same way.

Numbers without a task for a whole source: rows are dealt by ranges of (source, doc_id) and written with the number
of their part; ``row_number`` counts inside a part, and a running sum over the parts' counts does the rest.

Proofs go from the top down: each node gets the steps of its parent's way to the root and its own step in front (the
digests left and right of it), by one join a level, where a parent has ``fanout`` children at most, so no key is hot.
Sixteen leaves share one way, which they meet in the row that holds them; there each leaf is folded up to the root, so
ways are never written for single documents.

Rows: each field may be null (it counts as ``-``); an empty text is a field of zero bytes; a null source is a source of
its own and the first; rows of one source are ordered by doc_id (null first), equal ids by leaf, and equal rows are as
many equal leaves; texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.store import drop, save

FANOUT, TAMPER_ONE_IN = 16, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' text, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` is much faster and equal where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def row_digests(docs: DataFrame, tamper_one_in: int = TAMPER_ONE_IN) -> DataFrame:
    """(doc_id, source, leaf, tampered) of each row; tampered: the leaf with the text in lower case, for one row in so many."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    rows = docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS))
    leaf = lambda text: digest(*(field_text(F.col(c)) for c in FIELDS[:-1]), field_text(text))
    hit = F.crc32(F.col("doc_id").cast("string")) % tamper_one_in == 0
    return rows.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(lower_ascii(F.col("text")))).alias("tampered"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, their number from 0 in their group ``grp`` by ``order``, and ``size``, the group's rows; a saved table.

    Groups aren't null; no group needs to fit in a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save(rows.repartitionByRange(parts, "grp", *order).withColumn("part", F.spark_partition_id()), name)
    # one row for each group in each part, so a window over the parts of a group is small
    counts = dealt.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    of_group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("grp", "part", before.alias("before"), F.sum("rows").over(of_group).alias("size"))
    here = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    out = dealt.withColumn("here", here).join(starts, ["grp", "part"])
    numbers = save(out.select(*rows.columns, (F.col("before") + F.col("here")).alias("idx"), "size"), name)
    drop(dealt)
    return numbers


def _blocks(nodes: DataFrame, fanout: int, more: list[str]) -> DataFrame:
    """The parents of the nodes (grp, idx, size, hash, more): (grp, idx, size, lone, children, hash); lone: no sibling in the group."""
    child = F.struct("idx", "hash", *more)
    parents = nodes.groupBy("grp", "size", F.floor(F.col("idx") / fanout).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    size, hash_ = F.ceil(F.col("size") / fanout), digest(F.array_join("children.hash", ""))
    return parents.select("grp", F.col("up").alias("idx"), size.alias("size"), (F.col("size") == 1).alias("lone"), "children", hash_.alias("hash"))


def tree(nodes: DataFrame, more: list[str], fanout: int, name: str) -> list[DataFrame]:
    """The blocks of the nodes (grp, idx, size, hash, more), and those of each level above, saved tables, until no group has two blocks."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels = [save(_blocks(nodes, fanout, more), name)]
    while (most := -(-most // fanout)) > 1:
        levels.append(save(_blocks(levels[-1].filter("size > 1").select("grp", "idx", "size", "hash"), fanout, []), name))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(grp, top): the digest that is left of each group."""
    top = F.when(F.col("lone"), F.col("children")[0]["hash"]).otherwise(F.col("hash"))
    parts = [level.filter("size = 1").select("grp", top.alias("top")) for level in levels]
    return reduce(DataFrame.union, parts)


#: The steps of a node's way to the root: what stands left and right of it in its block, and so on upwards.
WAY = "array<struct<left:string,right:string>>"


def _longer(way: Column, children: Column, at: Column) -> Column:
    """The way of the child at a place (from 0) of a block that has ``way``."""
    hashes = children["hash"]
    left, right = F.slice(hashes, F.lit(1), at), F.slice(hashes, at + 2, F.size(hashes))
    return F.concat(F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))), way)


def with_ways(levels: list[DataFrame], known: DataFrame) -> DataFrame:
    """The blocks of the lowest level, each with the columns of its group in ``known``, where ``way`` is that of the group's top."""
    more = [c for c in known.columns if c not in ("grp", "way")]
    below = None
    for level in reversed(levels):
        out = level.filter("size = 1").join(known, "grp")
        if below is not None:
            out = out.unionByName(level.filter("size > 1").join(below, ["grp", "idx"]))
        if level is not levels[0]:
            way = lambda c, at: F.struct(c["idx"].alias("idx"), _longer(F.col("way"), F.col("children"), at).alias("way"))
            below = out.select("grp", *more, F.inline(F.transform("children", way)))
    return out


def _ways_of_children(at: Column) -> Column:
    return F.when(F.col("lone"), F.col("way")).otherwise(_longer(F.col("way"), F.col("children"), at))


def folded(start: Column, way: Column) -> Column:
    """The digest that a node's digest becomes on its way up."""
    return F.aggregate(way, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def manifest(docs: DataFrame, fanout: int = FANOUT, tamper_one_in: int = TAMPER_ONE_IN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``."""
    group = F.struct(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"))
    rows = row_digests(docs, tamper_one_in).select(group.alias("grp"), "doc_id", F.col("leaf").alias("hash"), "tampered")
    leaves = numbered(rows, ["doc_id", "hash"], "leaves")
    levels = tree(leaves, ["doc_id", "tampered"], fanout, "blocks")
    drop(leaves)

    # the tree over the subroots is that of one group; what it gives each source is the start of its leaves' ways
    subroots = numbered(tops(levels).select(F.lit(0).alias("grp"), F.col("grp").alias("source"), F.col("top").alias("hash")), ["source"], "subroots")
    above = tree(subroots, ["source"], fanout, "tops")
    root = tops(above).select("grp", F.col("top").alias("root"), F.array().cast(WAY).alias("way"))
    way = lambda c, at: F.struct(c["source"].alias("grp"), c["hash"].alias("subroot"), _ways_of_children(at).alias("way"))
    known = save(with_ways(above, root).select("root", F.inline(F.transform("children", way))), "subroots")
    for x in (subroots, *above):
        drop(x)

    def leaf(c: Column, at: Column) -> Column:
        way = _ways_of_children(at)
        siblings = F.transform(way, lambda x: F.concat(x["left"], x["right"]))
        return F.struct(
            c["doc_id"].alias("doc_id"), c["hash"].alias("leaf"), digest(F.array_join(siblings, "")).alias("proof_sha256"),
            folded(F.coalesce(c["tampered"], c["hash"]), way).alias("folded_root"),
        )

    out = with_ways(levels, known).select("subroot", "root", F.inline(F.transform("children", leaf)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's set holds hashes of its distinct word shingles.  One permutation of the 32-bit circle is applied to
all of them; a second one, circularly shifted by k steps, gives coordinate k of the signature as its
smallest value.  Bands of coordinates are bucket keys.

Texts of equal sets form a class, of which one representative goes on.  Within a bucket no pairs are made:
each member is compared with the bucket's pivot, the member that shares buckets with most others, on the
full sets.  What a pivot leaves in different components is compared in blocks of bounded size: the members outside
the bucket's most populous component with each other and with those inside it, one pair of blocks a row, so a
bucket of many unlike texts is spread over all tasks, and only links leave them.  Blocks hold sets of about one size, and
pairs of blocks whose sizes are too far apart for the threshold aren't made.  So every two representatives of
a bucket are linked, known to be unlike, or already in one component; the components are those of all links of
bucket mates.  With ``bands(threshold)`` bands of four coordinates, two texts at the threshold miss each other
with a probability under one in a million.

Joins by bucket are between written tables, so that adaptive execution can split a bucket with very many members;
what is aggregated by bucket is aggregated before it is shuffled.

Rows: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts
with fewer words than a shingle have their whole sequence as the one shingle; texts are taken whole; rows
that repeat an id are one document, so the components of their texts are one component (rows without words
still stand for themselves), and if it is the component's smallest id, all its rows are kept; rows without an id
are linked with nothing and kept, their component is null; ties are decided by the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import id_and_text, slices, tidy
from canopy.llm.store import drop, save

ROWS, MISS = 4, 1e-6
#: Ids up to this count may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A block of bucket members that are compared within one task: shingles in all, and members.
BLOCK_SHINGLES, BLOCK_MEMBERS = 200_000, 256

_U = np.uint64


def bands_for(percent: int) -> int:
    """Bands of ROWS coordinates that find two sets at the threshold but for a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _permute(x: np.ndarray, one: int, two: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(one)
    x ^= x >> np.uint32(13)
    x *= np.uint32(two)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: list[str], words_each: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z are lowered."""
    split = [t.encode().lower().split() for t in texts]
    hashed = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
    weights = mix64(np.arange(1, words_each + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    out = []
    for words in split:
        h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
        n = len(h) - words_each + 1
        if n < 1:
            whole = h * weights[: len(h)]
            sums = np.array([whole.sum() + _U(len(h))], np.uint64) if len(h) else np.zeros(0, np.uint64)
        else:
            sums = h[:n] * weights[0]
            for k in range(1, words_each):
                sums += h[k : k + n] * weights[k]
        out.append(np.unique(mix64(sums)))
    return out


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least of pi(sigma(x) + k steps)."""
    sigma = _permute((shingles >> _U(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    steps = (np.arange(coordinates, dtype=np.uint64) * _U(0x9E3779B9)).astype(np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 8192):
        shifted = steps[:, None] + sigma[None, at : at + 8192]
        np.minimum(least, _permute(shifted, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, bands) 64-bit keys."""
    parts = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k] + _U(1))
    return key


def _long_lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, words_each: int, bands: int) -> DataFrame:
    """(doc_id, n, h1, h2, keys): size and two digests of each set, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            sets = shingle_sets(texts, words_each)
            keys = band_keys(np.stack([signature(s, bands * ROWS) for s in sets]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *_digests(sets), _long_lists(list(keys))],
                names=["doc_id", "n", "h1", "h2", "keys"],
            )

    return docs.mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, keys array<long>")


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two digests of each set; equal for equal sets."""
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array(np.array([mix64(s + _U(7)).sum() for s in sets], np.uint64).view(np.int64)),
        pa.array(np.array([np.bitwise_xor.reduce(s) for s in sets], np.uint64).view(np.int64)),
    ]


def full_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """(n, h1, h2, shingles) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            sets = shingle_sets(texts, words_each)
            yield pa.RecordBatch.from_arrays([*_digests(sets), _long_lists(sets)], names=["n", "h1", "h2", "shingles"])

    return docs.mapInArrow(tidy(run), "n long, h1 long, h2 long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for each id that has one.

    Every round takes the smallest label of the neighbours and then follows labels once, so the rounds grow
    with the logarithm of a chain's length; each is written down.
    """
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = save(label.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c")), "labels")
        after = save(
            step.join(step.select(F.col("id").alias("c"), F.col("c").alias("next")), "c").select("id", "old", F.col("next").alias("c")), "labels"
        )
        drop(step)
        drop(label)
        moved = after.filter("c <> old").limit(1).count()
        label = after
        if not moved:
            drop(both)
            return label.select("id", F.col("c").alias("component"))


def _block(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, sizes and shingles one after the other."""
    lists = members.field("shingles")
    return members.field("id").to_numpy(), members.field("component").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()


def _compare(percent: int):
    """Links between the members of two blocks of a bucket that aren't in one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                (id_l, comp_l, size_l, flat_l), (id_r, comp_r, size_r, flat_r) = (_block(batch.column(k)[row].values) for k in (0, 1))
                sizes, split = np.concatenate((size_l, size_r)), len(id_l)
                _, code = np.unique(np.concatenate((flat_l, flat_r)), return_inverse=True)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                # the columns are taken in slices, so that the tables of zeros and ones stay small
                by = np.argsort(code, kind="stable")
                code, owner = code[by], owner[by]
                shared = np.zeros((split, len(sizes) - split), np.float64)
                width = 4096
                edges = np.searchsorted(code, np.arange(0, code[-1] + width + 1, width)) if len(code) else [0]
                for k in range(len(edges) - 1):
                    table = np.zeros((len(sizes), width), np.float32)
                    part = slice(edges[k], edges[k + 1])
                    table[owner[part], code[part] - k * width] = 1
                    shared += table[:split] @ table[split:].T
                union = sizes[:split, None] + sizes[None, split:] - shared
                hit = (100 * shared >= percent * union) & (comp_l[:, None] != comp_r[None, :])
                i, j = np.nonzero(hit)
                # one link joins two components
                _, one = np.unique(np.stack((comp_l[i], comp_r[j])), axis=1, return_index=True)
                links.append((id_l[i[one]], id_r[j[one]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in links]) if links else [], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _size_class(percent: int):
    """A number of a set's size n; sets whose numbers differ by two or more can't be linked."""
    return F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("long") if percent < 100 else F.col("n")


def _left_over(member: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Saved links (a, b) within buckets whose members are in several components, once for each set of members."""
    placed = member.select("key", "id", "n").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    state = save(placed.withColumn("class", _size_class(percent)), "state")
    each = state.groupBy("key", "component").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("who"))
    apart = save(
        each.groupBy("key")
        .agg(F.max(F.struct("members", "component")).alias("most"), F.sum("members").alias("members"), F.bit_xor("who").alias("who"), F.count("*").alias("components"))
        .filter("components > 1 and members > 2")
        .groupBy("who", "members")
        .agg(F.min_by(F.struct("key", F.col("most.component").alias("main")), "key").alias("x"))
        .select("x.*"),
        "apart",
    )
    # blocks of the members of one size class, in the main component or outside it
    other = F.col("component") != F.col("main")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    dealt = save(state.join(apart, "key").groupBy("key", "main", other.alias("other"), "class").agg(blocks), "dealt")
    rows = state.join(dealt, ["key", "class"]).filter(F.col("other") == other)
    rows = rows.select("key", "id", "component", "other", "class", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    block = save(
        rows.join(sets, "id").groupBy("key", "other", "class", "block").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("members")),
        "blocks",
    )
    # pairs of blocks of near size: other members with each other, each pair once, and with the main component
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    to = dealt.select("key", F.col("other").alias("to_other"), F.col("class").alias("to_class"), numbers.alias("j"))
    pairs = dealt.filter("other").select("key", "class", numbers.alias("i")).withColumn("to_class", near).join(to, ["key", "to_class"])
    pairs = pairs.filter("not to_other or to_class > class or (to_class = class and j >= i)")
    left = block.filter("other").select("key", "class", F.col("block").alias("i"), F.col("members").alias("left"))
    right = block.select("key", F.col("other").alias("to_other"), F.col("class").alias("to_class"), F.col("block").alias("j"), F.col("members").alias("right"))
    met = pairs.join(left, ["key", "class", "i"]).join(right, ["key", "to_other", "to_class", "j"]).select("left", "right")
    more = save(met.mapInArrow(tidy(_compare(percent)), "a long, b long"), "links")
    for x in (state, apart, dealt, block):
        drop(x)
    return more


def _semi(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``name`` is among the saved ``ids``; broadcast while they are few."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, name, "left_semi")


def near_duplicates(
    docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where 100 * |A & B| >= percent * |A | B|; a saved table."""
    every = id_and_text(docs, id_col, text_col)
    signed = save(signatures(every, words_each, bands_for(percent)), "signatures")
    named = signed.filter("doc_id is not null and n > 0")
    digest = ["h1", "h2", "n"]
    classes = save(
        named.groupBy(*digest).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).withColumn("id", F.xxhash64(*digest)), "classes"
    )

    # buckets with several representatives; sizes and pivots are written, so that a join with them can be split
    spread = classes.select("id", "n", F.explode("keys").alias("key"))
    sizes = save(spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    member = save(spread.join(sizes, "key"), "members")
    score = member.groupBy("id").agg(F.sum("size").alias("score"))
    pivot = save(member.join(score, "id").groupBy("key").agg(F.max(F.struct("score", "id", "n")).alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    pairs = save(
        member.join(pivot, "key")
        .filter((F.col("id") != F.col("pivot")) & (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")))
        .select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        .distinct(),
        "pairs",
    )
    wanted = classes.join(member.select("id").distinct(), "id", "left_semi")
    ids = save(wanted.select("doc_id").distinct(), "candidates")
    sets = save(
        full_sets(_semi(every, ids, "doc_id"), words_each)
        .join(wanted.select("id", *digest), digest)
        .groupBy("id")
        .agg(F.first("shingles").alias("shingles")),
        "sets",
    )
    shared = F.size(F.array_intersect("left", "right"))
    links = save(
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .filter(100 * shared >= percent * (F.size("left") + F.size("right") - shared))
        .select("a", "b"),
        "links",
    )
    drop(pairs)
    first = components(links)

    more = _left_over(member, first, sets, percent)
    # texts of one id
    ids_of = named.select("doc_id", F.xxhash64(*digest).alias("id"))
    several = save(ids_of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("doc_id", "a"), "several")
    same = save(ids_of.join(several, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "same")
    label = components(links.union(more).union(same)) if more.union(same).limit(1).count() else first

    placed = classes.join(label, "id", "left").select(*digest, "doc_id", F.coalesce("component", "id").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = placed.join(smallest, "component").select(*digest, "component_id")
    out = signed.join(whole, digest, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = save(out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))), "near-duplicates")
    for x in (signed, classes, sizes, member, pivot, ids, sets, links, more, several, same):
        drop(x)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

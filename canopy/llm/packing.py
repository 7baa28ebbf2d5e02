"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity`` tokens, and pieces become sequences (bins).  Pieces are
dealt at random into blocks of bounded size.  Each block is evolved on several islands: a crossover injects
whole well-filled bins of one parent into the other, bins that then hold a document twice are removed, and
the displaced documents are placed anew by best fit, longest first.  Between rounds the best packing of each
island migrates to the next one through a shuffle.  The worst filled bins of all blocks, those with at most half of
each block's items, are then thrown together and packed again, until one block is left, so the loss per block
doesn't add up at any size.  Lengths alone are shuffled, never text or ids.

Rows: null and empty texts count as empty documents, which are one piece holding the end id alone; only
documents longer than the capacity are cut; repeated rows are packed one by one; ties (equal lengths) are
broken by row number; an empty table gives an empty result; other columns are ignored, a null id stays null.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import SLICE_CHARS, id_and_text, slices, tidy
from canopy.llm.store import keep, save, scratch
from canopy.llm.words import WordEncoder

CAPACITY, END_ID = 4096, 1
BLOCK_ITEMS, ISLANDS, ROUNDS = 8192, 3, 2
POPULATION, GENERATIONS = 4, 6
#: Bins that are filled less may be packed again across blocks.
WELL_FILLED = 0.99

_OPEN: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for ids, texts in slices(batches, 2 * SLICE_CHARS):
            rows = []
            for doc_id, b in zip(ids, encoder.encode(texts), strict=True):
                b += end
                for piece, at in enumerate(range(0, len(b), 4 * capacity)):
                    part = b[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *[np.frombuffer(part, "<u4").tolist()] * with_ids))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
        encoder.words.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), schema)


class Bins:
    """Bins by what is left in them, so that the tightest fit is found by one look at a bit set."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.left: list[int] = []
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit r: some bin has r left

    def add(self, items: list[int]) -> None:
        left = self.capacity - sum(map(self.lengths.__getitem__, items))
        self.by_left[left].append(len(self.items))
        self.open |= 1 << left
        self.items.append(items)
        self.left.append(left)

    def place(self, item: int) -> None:
        size = self.lengths[item]
        fits = self.open >> size
        if not fits:
            self.add([item])
            return
        left = (fits & -fits).bit_length() - 1 + size
        same = self.by_left[left]
        k = same.pop()
        if not same:
            self.open ^= 1 << left
        self.items[k].append(item)
        left -= size
        self.left[k] = left
        self.by_left[left].append(k)
        self.open |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Smaller is better: bins, and then how evenly full they are (full and empty beats half and half)."""
        return len(self.items), -sum((self.capacity - x) ** 2 for x in self.left)


def best_fit(lengths: list[int], order: list[int], capacity: int) -> Bins:
    bins = Bins(lengths, capacity)
    for item in order:
        bins.place(item)
    return bins


def crossover(one: Bins, two: Bins, rng: random.Random) -> Bins:
    """``one`` with some of the best-filled bins of ``two`` injected."""
    ranked = sorted(range(len(two.items)), key=two.left.__getitem__)
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(good, max(1, int(len(good) * rng.uniform(0.2, 0.8))))
    taken = bytearray(len(one.lengths))
    child = Bins(one.lengths, one.capacity)
    for k in chosen:
        child.add(two.items[k].copy())
        for item in two.items[k]:
            taken[item] = 1
    worst = sorted(one.left)[-max(1, len(one.left) // 50)]
    displaced = []
    for items, left in zip(one.items, one.left, strict=True):
        if left >= worst and left or any(map(taken.__getitem__, items)):
            displaced += [i for i in items if not taken[i]]
        else:
            child.add(items.copy())
    displaced.sort(key=one.lengths.__getitem__, reverse=True)
    for item in displaced:
        child.place(item)
    return child


def least_bins(lengths: list[int], capacity: int) -> int:
    return max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))


def evolve(lengths: list[int], elites: list[list[int]], capacity: int, seed: int) -> list[int]:
    """The bin of each item in the best packing that the island finds; ``lengths`` from the longest on.

    elites: bins of the items in packings that came from this island's and the neighbour's last round.
    """
    rng, least, n = random.Random(seed), least_bins(lengths, capacity), len(lengths)
    people = []
    for bins_of in elites:
        groups: dict[int, list[int]] = {}
        for item, k in enumerate(bins_of):
            groups.setdefault(k, []).append(item)
        person = Bins(lengths, capacity)
        for items in groups.values():
            person.add(items)
        people.append(person)
    if not people:
        people.append(best_fit(lengths, list(range(n)), capacity))
    best = min(people, key=Bins.fitness)
    if len(best.items) > least:
        while len(people) < POPULATION:  # longest first, but not quite
            noisy = [x * rng.uniform(0.8, 1.0) for x in lengths]
            people.append(best_fit(lengths, sorted(range(n), key=noisy.__getitem__, reverse=True), capacity))
        for _ in range(GENERATIONS):
            people.sort(key=Bins.fitness)
            if len(people[0].items) <= least:
                break
            a, b = people[0], people[rng.randrange(1, len(people))]
            people[-2:] = [crossover(a, b, rng), crossover(b, a, rng)]
        best = min(people, key=Bins.fitness)
    bin_of = [0] * n
    for k, items in enumerate(best.items):
        for item in items:
            bin_of[item] = k
    return bin_of


_BLOCK = "block long, island int, uids array<long>, lengths array<int>, elites array<array<int>>"


def _islands(capacity: int, salt: int):
    """mapInArrow function: each row is an island of a block, which gets its own elite in place of those it had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, island, uids, lengths, elites = (batch.column(k)[row].as_py() for k in range(5))
                if not elites:  # the first round: in no order yet
                    by = sorted(range(len(uids)), key=lambda i: (-lengths[i], uids[i]))
                    uids, lengths = [uids[i] for i in by], [lengths[i] for i in by]
                elite = evolve(lengths, elites, capacity, hash((block, island, salt)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([uids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([[elite]], pa.list_(pa.list_(pa.int32())))],
                    names=["block", "island", "uids", "lengths", "elites"],
                )

    return run


def _placed(capacity: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, uids, lengths, elite = (batch.column(k)[row].as_py() for k in range(4))
                bins, length = np.array(elite, np.int64), np.array(lengths, np.int64)
                by = np.argsort(bins, kind="stable")
                ends = np.cumsum(length[by])
                fill = np.bincount(bins, length)
                before = np.concatenate(([0], np.cumsum(fill)))
                offset = ends - length[by] - before[bins[by]]
                # the worst filled bins that hold half of the items together at most: so every level halves the items
                worst = np.argsort(fill, kind="stable")
                few = np.cumsum(np.bincount(bins)[worst]) <= len(bins) // 2
                again = np.zeros(len(fill), bool)
                again[worst[few]] = fill[worst[few]] < WELL_FILLED * capacity
                # 8 bits for the level, 35 for the block, 20 for the bin
                sequence = (level << 55) + (block << 20) + bins[by]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in (np.array(uids, np.int64)[by], sequence, offset.astype(np.int64), length[by])), pa.array(again[bins[by]])],
                    names=["uid", "sequence_id", "offset", "length", "again"],
                )

    return run


def pack_items(
    items: DataFrame,
    capacity: int = CAPACITY,
    block_items: int = BLOCK_ITEMS,
    islands: int = ISLANDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid long, unique; length from 1 to the capacity)."""
    spark = items.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = ("uid", "sequence_id", "offset")
    done = [items.filter(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, level = items.filter(F.col("length") < capacity).select("uid", "length"), 0
    n = rest.count()
    while n:
        blocks = math.ceil(n / block_items)
        island = (
            rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"))
            .agg(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length"))).alias("x"))
            .select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.uid").alias("uids"), F.col("x.length").alias("lengths"), F.expr("cast(array() as array<array<int>>)").alias("elites"))
        )
        spread = min(tasks, blocks * islands)
        for k in range(rounds):
            if k:  # each elite stays and goes to the next island too
                to = F.explode(F.array("island", ((F.col("island") + 1) % islands).cast("int"))).alias("island")
                island = island.select("block", to, "uids", "lengths", F.col("elites")[0].alias("elite"))
                island = island.groupBy("block", "island").agg(F.first("uids").alias("uids"), F.first("lengths").alias("lengths"), F.sort_array(F.collect_set("elite")).alias("elites"))
            island = island.repartition(spread, "block", "island").mapInArrow(tidy(_islands(capacity, 100 * level + k)), _BLOCK)
        elite = F.col("elites")[0]
        best = island.groupBy("block").agg(F.min_by(F.struct("uids", "lengths", elite.alias("elite")), F.struct(F.array_max(elite), "island")).alias("x"))
        placed = save(best.select("block", "x.*").mapInArrow(tidy(_placed(capacity, level)), "uid long, sequence_id long, offset long, length long, again boolean"), "packed")
        if blocks == 1:
            done.append(placed.select(*columns))
            break
        done.append(placed.filter("not again").select(*columns))
        rest = placed.filter("again").select("uid", "length")
        n, level = rest.count(), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; a saved table."""
    with scratch(docs.sparkSession):
        pieces = save(token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
        return keep(save(pieces.join(pack_items(pieces.select("uid", "length"), capacity), "uid").drop("uid"), "packing"))


def packed_sequences(docs: DataFrame, tokenizer: str, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, for a corpus whose doc_id is unique."""
    pieces = token_pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids")
    return (
        pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    )



"""Line dedup by winnowing over line hashes.

Each document is a row of hashes of its lines that have words.  A gram is the shortest stretch of lines from
some line on with at least ``gram_words`` words; a window is the shortest stretch with at least ``run_words``
words, and of the grams inside it the one with the smallest hash is its fingerprint.  Two documents that share
a run of lines with ``run_words`` words share the run's first window, hence a fingerprint at the same place of
the run: that is guaranteed.

A fingerprint's row holds the lines around it: those of the windows that selected it and, after them, as many as
have ``run_words`` words.  Fingerprints are joined by hash to their first occurrence, and each match is extended both
ways over these lines.  A run of equal lines with at least ``run_words`` words is a repeat, and all its lines are deleted in
the later place; a longer repeat is a chain of such runs, as every window in it has a fingerprint of its own.  A
window that its fingerprint's run doesn't hold (the surroundings of the first occurrence differ) is joined once more by
its own hash and extended.  So pairs of all occurrences are never made, every window that stands at an earlier place
too is found, and the work is in proportion to the lines, also where a text repeats one line any number of times.
The first occurrence of a line is never deleted, as what a run is matched with stands earlier.

A gram with very many matches: first occurrences are aggregated before they are shuffled and written, and each match is
a row of its own, so every join is between plain shuffles, of which adaptive execution splits the parts that
are much larger than others.

Rows: documents are ordered by doc_id (null last), then by a digest of the text; rows that are equal in both
are one document, and share one result; null text stays null, empty text stays empty; lines without words
match nothing and go only within a deleted run; very long texts are taken whole; an empty table gives an empty
result; other columns are kept as they are, and may have any name but those that start with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import bounded_batches, tidy
from canopy.llm.store import drop, save

GRAM_WORDS, RUN_WORDS = 25, 50
#: Fingerprints that are handed on at a time.
PRINTS = 10_000
#: Deletions of so many documents may be broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_DOC = "struct<none:boolean,id:long,digest:long>"
_hash = xxhash.xxh3_64_intdigest


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and number of words of each line that has words; lines are cut at line feeds."""
    hashes, words = [], []
    for line in text.encode().split(b"\n"):
        n = len(line.split())
        if n:
            hashes.append(_hash(line.strip()))
            words.append(n)
    return np.array(hashes, np.uint64).view(np.int64), np.array(words, np.int64)


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram_words: int, run_words: int) -> list[tuple[int, int, int, int, int]]:
    """(line, hash of its gram, first line, windows, end) of each fingerprint: of how many windows it is the minimum, the
    first of which begins at the first line, and where the lines around it end."""
    total = np.concatenate(([0], np.cumsum(words)))
    gram_end = np.searchsorted(total, total[:-1] + gram_words).tolist()
    window_end = np.searchsorted(total, total[:-1] + run_words).tolist()
    n, raw = len(hashes), hashes.tobytes()
    grams = [_signed(raw[8 * i : 8 * e]) if e <= n else 0 for i, e in enumerate(gram_end)]
    found: dict[int, list[int]] = {}  # line -> first window, windows, end of the last
    for i, end in enumerate(window_end):
        if end > n:
            break
        stop = i + 1
        while stop < end and gram_end[stop] <= end:
            stop += 1
        at = min(range(i, stop), key=grams.__getitem__)
        one = found.setdefault(at, [i, 0, end])
        one[1:] = one[1] + 1, end
    return [(at, grams[at], first, many, min(window_end[end], n) if end < n else n) for at, (first, many, end) in found.items()]


def _signed(raw: bytes) -> int:
    return _hash(raw) - (1 << 63)


def matched(at: int, hashes: list[int], words: list[int], other_at: int, other: list[int], windows: int, run_words: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The run of equal lines around the lines ``at`` and ``other_at`` of two stretches, [begin, end] if it has enough words, and those of
    the first ``windows`` windows of the first stretch that the run doesn't hold."""
    a, b = at, other_at
    while a and b and hashes[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
    end, b = at, other_at
    while end < len(hashes) and b < len(other) and hashes[end] == other[b]:
        end, b = end + 1, b + 1
    run = [a, end] if sum(words[a:end]) >= run_words else []
    missed, stop, held = [], 0, 0
    for begin in range(windows):
        while held < run_words:
            held += words[stop]
            stop += 1
        if not run or begin < a or stop > end:
            missed.append((begin, stop))
        held -= words[begin]
    return run, missed


def _with_doc(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` and the identity of each, whose order is that of the documents."""
    id_ = F.col(id_col).cast("long")
    return bounded_batches(docs).withColumn(
        "__doc", F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"))
    )


_LONGS = pa.list_(pa.int64())


def _fingerprints(docs: DataFrame, text_col: str, gram_words: int, run_words: int) -> DataFrame:
    """(doc, key, at, first, windows, hashes, words) of each fingerprint; first: the line with which the arrays begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                hashes, words = line_hashes(batch.column(1)[k].as_py() or "")
                prints = fingerprints(hashes, words, gram_words, run_words)
                for some in (prints[a : a + PRINTS] for a in range(0, len(prints), PRINTS)):
                    at, key, first, windows, end = np.array(some, np.int64).T
                    offsets = pa.array(np.concatenate(([0], np.cumsum(end - first))), pa.int32())
                    places = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                    around = [pa.ListArray.from_arrays(offsets, pa.array(x[places])) for x in (hashes, words)]
                    doc = batch.column(0).take(pa.array(np.full(len(some), k)))
                    yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (key, at, first, windows)), *around], names=["doc", "key", "at", "first", "windows", "hashes", "words"])

    schema = f"doc {_DOC}, key long, at long, first long, windows long, hashes array<long>, words array<long>"
    return docs.select(F.col("__doc").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def _later(places: DataFrame, at: str, *around: str) -> DataFrame:
    """The places (key, doc, at, around) that aren't the first of their key, with the columns of the first as ``first_``, and ``one``: (doc, at)."""
    one = F.struct("doc", at)
    firsts = save(places.groupBy("key").agg(F.min(one).alias("one"), F.count("*").alias("n")).filter("n > 1").select("key", "one"), "firsts")
    # rows that are equal are one document, so a first place may stand there several times
    known = places.join(firsts.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (one == F.col("one"))).dropDuplicates(["key"])
    known = save(known.select("key", "one", *(F.col(c).alias(f"first_{c}") for c in (at, *around))), "firsts")
    drop(firsts)
    return places.join(known, "key").filter(one != F.col("one"))


def _first_matches(prints: DataFrame, run_words: int) -> DataFrame:
    """(doc, begin, end, missed): runs by the first places of fingerprints, null if too short, and the windows that they don't explain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends, missed = [], [], []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                at, first, windows, hashes, words, other_at, other_first, other = row
                found, left = matched(at - first, hashes, words, other_at - other_first, other, windows, run_words)
                begins.append(first + found[0] if found else None)
                ends.append(first + found[1] if found else None)
                raw = np.array(hashes, np.int64).tobytes() if left else b""
                missed.append([{"key": _signed(raw[8 * a : 8 * b]), "begin": first + a, "end": first + b, "tail": hashes[b:]} for a, b in left])
            window = pa.struct([("key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("tail", _LONGS)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(missed, pa.list_(window))], names=["doc", "begin", "end", "missed"])

    rows = _later(prints, "at", "first", "hashes").select("doc", "at", "first", "windows", "hashes", "words", "first_at", "first_first", "first_hashes")
    return rows.mapInArrow(tidy(run), f"doc {_DOC}, begin long, end long, missed array<struct<key:long,begin:long,end:long,tail:array<long>>>")


def _window_matches(windows: DataFrame) -> DataFrame:
    """(doc, begin, end): the later windows (key, doc, begin, end, tail) of each key with the lines after them that are equal too."""
    same = F.zip_with("tail", "first_tail", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    more = F.when(differ > 0, differ - 1).otherwise(F.size("tail"))
    return _later(windows, "begin", "tail").select("doc", "begin", (F.col("end") + more).alias("end"))


def _merged(runs: DataFrame) -> DataFrame:
    """(doc, runs, n): the runs (doc, begin, end) of each document as begins and ends that don't overlap, and their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, counts = [], []
            for k in range(batch.num_rows):
                begin, end = (batch.column(1)[k].values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(begin, kind="stable")
                begin, reach = begin[order], np.maximum.accumulate(end[order])
                new = np.append(True, begin[1:] > reach[:-1])
                both = np.stack((begin[new], reach[np.append(new[1:], True)]), axis=1)
                merged.append(both.ravel())
                counts.append(int((both[:, 1] - both[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, _LONGS), pa.array(counts, pa.int64())], names=["doc", "runs", "n"])

    gathered = runs.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    return gathered.mapInArrow(tidy(run), f"doc {_DOC}, runs array<long>, n long")


def _without(text: str, runs: list[int]) -> str:
    """``text`` without the lines of the runs, and without lines of white space inside them."""
    lines, some, gone = text.split("\n"), 0, set()
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        gone.update(range(a, b))
    kept, after = [], False
    for line in lines:
        if line.encode().split():
            after = some in gone
            some += 1
        if not after:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(
    docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with later repeated runs deleted from their texts, and ``n_deleted``: lines with words that went."""
    known = _with_doc(docs, id_col, text_col)
    prints = save(_fingerprints(known, text_col, gram_words, run_words), "prints")
    matches = save(_first_matches(prints, run_words), "matches")
    drop(prints)
    again = _window_matches(matches.select("doc", F.inline("missed")))
    runs = save(_merged(matches.filter("begin is not null").select("doc", "begin", "end").union(again)), "runs")
    drop(matches)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array((None if t is None else _without(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True)), pa.string())

    cut = cut.asNondeterministic()  # so that a filter on the texts doesn't cut them once more
    small = runs.count() <= BROADCAST_ROWS
    found = runs.select(F.col("doc").alias("__doc"), F.col("runs").alias("__runs"), F.col("n").alias("__n"))
    out = known.join(F.broadcast(found) if small else found, "__doc", "left")
    changed = F.col("__runs").isNotNull()  # the texts of others don't go to Python
    return (
        out.withColumn("__cut", cut(F.when(changed, F.col(text_col).cast("string")), "__runs"))
        .withColumn(text_col, F.when(changed, F.col("__cut")).otherwise(F.col(text_col)))
        .withColumn("n_deleted", F.coalesce("__n", F.lit(0)).cast("long"))
        .drop("__doc", "__runs", "__n", "__cut")
    )

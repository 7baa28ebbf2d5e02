"""Quality rules from a suffix array: repetition within a document.

The words of a batch of documents are put into one suffix array, each document with an end mark of its own, so that
nothing is common to two of them.  Ranks of prefixes of 1, 2, 4, ... words are refined only where they are still
shared.  Common prefixes of neighbours are counted word by word only for suffixes that no longer one's prefix tells
(those with another word before them); the others follow from the suffix before.  Intervals of common prefixes of
at least ``min_repeat`` words are found with a stack over those prefixes, and the intervals whose places have
different words before them are the maximal repeated substrings.  The union of their spans gives the covered
fraction, and the longest one the longest repeat.  Limits on both decide, after the base rules.

Memory: about 150 bytes a word of a batch, whatever repeats in it; a batch is BATCH_WORDS words or one document.

Rows: null and empty texts have no words and fail the base rules; texts are taken whole; a document's result
doesn't depend on other rows, so ties and repeated rows need no rule; an empty table gives an empty result;
other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import bounded_batches, id_and_text, text_column, tidy

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.3, 200
#: Documents are sorted together up to so many words; longer ones stand alone.
BATCH_WORDS = 200_000
#: Bytes of a text that are cut into words at a time.
SLICE_BYTES = 1 << 20
#: Entries of an array that are Python objects at a time.
SLICE = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_fraction double, longest_repeat long, n_repeats long, kept boolean, "
    "spans array<struct<start:long,end:long>>"
)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the rank of each, and a code for each word; the last of ``ids`` occurs nowhere else."""
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ids[order[1:]], ids[order[:-1]], out=new[1:])
    starts = np.flatnonzero(new).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = starts[np.cumsum(new) - 1]
    codes, k = rank.copy(), 1
    sizes = np.diff(np.append(starts, n))
    active = order[np.repeat(sizes > 1, sizes)]
    while len(active):
        # what is shared holds no end mark, so there is a word behind it
        both = rank[active].astype(np.int64) * n + rank[active + k]
        by = np.argsort(both, kind="stable")
        active, both = active[by], both[by]
        first = both // n
        begins = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        outer = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        sizes = np.diff(np.append(begins, len(active)))
        # the rank of a group is where it stands in the suffix array
        rank[active] = first + np.repeat(begins, sizes) - np.repeat(outer, np.diff(np.append(outer, len(active))))
        active = active[np.repeat(sizes > 1, sizes)]
        k *= 2
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    return suffixes, rank, codes


def _common(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the places ``a`` are those from the places ``b``."""
    out = np.zeros(len(a), np.int32)
    going = np.arange(len(a))
    while len(going) > 64:
        going = going[codes[a[going] + out[going]] == codes[b[going] + out[going]]]
        out[going] += 1
    for k in going.tolist():
        i, j, done, width = int(a[k]), int(b[k]), int(out[k]), 64
        while True:
            x, y = codes[i + done : i + done + width], codes[j + done : j + done + width]
            unlike = np.flatnonzero(x[: len(y)] != y[: len(x)])
            if len(unlike):
                out[k] = done + unlike[0]
                break
            done, width = done + width, 2 * width
    return out


def common_prefixes(suffixes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each suffix in order, how many of its first words are those of the one before it in order."""
    n = len(suffixes)
    before = np.full(n, -1, np.int32)
    before[suffixes[1:]] = suffixes[:-1]
    told = np.zeros(n, bool)  # the words before the two are equal: one word less than the suffix before has
    told[1:] = (before[1:] > 0) & (codes[:-1] == codes[before[1:] - 1])
    at = np.flatnonzero(~told & (before >= 0)).astype(np.int32)
    reach = np.zeros(n, np.int32)
    reach[at] = at + _common(codes, at, before[at])
    np.maximum.accumulate(reach, out=reach)
    reach -= np.arange(n, dtype=np.int32)
    return np.maximum(reach, 0)[suffixes]


def intervals(prefixes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of common prefixes of at least ``least`` words, an outer one behind those in it.

    Length, first and last rank of each; ranks with a prefix of that length, and the interval that each opens or is in.
    """
    at = np.flatnonzero(prefixes >= least)
    opened = np.zeros(len(at), np.int32)  # which interval, by the order of opening
    length, left, right, number = (array("i") for _ in range(4))
    stack: list[tuple[int, int, int]] = []  # length, first rank, number

    def close(last: int) -> int:
        size, first, k = stack.pop()
        length.append(size)
        left.append(first)
        right.append(last)
        number.append(k)
        return first

    previous, n = -1, 0
    for begin in range(0, len(at), SLICE):
        some = at[begin : begin + SLICE]
        for entry, (r, size) in enumerate(zip(some.tolist(), prefixes[some].tolist(), strict=True), begin):
            if r != previous + 1:
                while stack:
                    close(previous)
            first = r - 1
            while stack and stack[-1][0] > size:
                first = close(r - 1)
            if not stack or stack[-1][0] < size:
                stack.append((size, first, n))
                n += 1
            opened[entry] = stack[-1][2]
            previous = r
    while stack:
        close(previous)
    closed = np.empty(n, np.int32)
    closed[np.array(number, np.int32)] = np.arange(n, dtype=np.int32)
    return (*(np.array(x, np.int32) for x in (length, left, right)), at, closed[opened])


def repeated(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the words from there that another place has too, the longest maximal repeat of at least
    ``least`` words that begins there (0: none), and how many maximal repeats have their first place there.

    ids: equal for equal words of one document only; each document ends with a mark that occurs nowhere else.
    """
    n = len(ids)
    suffixes, rank, codes = suffix_array(ids)
    prefixes = common_prefixes(suffixes, codes)
    best = np.maximum(prefixes, np.append(prefixes[1:], 0))[rank]
    length, left, right, at, inside = intervals(prefixes, least)
    # maximal: the places have different words before them
    ahead = np.concatenate(([-1], codes[:-1]))[suffixes]
    unlike = np.cumsum(np.append(False, ahead[1:] != ahead[:-1]))
    maximal = unlike[right] > unlike[left]
    # an interval that isn't maximal lies in its parent's repeats; a parent comes after all in it
    longest, parents = np.where(maximal, length, 0), _parents(left, right)
    for k in range(len(length) - 1, -1, -1):
        if not maximal[k] and parents[k] >= 0:
            longest[k] = longest[parents[k]]
    spans, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for ranks in (at, at - 1):  # both neighbours of a prefix have it
        np.maximum.at(spans, suffixes[ranks], longest[inside])
    np.add.at(count, suffixes[left[maximal]], 1)
    return best, spans, count


def _parents(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest interval around each, or -1; an interval stands behind those in it."""
    out, open_ = np.full(len(left), -1, np.int32), []
    for k in range(len(left) - 1, -1, -1):
        while open_ and not (left[open_[-1]] <= left[k] and right[k] <= right[open_[-1]]):
            open_.pop()
        out[k] = open_[-1] if open_ else -1
        open_.append(k)
    return out


def _counts(text: str) -> tuple[int, int, int]:
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(text) - spaces, symbols, len(lines) - len(set(lines))


def _word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time, so that few of them are objects at once."""
    data, at = text.encode(), 0
    while at < len(data):
        cut = _SPACE.search(data, at + SLICE_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts, each text with an end mark, and the number of words of each."""
    parts, sizes = [], []
    for k, text in enumerate(texts):
        seen: dict[bytes, int] = {}
        found = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in _word_lists(text or "")]
        sizes.append(sum(map(len, found)))
        parts += [x + (k + 1 << 32) for x in found]
        parts.append(np.array([k], np.int64))  # the mark: smaller than all words
    return np.concatenate(parts), np.array(sizes, np.int64)


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest, repeats, spans) of each text."""
    if not texts:
        return []
    ids, sizes = _word_ids(texts)
    counts = [_counts(t or "") for t in texts]
    best, longest, firsts = repeated(ids, min_repeat)
    at = np.arange(len(ids))

    def covered(span: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(at + span) > at

    windows, inside = covered(np.where(best >= WINDOW, WINDOW, 0)), covered(longest)
    out, begin = [], 0
    for k, size in enumerate(sizes.tolist()):
        part = slice(begin, begin + size)
        share, spans = int(inside[part].sum()), []
        if share:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[part].view(np.int8), [0]))))
            spans = [{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        most = int(best[part].max()) if size else 0
        out.append((size, *counts[k], int(windows[part].sum()), share / size if size else 0.0, most, int(firsts[part].sum()), spans))
        begin += size + 1
    return out


def verdicts(rows: list[tuple], max_covered: float, max_longest: int) -> tuple[list[bool], list[bool]]:
    """Which of the measured texts fail the base rules, and which are kept."""
    failed = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rows]
    return failed, [not f and r[5] <= max_covered and r[6] <= max_longest for f, r in zip(failed, rows, strict=True)]


def keep_documents(
    docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts the rules keep."""
    kept = text_column("boolean", lambda texts: verdicts(measure(texts, min_repeat), max_covered, max_longest)[1])
    return bounded_batches(docs).withColumn("__kept", kept(F.col(text_col).cast("string"))).filter("__kept").drop("__kept")


def repetition_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Counts, repeated spans (of words) and verdict of each document."""

    def flush(ids: list, texts: list) -> pa.RecordBatch:
        rows = measure(texts, min_repeat)
        failed, kept = verdicts(rows, max_covered, max_longest)
        long = pa.int64()
        cols = [pa.array(ids, long), *(pa.array([r[i] for r in rows], long) for i in range(5)), pa.array(failed, pa.bool_())]
        cols += [pa.array([r[5] for r in rows], pa.float64()), *(pa.array([r[k] for r in rows], long) for k in (6, 7)), pa.array(kept, pa.bool_())]
        cols.append(pa.array([r[8] for r in rows], pa.list_(pa.struct([("start", long), ("end", long)]))))
        return pa.RecordBatch.from_arrays(cols, names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size += len(t or "") // 6
                if ids and size > BATCH_WORDS:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], len(t or "") // 6
                ids.append(i)
                texts.append(t)
            if ids:
                yield flush(ids, texts)

    NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)

"""Toxicity: embeddings of subwords, averaged over a text, under a linear softmax.

A word (from the first to the last letter or digit of a stretch without white space, in lower case) is a bag of
subwords: itself and its character n-grams, with marks at its ends, hashed to rows of one table.  A word's vector is
the mean of its subwords', a text's the mean of its words', and a linear softmax on top gives the score.  Table and
softmax are trained jointly in NumPy.  Words that training never saw, such as misspellings, share the n-grams of those
it saw.

Most subwords say nothing, and there are many more of them than training rows.  So rows of the table are trained for
the ``chosen`` subwords whose shares differ most between the labels, in proportion to their spread; the others stay
zero.  Texts' shares are scaled to spread one.  Each round takes a step down the full gradient of the softmax loss with
momentum, and then shortens each row by a constant, which keeps rows that don't help at zero.

As all is linear up to the softmax, a trained model keeps one number a subword: what it adds to the log-odds.

Training rows are at most ``sample`` labelled rows, those with the smallest hash of doc_id; that bound is a
parameter, and everything else covers all rows.  Ids are chosen first, so that only texts of chosen ids are read for
training; they come to the driver as counts of words.  A text is scored where it is read, and nothing is written.

Rows: null and empty texts, and those without words, get the score of a text of no words (the bias alone); texts and
words are taken whole; rows of one doc_id are scored one by one; labels that are null, or other than 0 and 1, and rows
without an id train nothing; an id with several labels trains with each; without labels of both kinds every score is
the share of label 1 (0.5 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import id_and_text, slices, text_column, tidy
from canopy.llm.quality import remainder

SAMPLE, BITS, DIM, GRAMS, CHOSEN, ROUNDS, RATE, DECAY = 10_000, 18, 8, (3, 4, 5, 6), 2_000, 300, 0.1, 0.001
MOMENTUM, THRESHOLD = 0.9, 0.5
#: Entries of texts that are spread over their subwords at a time.
ENTRIES = 200_000
#: Words that a scoring task keeps at most, and the longest that it keeps.
KEPT_WORDS, KEPT_CHARS = 300_000, 40
WORDS_AT_ONCE = 20_000

_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
_ODD = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table of each word's subwords, one word after the other, and how many each word has."""
    marked = [f"\2{w}\3" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(code)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        odd = np.uint64(_ODD)
        power = np.cumprod(np.full(int(sizes.max(initial=0)), odd, np.uint64))
        found, of = [np.add.reduceat(code * power[place], starts) if len(words) else code], [np.arange(len(words))]
        word = np.repeat(np.arange(len(words)), sizes)
        for n in GRAMS:
            at = np.flatnonzero(place + n <= sizes[word])
            value = np.full(len(at), n, np.uint64)
            for k in range(n):
                value = (value ^ code[at + k]) * odd
                value ^= value >> np.uint64(29)
            found.append(value)
            of.append(word[at])
        rows = (np.concatenate(found) * odd) >> np.uint64(64 - bits)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return rows[order].astype(np.int64), np.bincount(of, minlength=len(words))


@dataclass
class Subwords:
    """What each row of the table adds to the log-odds, and the bias."""

    values: np.ndarray
    bias: float

    def word_values(self, words: list[str]) -> list[float]:
        out: list[float] = []
        for a in range(0, len(words), WORDS_AT_ONCE):
            rows, sizes = subwords(words[a : a + WORDS_AT_ONCE], len(self.values).bit_length() - 1)
            out += (np.add.reduceat(self.values[rows], np.cumsum(sizes) - sizes) / sizes).tolist()
        return out


class Scorer:
    """Scores texts, and keeps the values of words that it has met."""

    def __init__(self, model: Subwords) -> None:
        self.model, self.kept = model, {}

    def scores(self, texts: list[str]) -> list[float]:
        lists = [words_of(t) for t in texts]
        new = list(set().union(*lists).difference(self.kept))
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept = {}
            new = list(set().union(*lists))
        self.kept.update(zip(new, self.model.word_values(new), strict=True))
        value = self.kept.__getitem__
        odds = np.array([sum(map(value, words)) / max(len(words), 1) for words in lists]) + self.model.bias
        for word in new:
            if len(word) > KEPT_CHARS:
                del self.kept[word]
        return (1 / (1 + np.exp(-odds.clip(-500, 500)))).tolist()


@dataclass
class Bags:
    """Texts as counts of words: entries (text, word, count), texts in order."""

    text: np.ndarray
    word: np.ndarray
    count: np.ndarray
    words: pa.Array

    def subwords(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, word, 1 / subwords of the word) of the words' subwords, some words at a time."""
        for a in range(0, len(self.words), WORDS_AT_ONCE):
            rows, sizes = subwords(self.words[a : a + WORDS_AT_ONCE].to_pylist(), bits)
            yield rows, np.repeat(np.arange(a, a + len(sizes)), sizes), np.repeat(1 / sizes, sizes)

    @classmethod
    def of(cls, lists: pa.ListArray, counts: pa.ListArray) -> Bags:
        """From a list of different words a text, and their counts."""
        flat = lists.flatten().dictionary_encode()
        text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        return cls(text, flat.indices.to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(float), flat.dictionary)


def train(bags: Bags, labels: np.ndarray, chosen: int = CHOSEN, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY, bits: int = BITS, dim: int = DIM) -> Subwords:
    """Fit on texts and their labels 0 and 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    values = np.zeros(1 << bits)
    if not 0 < share < 1 or not len(bags.words):
        return Subwords(values, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    portion = bags.count / np.bincount(bags.text, bags.count, len(labels))[bags.text]
    by_word = [np.bincount(bags.word, x, len(bags.words)) for x in (portion * (labels - share)[bags.text], portion**2)]
    differ, spread = np.zeros(1 << bits), np.zeros(1 << bits)
    for rows, word, part in bags.subwords(bits):
        differ += np.bincount(rows, by_word[0][word] * part, 1 << bits)
        spread += np.bincount(rows, by_word[1][word] * part**2, 1 << bits)
    best = np.argsort(-np.abs(differ) / np.sqrt(np.maximum(spread, 1e-60)), kind="stable")[:chosen]
    best = best[spread[best] > 0]
    x = _shares(bags, portion, len(labels), best, bits)
    weight = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-12)
    x *= weight
    middle = x.mean(0)
    x -= middle

    rng = np.random.default_rng(7)
    table, softmax, bias = rng.normal(0, 0.01, (len(best), dim)), rng.normal(0, dim**-0.5, (dim, 2)), np.log([1 - share, share])
    theta = [t.astype(np.float32) for t in (table, softmax, bias)]
    speed = [np.zeros_like(t) for t in theta]
    wanted = np.stack([1 - labels, labels], axis=1).astype(np.float32)
    for _ in range(rounds):
        text = x @ theta[0]
        odds = text @ theta[1] + theta[2]
        p = np.exp(odds - odds.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - wanted) / len(labels)
        for k, gradient in enumerate((x.T @ (error @ theta[1].T), text.T @ error, error.sum(0))):
            speed[k] = MOMENTUM * speed[k] + gradient
            theta[k] -= rate * speed[k]
        length = np.sqrt((theta[0] ** 2).sum(1, keepdims=True))
        theta[0] *= np.maximum(0, 1 - rate * decay / (1 - MOMENTUM) / np.maximum(length, 1e-12))
    added = theta[0] @ (theta[1][:, 1] - theta[1][:, 0])
    values[best] = added * weight
    return Subwords(values, float(theta[2][1] - theta[2][0] - middle @ added))


def _shares(bags: Bags, portion: np.ndarray, texts: int, best: np.ndarray, bits: int) -> np.ndarray:
    """(text, chosen subword): the subword's share of the text."""
    at = np.full(1 << bits, -1, np.int64)
    at[best] = np.arange(len(best))
    found = []
    for rows, word, part in bags.subwords(bits):
        inside = at[rows] >= 0
        found.append((at[rows[inside]], word[inside], part[inside]))
    col, word, part = map(np.concatenate, zip(*found, strict=True))
    starts = np.searchsorted(word, np.arange(len(bags.words) + 1))
    out = np.zeros(texts * len(best), np.float32)
    for a in range(0, len(portion), ENTRIES):
        of = bags.word[a : a + ENTRIES]
        many = starts[of + 1] - starts[of]
        pick = np.repeat(starts[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
        value = np.repeat(portion[a : a + ENTRIES], many) * part[pick]
        np.add.at(out, np.repeat(bags.text[a : a + ENTRIES], many) * len(best) + col[pick], value.astype(np.float32))
    return out.reshape(texts, len(best))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(doc_id, words, counts) of each text (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in slices(batches):
            bags = [Counter(words_of(t)) for t in some]
            columns = [pa.array(ids, pa.int64()), pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "counts"])

    return texts.mapInArrow(tidy(run), "doc_id long, words array<string>, counts array<long>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Subwords:
    """Train on the labelled rows whose remainder isn't 0, at most ``sample``; labels: (doc_id, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic in (0, 1)").filter(remainder("doc_id") != 0).distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    chosen = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(*order).limit(sample)
    read = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    found = _word_counts(read).join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("words", "counts")).limit(sample).toArrow()
    lists = [found.column(c).combine_chunks() for c in ("words", "counts")]
    return train(Bags.of(*lists), found.column("toxic").to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model trained on the labelled ones."""
    scorer = Scorer(fit(docs, labels, sample, id_col, text_col))
    score = text_column("double", scorer.scores)
    scored = id_and_text(docs, id_col, text_col).select("doc_id", score("text").alias("score"))
    held_out = F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

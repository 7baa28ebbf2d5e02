"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are counted in NumPy inside tasks.  Each feature is cut into bins by quantiles.  Training boosts in cycles: in each round every feature in turn gets a shallow tree on the bins of
that feature alone, fitted to the gradient of the logistic loss, and its leaf values are added to the feature's
lookup table.  Pairs of features whose four-cell trees explain most of what is left then get tables of their
own in the same way.  A score is the logistic of a sum of table entries, looked up by arrays of bins.

Training rows are at most ``sample`` labelled rows, those with the smallest hash of doc_id; that bound is a
parameter, and everything else covers all rows.  Ids are chosen first, so that only texts of chosen ids are read
for training.  Features come from the text alone; a text is scored where it is read, and nothing is written.

Rows: null and empty texts have features of zero and get a score like all others; texts are read whole;
rows of one doc_id are scored one by one; labels that are null, or other than 0 and 1, and rows without an id
train nothing; an id with several labels trains with each; without labels of both kinds every score is the
share of label 1 (0.5 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import bounded_batches, id_and_text, slices, text_column, tidy

SAMPLE, BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 20_000, 32, 60, 6, 30, 0.2, 4
THRESHOLD, FOLDS = 0.3, 5

FEATURES = (
    "log_words", "mean_word_chars", "symbol_share", "upper_share", "shout_share", "bar_share", "punctuation_share", "digit_share",
    "distinct_share", "repeated_line_share", "words_a_line", "top_word_share", "repeated_pair_share", "space_share", "wide_share", "longest_word",
)
_CLASSES = [re.compile(p) for p in (r"[#*$%&|<>@^~\\]", r"[A-ZÀ-ÖØ-Þ]", "!", r"\|", r"[.,;:?'\"()\[\]-]", "[0-9]", r"\s", "[^\x00-\x7f]")]


def features_of(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    symbol, upper, shout, bar, punct, digit, space, wide = (len(c.findall(text)) / chars for c in _CLASSES)
    low = [w.lower() for w in words]
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in low), np.int64, n)
    pairs = np.unique(code[:-1] * len(ids) + code[1:]).size
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log(1 + n), sum(map(len, words)) / n, symbol, upper, shout, bar, punct, digit, len(ids) / n, 1 - len(set(lines)) / len(lines),
        n / len(lines), np.bincount(code).max() / n, 1 - pairs / (n - 1) if n > 1 else 0.0, space, wide, float(max(map(len, words))),
    ]


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([features_of(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "features"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, features array<double>")


@dataclass
class Additive:
    """Bias, cuts and table of each feature, and tables of pairs."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _leaf(gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return gradient / (curve + 1.0)


def _tree(gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Leaf value for each bin of a tree of at most LEAVES leaves on sums of gradient and curvature by bin."""
    edges = [0, len(gradient)]
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(curve)))
    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in itertools.pairwise(edges):
            at = np.arange(a + 1, b)
            if len(at):
                left, right = (g[at] - g[a]) ** 2 / (h[at] - h[a] + 1), (g[b] - g[at]) ** 2 / (h[b] - h[at] + 1)
                gain = left + right - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
                k = int(gain.argmax())
                best = max(best, (gain[k], int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(gradient))
    for a, b in itertools.pairwise(edges):
        out[a:b] = _leaf(g[b] - g[a], h[b] - h[a])
    return out


def _cells(gradient: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts a table of bins once each way."""

    def quarters(x: np.ndarray) -> tuple[np.ndarray, ...]:
        s = x.cumsum(0).cumsum(1)
        low, right, down = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
        return low, right - low, down - low, s[-1, -1] - right - down + low

    g, h = quarters(gradient), quarters(curve)
    gain = sum(a**2 / (b + 1) for a, b in zip(g, h, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(gradient.shape)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = _leaf(g[k][i, j], h[k][i, j])
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit on features (rows, features) and labels 0 and 1."""
    width = len(FEATURES)
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < rate < 1:
        return Additive(np.log((rate + 1e-6) / (1 - rate + 1e-6)), [np.zeros(0)] * width, [np.zeros(1)] * width)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    model = Additive(np.log(rate / (1 - rate)), cuts, [np.zeros(len(c) + 1) for c in cuts])
    b = model.bins(x)
    total = np.full(len(y), model.bias)

    def sums(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(code, y - p, size), np.bincount(code, p * (1 - p), size)

    for _ in range(ROUNDS):
        for k in range(width):
            step = RATE * _tree(*sums(b[:, k], len(model.tables[k])))
            model.tables[k] += step
            total += step[b[:, k]]
    shape = {(i, j): (len(cuts[i]) + 1, len(cuts[j]) + 1) for i, j in itertools.combinations(range(width), 2) if len(cuts[i]) and len(cuts[j])}

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        rows, cols = shape[i, j]
        return _cells(*(s.reshape(rows, cols) for s in sums(b[:, i] * cols + b[:, j], rows * cols)))

    chosen = sorted(shape, key=lambda ij: -grid(*ij)[0])[:PAIRS]
    model.pairs = {ij: np.zeros(shape[ij]) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            step = RATE * grid(i, j)[1]
            model.pairs[i, j] += step
            total += step[b[:, i], b[:, j]]
    return model


def remainder(id_col: str):
    """crc32 of the id as text, modulo FOLDS; rows with 0 are held out."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Train on the labelled rows whose remainder isn't 0, at most ``sample``; labels: (doc_id, quality)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality in (0, 1)").filter(remainder("doc_id") != 0).distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    present = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    chosen = known.join(present, "doc_id", "left_semi").orderBy(*order).limit(sample)
    read = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = text_features(read).join(F.broadcast(chosen), "doc_id").orderBy(*order, "features").limit(sample).toArrow()
    x = np.array(rows.column("features").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    return train(x, np.array(rows.column("quality").to_pylist(), float))


def score_of(model: Additive):
    """The column function that scores a text."""
    return text_column("double", lambda texts: model.score(np.array([features_of(t) for t in texts]).reshape(len(texts), len(FEATURES))).tolist())


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model trained on the labelled ones."""
    score = score_of(fit(docs, labels, sample, id_col, text_col))
    scored = id_and_text(docs, id_col, text_col).select("doc_id", score("text").alias("score"))
    held_out = F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` at least."""
    score = score_of(fit(docs, labels, sample, id_col, text_col))
    return bounded_batches(docs).withColumn("__score", score(F.col(text_col).cast("string"))).filter(F.col("__score") >= threshold).drop("__score")

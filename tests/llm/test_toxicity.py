import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from canopy.llm import toxicity

NEUTRAL = "the river runs past green hills and small towns while people walk along its banks every quiet morning".split()
RUDE = ["blockhead", "nitwit", "dumbbell", "scoundrel"]
MISSPELT = ["blokhead", "nitwitt", "dumbbel", "scoundrell", "blockheaded", "nittwit"]


def _text(rng, words, share=0.06, n=80):
    return " ".join(rng.choice(words).upper() if rng.random() < share else rng.choice(NEUTRAL) for _ in range(n)) + f" {rng.randint(0, 99)}."


def _corpus(rng, n=600):
    rows = [(i, _text(rng, RUDE) if i % 8 == 0 else _text(rng, NEUTRAL)) for i in range(n)]
    return rows, [(i, 1, int(i % 8 == 0)) for i, _ in rows]


def _values(words, model):
    """A word's value by plain loops over its subwords; each subword's row from a call of its own."""
    bits = len(model.values).bit_length() - 1
    rows, sizes = toxicity.subwords([*words], bits)
    out, at = {}, 0
    for w, n in zip(words, sizes, strict=True):
        marked = f"<{w}>"
        assert n == 1 + sum(max(0, len(marked) - k + 1) for k in toxicity.GRAMS)
        out[w] = sum(model.values[r] for r in rows[at : at + n]) / n
        at += n
    return out


@pytest.fixture(scope="module")
def model():
    rows, labels = _corpus(random.Random(1))
    bags = [Counter(toxicity.words_of(t)) for _, t in rows]
    return toxicity.train(toxicity.Bags.of(pa.array([list(b) for b in bags]), pa.array([list(b.values()) for b in bags])), np.array([x[2] for x in labels], float))


def test_subwords_are_shared(model):
    a, b, c = (Counter(toxicity.subwords([w])[0].tolist()) for w in ("blockhead", "blokhead", "zürich"))
    assert sum((a & b).values()) >= 8 and sum((a & c).values()) <= 1
    together, sizes = toxicity.subwords(["blockhead", "x", "zürich" * 50])
    assert together[: sizes[0]].tolist() == toxicity.subwords(["blockhead"])[0].tolist() and sizes[1] == 2
    assert sorted(together[: sizes[0]]) != sorted(toxicity.subwords(["headblock"])[0])


def test_scores_are_means_over_words(model):
    scorer = toxicity.Scorer(model)
    texts = ["", " \n", "the blockhead, the river", "x" * 5000, "¡Nitwit!! it's a-b_c 1d10t", "the river " * 3000 + "nitwit"]
    for text, score in zip(texts, scorer.scores(texts), strict=True):
        words = toxicity.words_of(text)
        values = _values(sorted(set(words)), model)
        odds = model.bias + (sum(values[w] for w in words) / len(words) if words else 0)
        assert score == pytest.approx(1 / (1 + np.exp(-odds)))
    assert scorer.scores(texts) == pytest.approx(toxicity.Scorer(model).scores(texts))
    assert all(len(w) <= toxicity.KEPT_CHARS for w in scorer.kept)
    assert toxicity.words_of("¡Nitwit!! it's a-b_c 1d10t --- $$") == ["nitwit", "it's", "a-b_c", "1d10t"]


def test_words_are_forgotten_when_there_are_too_many(model, monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 50)
    texts = [" ".join(f"w{k}" for k in range(a, a + 40)) for a in range(0, 400, 20)]
    scorer = toxicity.Scorer(model)
    assert [s for t in texts for s in scorer.scores([t])] == pytest.approx(toxicity.Scorer(model).scores(texts))
    assert len(scorer.kept) <= 50


def test_unseen_misspellings_are_caught(model):
    rng = random.Random(9)
    scorer = toxicity.Scorer(model)
    bad = scorer.scores([_text(rng, MISSPELT) for _ in range(60)])
    good = scorer.scores([_text(rng, NEUTRAL) for _ in range(60)])
    assert np.mean(np.array(bad) >= 0.5) >= 0.85 and max(good) < 0.5


def test_held_out_rows_and_odd_rows(spark, docs):
    rng = random.Random(2)
    rows, labels = _corpus(rng)
    odd = [(None, _text(rng, RUDE)), (5000, None), (5001, ""), (5002, "?! "), (3, rows[8][1]), (3, rows[8][1]), (5003, "the river " * 50_000), (5004, "z" * 300_000)]
    labels += [(None, 1, 1), (7, 1, None), (9, 1, 5), (5000, 1, 0), (16, 1, 1), (999_999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs(rows + odd), table).collect()
    assert len(out) == len(rows) + len(odd)
    wanted = {i: int(i % 8 == 0) for i, _ in rows}
    held = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sorted(r.doc_id for r in out if r.held_out) == sorted(r.doc_id for r in held)
    judged = [(r.predicted, wanted[r.doc_id]) for r in held if r.doc_id in wanted and r.doc_id != 3]
    assert np.mean([a == b for a, b in judged]) >= 0.97 and sum(b for _, b in judged) > 8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    empty = {r.score for r in out if r.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1 and max(empty) < 0.5
    again = toxicity.classify(docs(rows + odd), table.withColumn("text", table.doc_id)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_held_out_labels_are_never_learnt(spark, docs):
    rows, labels = _corpus(random.Random(3), 100)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.fit(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, other))
    assert a.bias == b.bias and (a.values == b.values).all()


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, "some words here") for i in range(6)]
    assert {round(r.score, 4) for r in toxicity.classify(docs(rows), none).collect()} == {0.5}
    assert {round(r.score, 4) for r in toxicity.classify(docs(rows), one).collect()} == {0.0}
    assert toxicity.classify(docs([]), one).count() == 0

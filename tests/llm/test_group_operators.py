import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopy.llm import lines, neardup, neighbours, packing

TOKENIZER = P.path("word_bpe_49k.json")


def test_packing_places_every_token_once(spark, docs):
    rng = random.Random(3)
    texts = [None, "", "x", *(" ".join(["word"] * rng.randint(1, 3000)) for _ in range(80)), "long " * 9000, "a " * 4095, "a " * 4096]
    rows = [*enumerate(texts), (2, "x"), (None, "y")]
    out = packing.pack_documents(docs(rows), TOKENIZER).collect()
    lib = Tokenizer.from_file(TOKENIZER)
    expected = []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((str(i), piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    least = math.ceil(sum(e[3] for e in expected) / 4096)
    assert least <= len(bins) <= least + 2
    assert packing.pack_documents(docs([]), TOKENIZER).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    df = docs([(1, "one two three"), (2, "four"), (3, None)])
    packed = packing.pack_documents(df, TOKENIZER)
    made = packing.packed_sequences(df, TOKENIZER, packed).collect()
    assert len(made) == 1 and len(made[0].ids) == packed.agg({"length": "sum"}).first()[0] and made[0].ids.count(1) == 3


def test_several_blocks_and_levels(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(k, rng.choice([rng.randint(1, 60), rng.randint(40, 100)])) for k in range(2000)], "uid long, length long")
    out = packing.pack_items(items, 100, block_items=200, islands=2).join(items, "uid").collect()
    assert len(out) == 2000
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    lengths = sorted((r.length for r in out), reverse=True)
    alone = len(packing.best_fit(lengths, list(range(2000)), 100).items)  # all in one block
    assert max(fill.values()) <= 100 and len(fill) <= 1.03 * alone


def test_lengths_that_dont_fit_together_end_in_one_block(spark):
    """Whatever the block size, the last bins of all blocks are packed together."""
    rng = random.Random(6)
    lengths = [rng.choice([34, 35, 60]) for _ in range(1500)] + [1] * 7
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    counts = {}
    for block in (100, 10_000):
        out = packing.pack_items(items, 100, block_items=block, islands=2).join(items, "uid").collect()
        fill = defaultdict(int)
        for r in out:
            fill[r.sequence_id] += r.length
        assert len(out) == len(lengths) and max(fill.values()) <= 100
        counts[block] = len(fill)
    assert counts[100] <= counts[10_000] + 2


def test_crossover_keeps_every_item_once():
    rng = random.Random(0)
    lengths = sorted((rng.randint(1, 50) for _ in range(300)), reverse=True)
    a = packing.best_fit(lengths, list(range(300)), 100)
    b = packing.best_fit(lengths, rng.sample(range(300), 300), 100)
    for _ in range(20):
        child = packing.crossover(a, b, rng)
        assert sorted(i for x in child.items for i in x) == list(range(300)) and min(child.left) >= 0
        a, b = child, a


def _near_brute(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and (sets[a][0] == sets[b][0] or 100 * len(s & t) >= percent * len(s | t)):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def _family(rng, n, edits, words=120):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(7)
    texts = [None, "", " \n", "One two", "one TWO", "one", "a b c d e", *_family(rng, 40, 8), *_family(rng, 25, 3), *_family(rng, 10, 1), *(_family(rng, 0, 0)[0] for _ in range(20))]
    texts += texts[8:12] + ["Q " + texts[8]]
    rows = [*enumerate(texts)]
    rng.shuffle(rows)
    rows += [(rows[0][0], rows[0][1]), (None, texts[8]), (None, None)]
    for k, percent in ((3, 85), (5, 80)):
        out = neardup.near_duplicates(docs(rows), k, percent).collect()
        assert len(out) == len(rows)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == _near_brute(rows, k, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    assert neardup.near_duplicates(docs([])).count() == 0


def test_left_over_members_are_compared_in_blocks(spark, docs):
    rng = random.Random(11)
    kept = neardup.BLOCK_MEMBERS, neardup.BLOCK_SHINGLES
    neardup.BLOCK_MEMBERS, neardup.BLOCK_SHINGLES = 4, 500
    try:
        chain = _family(rng, 0, 0, 60)[0].split()
        texts = []
        for k in range(30):  # each like its neighbours, the ends unlike
            chain = list(chain)
            chain[(7 * k) % 60] = f"c{k}"
            texts.append(" ".join(chain))
        rows = [*enumerate(texts + _family(rng, 40, 9, 100))]
        out = neardup.near_duplicates(docs(rows), 3, 85).collect()
    finally:
        neardup.BLOCK_MEMBERS, neardup.BLOCK_SHINGLES = kept
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == _near_brute(rows, 3, 85)


def test_texts_of_one_id_are_one_document(spark, docs):
    rng = random.Random(3)
    a, b, c = (_family(rng, 2, 2) for _ in range(3))
    rows = [(5, a[0]), (5, b[0]), (2, a[1]), (7, b[1]), (9, c[0]), (9, c[0]), (9, None), (5, ""), (8, c[1])]
    rows += [(20 + k, _family(rng, 0, 0)[0]) for k in range(5)] + [(20, _family(rng, 0, 0)[0]) for _ in range(6)]
    out = neardup.near_duplicates(docs(rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == _near_brute(rows, 3, 85)
    assert {r.component_id for r in out if r.doc_id in (5, 7, 2) and r.n_shingles} == {2}


def test_a_bucket_of_many_unlike_texts(spark, docs, monkeypatch):
    """A common frame of half of each text: buckets are large, links few."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 16)
    rng = random.Random(21)
    frame = [f"f{k}" for k in range(60)]
    texts = [" ".join(frame + [f"w{rng.randint(0, 10**6)}" for _ in range(30)]) for _ in range(150)]
    texts += [t.replace("f7", "g7") for t in texts[:40:4]]
    rows = [*enumerate(texts)]
    out = neardup.near_duplicates(docs(rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == _near_brute(rows, 3, 85)


def test_size_classes_keep_every_possible_link(spark):
    """Sets whose classes differ by two or more are too unlike in size for the threshold."""
    for percent in (50, 80, 85, 100):
        ns = spark.range(1, 3000).select(F.col("id").alias("n"))
        kinds = [r.c for r in ns.select(neardup._size_class(percent).alias("c")).collect()]
        for a in range(1, 1500, 7):
            b = a * 100 // percent  # the largest size that may be linked
            assert kinds[b - 1] - kinds[a - 1] <= 1


def test_a_bucket_of_texts_of_many_sizes(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 8)
    rng = random.Random(23)
    frame = [f"f{k}" for k in range(40)]
    texts = [" ".join(frame + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([5, 20, 40, 41, 80, 160]))]) for _ in range(120)]
    texts += [t + " more" for t in texts[::3]] + [" ".join(t.split()[:-3]) for t in texts[::5]]
    rows = [*enumerate(texts)]
    out = neardup.near_duplicates(docs(rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == _near_brute(rows, 3, 85)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (neardup.signature(a, 2000) == neardup.signature(b, 2000)).mean()
    assert abs(same - 800 / 1200) < 0.05


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(205, 203), (203, 204)]
    out = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.component for r in out if r.id < 50} == {0} and {r.component for r in out if 100 <= r.id < 200} == {100} and {r.component for r in out if r.id > 200} == {203}


def _windows(text, run_words):
    rows = [(x.strip(), len(x.split())) for x in (text or "").encode().split(b"\n") if x.split()]
    for i in range(len(rows)):
        n = 0
        for j in range(i, len(rows)):
            n += rows[j][1]
            if n >= run_words:
                yield i, j, tuple(x[0] for x in rows[i : j + 1])
                break


def test_line_dedup_finds_every_repeated_window(spark, docs):
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    pool = [line(rng.choice([3, 12, 30, 70])) for _ in range(40)]
    texts = [None, "", "\n\n", "one line"]
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(len(pool))
            text += pool[a : a + rng.randint(1, 5)] if rng.random() < 0.6 else [line(rng.randint(1, 60))]
        texts.append("\n".join(text) + rng.choice(["", "\n", "\n  \n"]))
    texts.append("\n".join([pool[0] + pool[1]] * 40))
    rows = [*enumerate(texts), (None, texts[10]), (5, texts[5])]
    rng.shuffle(rows)
    out = lines.dedup_lines(docs(rows))
    assert out.columns == [*docs([]).columns, "n_deleted"]
    got = {(r.doc_id, i): (r.text, r.n_deleted) for i, r in enumerate(out.collect())}
    assert len(got) == len(rows)
    by_id = {k[0]: v for k, v in got.items()}
    seen, where = {}, {}
    for i, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        must = set()
        for a, b, key in _windows(t, lines.RUN_WORDS):
            if key in seen:
                must.update(range(a, b + 1))
            else:
                seen[key] = (i, a)
        have = [x.strip() for x in (t or "").split("\n") if x.split()]
        left = [x.strip() for x in (by_id[i][0] or "").split("\n") if x.split()]
        assert by_id[i][1] == len(have) - len(left)
        allowed = [x for k, x in enumerate(have) if k not in must]
        it = iter(allowed)
        assert all(any(x == y for y in it) for x in left), i  # what is left is a part of what may be left
        for x in have:
            where.setdefault(x, i)
        for k, x in enumerate(have):
            if where[x] == i and have.index(x) == k:
                assert x in left  # the first occurrence of a line stays
    assert by_id[0][0] is None and by_id[1][0] == ""
    assert lines.dedup_lines(docs([])).count() == 0


def test_texts_of_very_many_equal_lines(spark, docs):
    """The work is in proportion to the lines, and each line's first place stays."""
    long, short = " ".join(f"w{k}" for k in range(60)), " ".join(f"s{k}" for k in range(7))
    rows = [(1, "\n".join([long] * 100_000)), (2, "\n".join(["head", *[short] * 50_000, "tail"])), (3, "\n".join([long, short] * 20_000)), (4, "\n".join(["a", "b", "c"] * 30_000))]
    got = {r.doc_id: (r.text, r.n_deleted) for r in lines.dedup_lines(docs(rows)).collect()}
    assert got[1] == (long, 99_999)
    assert got[2] == ("head\n" + short + "\ntail", 49_999)  # a run may be matched with the line before it
    assert got[3] == (short, 39_999)  # the long line stands in the first text
    assert got[4] == ("a\nb\nc", 89_997)


def test_a_text_that_quotes_many_others(spark, docs):
    rng = random.Random(31)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    own = [[line(30), line(30), line(4)] for _ in range(300)]
    rows = [(k, "\n".join([line(20), *x, line(20)])) for k, x in enumerate(own)]
    mixed = [y for x in own for y in [*x, line(9)]]
    rows.append((1000, "\n".join(mixed)))
    got = {r.doc_id: (r.text, r.n_deleted) for r in lines.dedup_lines(docs(rows)).collect()}
    assert got[1000] == ("\n".join(mixed[3::4]), 900)
    assert all(got[k] == (t, 0) for k, t in rows[:-1])


def _neighbours_brute(rows, k):
    use = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for a, (i, v) in enumerate(use):
        if i % 50 == 0:
            s = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for b, (j, w) in enumerate(use) if b != a and len(w) == len(v)]
            out.setdefault(i, []).append([j for _, j in sorted((round(x, 12), j) for x, j in s)[:k]])
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.standard_normal(16)]) for k in range(1, 1500)]
    rows += [(2000 + k, rows[49][1]) for k in range(20)] + [(0, None), (100_000, []), (50_000, [0.0] * 16), (50_050, [float("nan")] * 16), (50_100, [None] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(v, i, "x", 1) for i, v in rows], "embedding array<float>, vec_id long, node string, rank int")
    out = neighbours.nearest_neighbours(df, "vec_id % 50 = 0").collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r)
    want = _neighbours_brute(rows, 5)
    assert set(found) == set(want)
    hits = [len({r.vec_id for r in found[q]} & set(want[q][0])) for q in want]
    assert sum(hits) >= 0.95 * 5 * len(hits)
    assert [r.vec_id for r in found[50]] == [2000 + k for k in range(5)]  # equal vectors: the smallest ids
    for q, rs in found.items():
        assert [r.rank for r in rs] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in rs]
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(rs, rs[1:], strict=False))
    few = neighbours.nearest_neighbours(df.filter("vec_id in (50, 51, 100)"), "vec_id % 50 = 0").collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(50, 51), (50, 100), (100, 50), (100, 51)]
    assert neighbours.nearest_neighbours(df.limit(0), "vec_id % 50 = 0").count() == 0


def _recall(out, vectors, k=5):
    """Share of the true nearest that were found, ties counted as found."""
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    at, found = {i: n for n, i in enumerate(ids)}, defaultdict(list)
    for r in out:
        found[r.query_id].append(r.score)
    hits = total = 0
    for i in ids:
        if i % 50 == 0:
            sims = m @ m[at[i]]
            sims[at[i]] = -2
            bar = np.sort(sims)[-k]
            total += k
            hits += sum(x >= bar - 1e-9 for x in found[i])
    return hits / total


def test_recall_over_plain_and_clustered_vectors_with_hubs(spark):
    rng = np.random.default_rng(17)
    plain = rng.standard_normal((3000, 24))
    centres = rng.standard_normal((25, 24))
    clustered = centres[rng.integers(0, 25, 2000)] + 0.05 * rng.standard_normal((2000, 24))
    hubs = np.concatenate([plain.mean(axis=0, keepdims=True) + 1e-3 * rng.standard_normal((50, 24)), centres + 1e-3])
    vectors = dict(enumerate(np.concatenate([plain, clustered, hubs]).tolist()))
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    out = neighbours.nearest_neighbours(df, "vec_id % 50 = 0").collect()
    assert len(out) == 5 * sum(i % 50 == 0 for i in vectors) and _recall(out, vectors) >= 0.9


def test_doubles_beyond_floats_keep_their_precision(spark):
    rows = [(0, [1e300, 1e300]), (1, [1.0, 1.0 + 1e-6]), (2, [1.0, 1.0 + 3e-6]), (3, [1e-300, -1e-300]), (4, [1.0, 2.0])]
    out = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank)] == [1, 2, 4, 3] and all(abs(r.score) <= 1 + 1e-12 for r in out)


def test_near_duplicates_of_very_long_texts(spark, docs):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400_000))
    rows = [(1, long), (2, long + " more words here"), (3, "a " * 500_000), (4, "a a a a"), (5, "x" * 2_000_000)]
    out = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.near_duplicates(docs(rows), 3, 85).collect()}
    assert [out[k][0] for k in range(1, 6)] == [1, 1, 3, 3, 5] and out[3][1] == out[4][1] == out[5][1] == 1 and out[2][1] - out[1][1] == 3

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from canopy.llm import merkle, queries, spelling
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    ours = compare.spark_rows(queries.queries()[name](spark, SF))
    assert compare.difference(ours, compare.duck_rows(compare.duck(SF), queries.oracle_sql()[name])) == ""


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _manifest_brute(rows, fanout):
    by = defaultdict(list)
    for i, s, lang, n, t in rows:
        head = [_field(x) for x in (i, s, lang, n)]
        leaf = _h(*head, _field(t))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by[s].append((i is not None, i or 0, leaf, _h(*head, _field(None if t is None else _lower(t))) if hit else leaf, i))

    def up(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([_h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
        return levels

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by[s])]) for s in sources}
    top = up([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for j, x in enumerate(sorted(by[s])):
            proof, fold = [], x[3]
            for levels, at in ((trees[s], j), (top, k)):
                for level in levels[:-1]:
                    a = at // fanout * fanout
                    run = level[a : a + fanout]
                    left, right = run[: at - a], run[at - a + 1 :]
                    proof += left + right
                    fold = _h(*left, fold, *right)
                    at //= fanout
            out.append((x[4], x[2], trees[s][-1][0], top[-1][0], _h(*proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


MANIFEST_ROWS = [
    (None, "a", "x", 1, "T"), (1, None, None, None, None), (1, None, None, None, None), (1, None, None, None, ""), (5, "b", "x", 3, "ÄBc"), (7, "", "l", 1, "Q"),
    *((i, "hot", "l", i, f"Text {i}") for i in range(300)), *((7, f"s{i}", "l", 1, "Q") for i in range(20)), (9, "long", "l", 1, "Word é " * 200_000),
]


@pytest.mark.parametrize(("rows", "fanout"), [(MANIFEST_ROWS, 16), (MANIFEST_ROWS, 3), (MANIFEST_ROWS[:1], 16), (MANIFEST_ROWS[8:24], 16), (MANIFEST_ROWS[8:25], 16), ([], 16)])
def test_manifest_equals_brute_force(spark, rows, fanout):
    df = spark.createDataFrame([(*r, 1, "g", 2, "h") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx int, grp string, size int, hash string")
    out = merkle.manifest(df, fanout).collect()
    assert sorted((tuple(r) for r in out), key=str) == _manifest_brute(rows, fanout)
    assert all(r.verified or zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)


def test_numbers_go_on_over_parts(spark):
    rows = [(k % 3 // 2, (k * 7919) % 1000, k) for k in range(1000)]
    out = merkle.numbered(spark.createDataFrame(rows, "grp int, x int, hash int"), ["x", "hash"], "t").collect()
    for g in (0, 1):
        mine = sorted((x, h) for grp, x, h in rows if grp == g)
        assert [(r.x, r["hash"]) for r in sorted((r for r in out if r.grp == g), key=lambda r: r.idx)] == mine
        assert {r.size for r in out if r.grp == g} == {len(mine)} and sorted(r.idx for r in out if r.grp == g) == list(range(len(mine)))


def _spelling_brute(rows, delete_one_in=199):
    counts = Counter()
    for i, t in rows:
        for run in map(_lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % delete_one_in == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(b) - len(a) != 1:
            return False
        p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))  # the letter more stands where they first differ
        return b[:p] + b[p + 1 :] == a

    near = {w: [o for o in words if o != w and one_edit(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def test_spelling_equals_brute_force(spark, docs):
    rng = random.Random(5)
    base = ["analysis", "schützen", "aaaaaa", "letters", "señoras", "stressed", "Éclair"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 150, 900])
        for _ in range(40):  # an edit, or two, or an anagram
            v = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                p = rng.randrange(len(v))
                v[p : p + rng.choice([0, 1])] = rng.choice(["", "a", "é", "s", "ss"])
            words += ["".join(v)] * rng.choice([1, 5, 6, 24, 25, 30, 130])
        words += ["".join(rng.sample(w, len(w)))] * 5
    rng.shuffle(words)
    rows = [(k // 3, " ".join(words[k::200])) for k in range(200)]
    rows += [(None, "analysis, ANALYSIS;analysis9analysisİanalysis"), (1, None), (2, ""), (3, "x÷letters× letters " * 3), (4, "longword" * 20_000 + " " + "analysis " * 20_000), (4, "longword" * 20_000)]
    rows += [(k, "longword" * 20_000 + "x" * (k % 2)) for k in range(10, 20)]
    for one_in in (199, 3):
        out = spelling.spelling_variants(docs(rows), delete_one_in=one_in).collect()
        expected = _spelling_brute(rows, one_in)
        assert sorted(map(tuple, out)) == expected and sum(r[1] is not None for r in expected) > 20
    assert spelling.spelling_variants(docs([])).count() == 0


def test_long_words_are_compared_as_short_ones(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(250)}
    table = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    found = []
    for limit in (500, 0):
        monkeypatch.setattr(spelling, "LONG", limit)
        found.append(sorted((r.word, r.other) for r in spelling.near_words(table).collect()))
    assert found[0] == found[1] and len(found[0]) == len(set(found[0])) > 200


def test_forms_are_followed_to_the_last(spark):
    steps = [("w0", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "w4"), ("w4", "w5"), ("v", "w4"), ("a", "b")]
    out = dict(map(tuple, spelling._roots(spark.createDataFrame(steps, "word string, form string")).collect()))
    assert out == {"w0": "w5", "w1": "w5", "w2": "w5", "w3": "w5", "w4": "w5", "v": "w5", "a": "b"}


def test_anagrams_of_other_order_do_not_meet(spark):
    """Words of the same syllables in any order have one key, but only those of an equal half are joined."""
    import itertools

    syllables = ["an", "ber", "chi", "do", "el", "fu"]
    words = ["".join(p) for p in itertools.permutations(syllables)]
    keys = spelling._keys(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    assert keys.filter("whole").select("key").distinct().count() == 1
    assert keys.groupBy("key", "half").count().agg({"count": "max"}).first()[0] <= 24  # of 720

import hashlib
import html
import html.parser
import itertools
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from canopy.llm import licenses, pages, pieces, quality, repeats, tokenfiles
from canopy.llm.words import WordEncoder

ODD = [None, "", " ", "\n", "a", "a  b", " a", "a \n b\n\nc\n", "don't ÀÉ ﬁ ① １２3 x y  z <|endoftext|>q", "日本 😀 ok", "x\x01 \x01y", "▁ a▁b", "!!!! --- aaaaaaaaaa", "ΑΣ Σ İ ǅ", "é é"]


def test_pieces_equal_the_library_and_cover_the_text(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id"), (99, "long " * 30_000)]
    out = pieces.encode_pieces(docs(rows), path).collect()
    assert len(out) == len(rows)
    texts = {(i, t or "") for i, t in rows}
    for r in out:
        mine = [t for i, t in texts if i == r.doc_id]
        assert r.ids in [lib.encode(t, add_bos=True, add_eos=True) for t in mine]
        t = next(t for t in mine if lib.encode(t, add_bos=True, add_eos=True) == r.ids)
        assert r.begins[0] == 0 and r.ends[-1] == len(t.encode()) and r.begins == sorted(r.begins)
        assert sum(e - b for b, e in zip(r.begins, r.ends, strict=True)) == len(t.encode())
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.piece_digests(docs(rows), path).collect()}
    for i, t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(lib.decode(ids).encode())) in digests
    assert pieces.piece_digests(docs([]), path).count() == 0


def test_character_map_takes_the_longest_prefix():
    # a double array by hand: keys "a" -> "x", "ab" -> "yz"
    units = [0] * 512
    units[0] = 1 << 10  # root: children at 1 ^ byte
    a = 1 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | ((a ^ 256) << 10)
    units[256] = 0x80000000 | 0
    b = 256 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | ((b ^ 300) << 10)
    units[300] = 0x80000000 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    found = pieces.CharacterMap(blob)
    assert found.longest(b"abc", 0) == (2, b"yz") and found.longest(b"ac", 0) == (1, b"x") and found.longest(b"cab", 0) is None
    model = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    model.characters = found
    normal, align = model.normalise("ab c")
    assert normal == "▁yz▁c".encode() and align.tolist() == [0, 0, 0, 0, 0, 2, 2, 2, 3, 4]


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordEncoder(path)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcdé'ts.12 \n\t") for _ in range(300)) for _ in range(50)] + ["hahahahaha" * 50]
    for t, b in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def _brute_repeats(text, least):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    seen = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    five = {j for i in range(n - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    inside = {j for i in range(n) if best[i] >= least for j in range(i, i + best[i])}
    return n, len(five), len(inside) / n if n else 0.0, max(best, default=0)


def test_repetition_rules_equal_brute_force(spark, docs):
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in range(30)), "same words here again and so on it goes for ever more " * 4]
    out = {r.doc_id: r for r in repeats.repetition_rules(docs([*enumerate(texts)]), min_repeat=3).collect()}
    for i, t in enumerate(texts):
        n, five, covered, longest = _brute_repeats(t, 3)
        r = out[i]
        assert (r.n_words, r.n_repeat_words, r.longest_repeat) == (n, five, longest) and abs(r.covered_fraction - covered) < 1e-12
        t = t or ""
        assert r.word_chars == sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t))) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_dup_lines == sum(x in lines[:k] for k, x in enumerate(lines))
        assert r.base_failed == (n < 10 or 100 * five > 20 * n)
        assert r.kept == (not r.base_failed and covered <= repeats.MAX_COVERED and longest <= repeats.MAX_LONGEST)
        assert abs(sum(s.end - s.start for s in r.spans) - covered * n) < 1e-9
    assert repeats.repetition_rules(docs([])).count() == 0
    assert repeats.repetition_rules(docs([(1, "a b"), (1, "a b"), (None, None)])).count() == 3


def _brute_maximal(words, least):
    """Repeated substrings that can't be extended without losing a place."""
    out = set()
    for size in range(least, len(words)):
        places = defaultdict(list)
        for i in range(len(words) - size + 1):
            places[tuple(words[i : i + size])].append(i)
        for x, at in places.items():
            if len(at) > 1 and len({words[i - 1] if i else None for i in at}) > 1 and len({words[i + size] if i + size < len(words) else None for i in at}) > 1:
                out.add(x)
    return out


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab" if k % 2 else "abcd") for _ in range(rng.randint(0, 60))) for k in range(120)] + ["a " * 40, "a b " * 25, ""]
    for least in (1, 2, 4):
        for text, r in zip(texts, repeats.measure(texts, least), strict=True):
            w = text.split()
            found = _brute_maximal(w, least)
            places = [(i, i + len(x)) for x in found for i in range(len(w)) if tuple(w[i : i + len(x)]) == x]
            assert r[7] == len(found) and r[6] == _brute_repeats(text, least)[3]
            assert {i for s in r[8] for i in range(s["start"], s["end"])} == {i for a, b in places for i in range(a, b)}


def test_long_texts_that_repeat_themselves_need_bounded_memory(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1000)
    n = 300_000
    half = [f"w{k % 40_000}" for k in range(n // 2)]
    tracemalloc.start()
    size, _, _, _, windows, covered, longest, _, spans = repeats.measure([" ".join(half + half)], 8)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (size, windows, covered, spans) == (n, n, 1.0, [{"start": 0, "end": n}]) and longest == n // 2
    assert peak < 150 * n


def test_license_scan(spark, docs):
    texts = [
        None, "", "Licensed under the MIT License. and under the mit license", "APACHE license; version 2.0!", "CC BY-NC 4.0", "under the mit", "über the MIT license é",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the apache license", "x " * 50_000 + "under the mit license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the Acme Institute nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]
    out = {r.doc_id: r for r in licenses.license_scan(docs([*enumerate(texts), (2, texts[2])])).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = pattern.findall(low)
        at = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE_PHRASES.items()}
        places = [k for v in at.values() for k in v]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(k for k, v in at.items() if v)) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert out[7].labels == "gpl-3" and out[10].labels == "bsd-3" and out[5].labels == "" and out[8].labels == "apache"
    assert licenses.license_scan(docs([])).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the Apache License, Version 1.1", "apache-1.1"),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"),
        ("Creative Commons Attribution-NonCommercial License", "cc-by-nc"),
        ("Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        ("Creative Commons Attribution-Non-Commercial-ShareAlike 3.0 Unported License", "cc-by-nc-sa"),
        ("Creative Commons Attribution 4.0 International License", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("licensed under CC BY-NC-ND 4.0", "cc-by-nc,cc-by-nc-nd"),  # the base label stays
        ("SPDX-License-Identifier: MIT-0", "mit-0"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
        ("under the terms of the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
        ("the GNU Affero General Public License, version 3", "agpl-3"),
        ("Released under the MIT License.", "mit"),
        ("Mozilla Public License, v. 2.0", "mpl-2"),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", ""),
        ("SPDX-License-Identifier: BSD-3-Clause-No-Nuclear-License", "bsd-3"),  # "no" may begin a sentence
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2,mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later OR BSD-2-Clause AND (ISC OR MIT-0)", "bsd-2,gpl-2,isc,mit-0"),
        ("SPDX-License-Identifier: MIT OR BSD-3-Clause-Clear", "mit"),
        ("GNU General Public License version 2.1", ""),
        ("GNU General Public License v3", "gpl-3"),
        ("GNU General Public License, v2.0 or later", "gpl-2"),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("licensed under the Apache License, Version 2.1", "apache,apache-2"),  # the base phrase stands there
        ("MPL v2.0", "mpl-2"),
        ("MPL 2.1", ""),
        ("Creative Commons Zero v1.0 Universal", "cc0"),
        ("CC BY-SA 4.0", "cc-by-sa"),
        ("CC BY 4.0", "cc-by"),
        ("cc by sa", ""),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("dual licensed under the MIT license or the Apache License, Version 2.0", "apache-2,mit"),
        ("the license of the apache is under the tree, version 2 of mit", ""),
        ("gnu general public license", ""),
    ],
)
def test_license_labels(text, labels):
    base = [(p.encode().split(), label) for p, label in licenses.BASE_PHRASES.items()]
    automata = [licenses.Automaton(label, t) for label, t in licenses.TEMPLATES]
    found = licenses.scan_text(text, base, automata)
    assert found[5] == labels and 0 <= found[6] <= 1
    assert licenses.scan_text(f"Some words before. {text} \n And some after it.", base, automata)[5] == labels


def _accepted(marks):
    """All word strings that a template accepts; replaceable regions over the letters a to c."""
    out, k = {()}, 0
    while k < len(marks):
        if marks[k] == "[[":
            depth, e = 1, k
            while depth:
                e += 1
                depth += (marks[e] == "[[") - (marks[e] == "]]")
            part, k = _accepted(marks[k + 1 : e]) | {()}, e
        elif marks[k] == "((":
            e = marks.index("))", k)
            bars = [k, *(i for i in range(k, e) if marks[i] == "|"), e]
            part, k = set().union(*(_accepted(marks[a + 1 : b]) for a, b in itertools.pairwise(bars))), e
        elif marks[k].startswith("{{"):
            part = {t for n in range(int(marks[k][2:-2]) + 1) for t in itertools.product("abc", repeat=n)}
        else:
            part = {(marks[k],)}
        out = {x + y for x in out for y in part}
        k += 1
    return out


def test_automata_equal_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        marks = [rng.choice("abc")]
        for _ in range(rng.randint(0, 3)):
            kind = rng.random()
            marks += ["[[", *(rng.choice("abc") for _ in range(rng.randint(1, 2))), *(["[[", "b", "]]"] if kind < 0.1 else []), "]]"] if kind < 0.4 else ["{{%d}}" % rng.randint(1, 2)] if kind < 0.6 else ["((", "a", "b", "|", rng.choice("abc"), "|", "[[", "c", "]]", "a", "))"] if kind < 0.75 else [rng.choice("abc")]
        accepted = _accepted(marks) - {()}
        automaton = licenses.Automaton("x", " ".join(marks))
        for _ in range(5):
            text = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
            want, i = [], 0
            while i < len(text):
                end = max((e for e in range(i + 1, len(text) + 1) if tuple(text[i:e]) in accepted), default=0)
                if end:
                    want.append((i, end))
                i = end or i + 1
            words = [w.encode() for w in text]
            assert automaton.find(words, set(words)) == want, (marks, text)


def test_automaton_optional_and_replaceable_regions():
    a = licenses.Automaton("x", "one [[two]] {{2}} three")
    ok = lambda s: bool(a.find(s.encode().split(), set(s.encode().split())))
    assert ok("one three") and ok("one two three") and ok("one a b three") and ok("zero one two a b three four")
    assert not ok("one a b c d three") and not ok("one two") and not ok("two three")


def test_automaton_guards():
    a = licenses.Automaton("x", "version ((2 0|2!)) [[only]]")
    b = licenses.Automaton("x", "id one clause!!")
    ok = lambda x, s: bool(x.find(s.encode().split(), set(s.encode().split())))
    assert ok(a, "version 2") and ok(a, "version 2 0 7") and ok(a, "version 2 2005") and ok(a, "version 2 only 1")
    assert not ok(a, "version 2 1") and not ok(a, "version 2 13")
    assert ok(b, "id one clause") and ok(b, "id one clause this file") and not ok(b, "id one clause clear") and not ok(b, "id one clause 2")


def test_token_files_round_trip(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tokenfiles.byte_encoder(path, P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id")]
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in tokenfiles.count_tokens(docs(rows), path, P.PATTERN, 50256).collect())
    assert out == sorted((i if i is not None else -1, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert tokenfiles.count_tokens(docs([]), path, P.PATTERN, 50256).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_token_scan_stitches_blocks(spark, tmp_path, block):
    files = {"a.bin": [5, 6, 9, 9, 7, 7, 7, 7, 7, 9, 1], "b.bin": [9], "c.bin": [1, 2], "d.bin": [1, 2, 9]}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    (tmp_path / "e.bin").touch()
    found = tokenfiles.token_files(spark, f"file://{tmp_path}")
    out = sorted((r.file.rpartition("/")[2], r.ordinal, r.start, r.n_tokens) for r in tokenfiles.scan_token_files(found, 9, block_tokens=block).collect())
    assert out == [("a.bin", 0, 0, 2), ("a.bin", 1, 3, 0), ("a.bin", 2, 4, 5), ("a.bin", 3, 10, 1), ("b.bin", 0, 0, 0), ("c.bin", 0, 0, 2), ("d.bin", 0, 0, 2)]


def test_token_scan_of_many_short_documents(spark, tmp_path):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 3, 100_000)
    ids = np.full(int(sizes.sum()) + len(sizes), 5, "<u2")
    ends = np.cumsum(sizes + 1) - 1
    ids[ends] = 9
    for k in range(3):
        ids.tofile(tmp_path / f"{k}.bin")
    np.full(2_000_000, 9, "<u2").tofile(tmp_path / "empty.bin")  # a whole block of empty documents
    found = tokenfiles.token_files(spark, f"file://{tmp_path}")
    scanned = tokenfiles.scan_token_files(found, 9, block_tokens=2_000_000).cache()
    per = {r.file.rpartition("/")[2]: r for r in scanned.groupBy("file").agg({"*": "count", "n_tokens": "sum"}).collect()}
    assert per["empty.bin"]["count(1)"] == 2_000_000 and per["empty.bin"]["sum(n_tokens)"] == 0
    for k in range(3):
        rows = scanned.filter(f"file like '%/{k}.bin'").orderBy("ordinal").toArrow()
        assert rows.column("n_tokens").to_numpy().tolist() == sizes.tolist() and rows.column("start").to_numpy().tolist() == (ends - sizes).tolist()
    scanned.unpersist()


def test_token_files_of_one_task_are_several(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_TOKENS", 50)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tokenfiles.byte_encoder(path, P.PATTERN)
    rows = [(k, "word " * (k % 40)) for k in range(60)] + [(100, "long text " * 60_000)]
    out = sorted((r.doc_id, r.n_tokens) for r in tokenfiles.count_tokens(docs(rows), path, P.PATTERN, 50256).collect())
    assert out == sorted((i, len(enc.encode_ordinary(t))) for i, t in rows)


def test_pages(spark):
    nav = "<nav><ul><li>Home<li>News</ul></nav>"
    promo = '<div class="x7"><p>Everything must go</p></div>'
    html = lambda k, inner: f"<html><head><title>T</title><script>var a='</p>';</script></head><body>{nav}{promo}{inner}<footer>f {k}</footer></body></html>"
    rows = [(k, f"https://Host.example/{k}", html(k, f"<div><h1>Title &amp; {k}</h1><p>One <b>bold</b>word{k}\n two<p>Three{k}<br>four</div>")) for k in range(6)]
    rows += [(7, "http://other/", html(7, "<article><p>Alone</p><div class='comments'><p>nice</p></div></article>")), (8, None, None), (9, "", ""), (9, "", "plain &lt; text"), (None, "u", "<p>open <i>end")]
    df = spark.createDataFrame([(u, i, h, "x", 1) for i, u, h in rows], "url string, page_id long, html string, host string, hash int")
    out = pages.extract_text(df).collect()
    texts = {}
    for r in out:
        assert r.n_chars == len(r.text)
        texts.setdefault(r.page_id, []).append(r.text)
    assert texts[0] == ["Title & 0 One boldword0 two Three0 four"] and texts[7] == ["Alone"] and texts[8] == [""] and sorted(texts[9]) == ["", "plain < text"] and texts[None] == ["open end"]
    assert pages.extract_text(df.limit(0)).count() == 0
    kept, pages.BROADCAST_ROWS = pages.BROADCAST_ROWS, 0
    try:
        again = pages.extract_text(df).collect()
    finally:
        pages.BROADCAST_ROWS = kept
    key = lambda r: (str(r.page_id), str(r.url), r.text, r.n_chars)
    assert sorted(map(key, again)) == sorted(map(key, out))


def _texts(spark, rows):
    """Texts with both ways to know the templates."""
    df, found, kept = spark.createDataFrame(rows, "page_id long, url string, html string"), [], pages.BROADCAST_ROWS
    try:
        for pages.BROADCAST_ROWS in (kept, 0):
            found.append({r.page_id: r.text for r in pages.extract_text(df).collect()})
    finally:
        pages.BROADCAST_ROWS = kept
    assert found[0] == found[1]
    return found[0]


SHARED = "<table class='t'><tr><td>a<td>b</table><div><p>Shared passage</p></div><ul><li>one<li>two</ul>"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>", "<div>{}</div>"])
def test_what_few_pages_of_a_host_share_stays(spark, around):
    rows = [(k, f"http://h/{k}", f"<body><div>top</div>{around.format(f'<p>Own {k}</p>' + (SHARED if k < 6 else f'<p>More {k}</p>'))}</body>") for k in range(1000)]
    out = _texts(spark, rows)
    assert all(out[k] == f"Own {k} " + ("a b Shared passage one two" if k < 6 else f"More {k}") for k in range(1000))


def test_what_most_articles_of_a_host_share_goes_but_for_passages(spark):
    box = "<div><p>Read more on our site</p></div>"
    rows = [(k, f"http://h/{k}", f"<body><article><p>Own {k}</p><p>Said by all</p>{box}<p>End {k}</p></article></body>") for k in range(12)]
    near = "".join(f"<p>Paragraph {i}</p>" for i in range(12)) + "<table><tr><td>x<td>y</table>"
    rows += [(100 + k, "http://near/", f"<body><article>{near}<p>Edit {k}</p></article></body>") for k in range(6)]
    out = _texts(spark, rows)
    assert all(out[k] == f"Own {k} Said by all End {k}" for k in range(12))
    assert all(out[100 + k].endswith(f"x y Edit {k}") for k in range(6))  # near copies of one article


def test_names_of_elements(spark):
    content = "".join(f"<div {x}>{n}</div>" for n, x in enumerate(('class="notice-period"', 'class="related-work"', 'id="foot"', 'class="share"', 'class="comment-on-law"')))
    boxes = '<div class="ad">buy</div><section id="comments"><p>nice</p></section><div class="x newsletter">join</div><aside>a</aside><form>f</form>'
    plain = '<div class="menu-guide"><p>how to cook</p></div><div class="alert-system">rings</div><div id="share-prices">fell</div><div class="menu">Home</div><div id="Sidebar">News</div>'
    rows = [
        (1, "http://h/1", f"<body><div class='notice-period'>out</div><article><p>Text</p>{content}{boxes}</article></body>"),
        (2, "http://h/2", f"<body><p>Text</p>{content}{boxes}</body>"),
        (3, "http://h/3", f"<body>{plain}</body>"),
        (4, "http://h/4", "<b>&</b>amp; x &amp;amp; &lt;p&gt; a&nbsp;&#8194;b"),
    ]
    assert _texts(spark, rows) == {1: "Text 0 1 2 3 4", 2: "Text 0 1 2 3 4", 3: "how to cook rings fell", 4: "&amp; x &amp; <p> a b"}


BROKEN = [
    ("<div>" * 300_000 + "x</span>" * 200_000, "x" * 200_000),
    ("<article>" * 200_000, ""),
    ("<b>" * 100_000 + "<p>x</p>" * 200_000, " ".join("x" * 200_000)),
    ("<a " * 1_000_000 + '"', ""),
    ("ok<a b=" * 300_000 + '"', "ok"),
    ("<p " + "a" * 3_000_000 + ">x", "x"),
    ("<div><article>" + "<i>" * 100_000 + "</div>" * 300_000 + "end", "end"),
    ("<" * 2_000_000, "<" * 2_000_000),
    ("<p>one<p>two" + " &amp; three" * 300_000, "one two" + " & three" * 300_000),
]


@pytest.mark.parametrize("k", range(len(BROKEN)))
def test_broken_pages_of_megabytes_are_read_in_linear_time(spark, k):
    html, text = BROKEN[k]
    began = time.process_time()
    nodes = pages.parse(html)
    mains, gone = pages.main_nodes(nodes)
    pages.hashes_by_kind(nodes, mains)
    assert pages.text_of(mains, gone) == text
    assert time.process_time() - began < 20


def test_long_pages_in_spark(spark):
    rows = [(k, f"http://h/{k}", html) for k, (html, _) in enumerate(BROKEN[:3])]
    assert {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {k: t for k, (_, t) in enumerate(BROKEN[:3])}


class _Tree(html.parser.HTMLParser):
    """A tree of well-formed markup by the standard library: [tag, classes and id, children]."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.open = [["", "", []]]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, tuple(sorted(dict(attrs).items())), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _brute_extraction(rows, marked):
    """Texts by the stated rules, over trees of another parser, with subtrees compared as they are."""
    containers, prose = {"div", "ul", "section"}, {"p", "h1"}

    def main_of(node):
        for tag in ("article", "main", "body"):
            queue = [node]
            while queue:
                x = queue.pop(0)
                if isinstance(x, list):
                    if x[0] == tag:
                        return x
                    queue += x[2]
        return None

    def walk(node, inside, main, drop, visit):
        inside = inside or node[0] in ("article", "main")
        for x in node[2]:
            if isinstance(x, list) and not drop(x, inside):
                visit(x, inside)
                walk(x, inside, main, drop, visit)

    def own(x, inside):
        return x[0] in ("nav", "footer") or any(n in marked[inside] for _, v in x[1] for n in v.split())

    def text(main, drop):
        out = []

        def go(x, inside):
            inside = inside or x[0] in ("article", "main")
            for c in x[2]:
                if isinstance(c, str):
                    out.append(c)
                elif not drop(c, inside):
                    block = c[0] not in ("b", "i")
                    out.append(" " * block)
                    go(c, inside)
                    out.append(" " * block)

        go(main, False)
        return " ".join("".join(out).split())

    trees = {k: (url.split("/")[2], _Tree(page).open[0]) for k, url, page in rows}
    found, sizes = defaultdict(set), defaultdict(set)
    for host, tree in trees.values():
        main = main_of(tree)
        page = text(main, own)
        passages = []
        walk(main, False, main, lambda x, inside: False, lambda x, inside: passages.append(pages.parse(_markup(x))[1].hash) if x[0] in prose | {"li"} else None)
        passage = min(passages, default=None)
        sizes[host, "page"].add(page)
        sizes[host, "passage"].add(passage)

        def holds(x, main=main):
            return x is main or any(isinstance(c, list) and holds(c) for c in x[2])

        def count(x, inside, host=host, page=page, passage=passage):
            if not holds(x):
                if x[0] in containers:
                    found[host, "inside" if inside else "container", repr(x)].add(passage if inside else page)
                elif x[0] in prose and not inside:
                    found[host, "prose", repr(x)].add(page)

        walk(tree, False, main, lambda x, inside: False, count)
    shares = {"container": (pages.SHARE, "page"), "prose": (pages.PROSE_SHARE, "page"), "inside": (pages.PROSE_SHARE, "passage")}
    template = {k for k, on in found.items() if len(on) >= max(pages.MIN_PAGES, shares[k[1]][0] * len(sizes[k[0], shares[k[1]][1]]))}
    out = {}
    for k, (host, tree) in trees.items():

        def gone(x, inside, host=host):
            kind = ("inside" if inside else "container") if x[0] in containers else "prose" if x[0] in prose and not inside else ""
            return own(x, inside) or (host, kind, repr(x)) in template

        out[k] = text(main_of(tree), gone)
    return out


def _markup(x):
    return x if isinstance(x, str) else f"<{x[0]}{''.join(f' {k}={v!r}' for k, v in x[1])}>" + "".join(map(_markup, x[2])) + f"</{x[0]}>"


def test_random_pages_equal_brute_force(spark):
    rng = random.Random(12)
    parts = [f"<p>Passage {k}</p>" for k in range(6)] + [f"<div class='box'><p>Box <b>{k}</b></p></div>" for k in range(6)] + [f"<ul><li>Item {k}</li><li>x</li></ul>" for k in range(4)]
    parts += ["<div class='ad'>buy</div>", "<div id='menu'><p>M</p></div>", "<div class='menu-card'>Soup</div>", "<nav><a>n</a></nav>"] + [f"<p>Word {k}</p>" for k in range(200)]
    pick = lambda n: "".join(rng.choice(parts[: rng.choice([4, 16, 20, len(parts)])]) for _ in range(n))
    rows = []
    for k in range(400):
        main = pick(rng.randint(1, 5))
        wrapped = rng.choice([f"<article>{main}</article>", f"<main>{main}</main>", main, f"<div>{main}</div>"])
        rows.append((k, f"http://host{rng.choice([0, 0, 0, 1, 2, 3])}/{k}", f"<html><body>{pick(2)}{wrapped}{pick(1)}<footer>f</footer></body></html>"))
    expected = _brute_extraction(rows, {False: {"ad", "menu"}, True: {"ad"}})
    assert _texts(spark, rows) == expected
    whole = {k: " ".join(re.sub("<[^b/][^>]*>|</[^b][^>]*>", " ", re.sub("</?b>", "", page)).split()) for k, _, page in rows}
    assert sum(len(expected[k]) < len(whole[k]) for k in whole) > 200


@pytest.mark.parametrize("limit", [0, pages.BROADCAST_ROWS])
def test_templates_delete_only_what_is_counted(spark, monkeypatch, limit):
    monkeypatch.setattr(pages, "BROADCAST_ROWS", limit)
    again = "<p>Said twice</p><div><p>Boxed</p></div>"
    rows = [(k, f"http://h/{k}", f"<body><h1>Page {k}</h1>{again}</body>") for k in range(8)]
    rows.append((8, "http://h/8", f"<body><article>Own {again}</article></body>"))
    out = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {**{k: f"Page {k}" for k in range(8)}, 8: "Own Said twice Boxed"}


def test_quality_classifier_learns_and_leaves_out_folds(spark, docs):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    bad = lambda: " ".join(w + rng.choice(["***", "!!", "%%%"]) for w in good().split())
    rows = [(k, good() if k % 3 else bad()) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)] + [(1, None, 0), (None, 1, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs([*rows, (1000, None), (1001, ""), (1001, "")]), labels).collect()}
    assert len(out) == 302
    assert np.mean([out[k].predicted == int(k % 3 > 0) for k in range(300)]) > 0.95
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= out[k].score <= 1 for k in out)
    none = quality.classify(docs(rows[:5]), labels.limit(0)).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in none)
    assert quality.classify(docs([]), labels).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :3] = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == (y == 1)).mean() > 0.97


def _plain_features(text):
    """The classifier's features by plain counting."""
    words = text.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    share = lambda keep: sum(map(keep, text)) / len(text)
    low = [w.lower() for w in words]
    pairs = list(zip(low, low[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    found = {
        "log_words": np.log(1 + len(words)), "mean_word_chars": sum(len(w) for w in words) / len(words), "symbol_share": share(lambda c: c in "#*$%&|<>@^~\\"),
        "upper_share": share(lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"), "shout_share": share(lambda c: c == "!"), "bar_share": share(lambda c: c == "|"),
        "punctuation_share": share(lambda c: c in ".,;:?'\"()[]-"), "digit_share": share(lambda c: c in "0123456789"), "distinct_share": len(set(low)) / len(low),
        "repeated_line_share": 1 - len(set(lines)) / len(lines), "words_a_line": len(words) / len(lines), "top_word_share": max(Counter(low).values()) / len(low),
        "repeated_pair_share": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0, "space_share": share(str.isspace), "wide_share": share(lambda c: ord(c) > 127), "longest_word": max(map(len, words)),
    }
    return [found[f] for f in quality.FEATURES]


def test_quality_scores_equal_plain_counting(spark, docs):
    rng = random.Random(8)
    letters = "abcXYZ é×À!|#.,;-'0123\n  日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["", " ", "one", "a\n\na\n", "word " * 300_000, "x" * 1_000_000]
    rows = [*enumerate(texts), (None, texts[0]), (3, None)]
    labels = spark.createDataFrame([(k, int("!" in t[:40])) for k, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(docs(rows), labels)
    table = lambda cuts, v: sum(v >= c for c in cuts)  # noqa: E731  the bin of a value

    def score(text):
        x = _plain_features(text or "")
        at = [table(model.cuts[k], v) for k, v in enumerate(x)]
        total = model.bias + sum(model.tables[k][at[k]] for k in range(len(x))) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
        return 1 / (1 + np.exp(-total))

    out = quality.classify(docs(rows), labels).collect()
    assert len(model.pairs) > 0 and len(out) == len(rows)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in out) == sorted((str(i), round(score(t), 9)) for i, t in rows)

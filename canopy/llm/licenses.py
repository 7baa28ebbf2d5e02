"""License scan: template markup compiled to token automata.

A template is plain wording with markup: ``[[ ... ]]`` is an optional region, ``((a | b))`` one of several wordings, ``{{n}}`` a
replaceable region of at most n words, ``2!`` a word after which no number of one or two digits stands (version 2, not 2.1), and
``clause!!`` one after which no identifier goes on (BSD-3-Clause, not BSD-3-Clause-Clear).  Each template becomes an automaton over words; a text is given the
template's label where the automaton accepts a stretch of its words, that is where all mandatory wording
matches exactly.  Versions and restrictions (share alike, non commercial) are mandatory wording.  Where accepted
stretches overlap, the longest one stands, so a license isn't also labelled by a shorter one that its text
begins with; of equally long ones all stand.  The identifiers of an SPDX expression (MIT OR Apache-2.0) are matched one by
one.  Beside it stands a base count of short phrases, whose labels stay.

Rows: null text counts as empty; empty texts have no words, no places and no labels; texts are scanned
whole, whatever their length; repeated rows each get their own result; an empty table gives an empty
result; columns other than the id and the text are ignored, whatever their names; a null id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from canopy.llm.batches import id_and_text, tidy

# Phrases of the base count and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# SPDX identifiers of each label, as words.
SPDX = {
    "mit": ["mit"], "mit-0": ["mit 0"], "apache-1.1": ["apache 1 1"], "apache-2": ["apache 2 0"], "bsd-2": ["bsd 2 clause"], "bsd-3": ["bsd 3 clause"],
    "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"], "bsl-1": ["bsl 1 0"], "mpl-2": ["mpl 2 0"], "epl-2": ["epl 2 0"],
    "gpl-2": ["gpl 2 0"], "gpl-3": ["gpl 3 0"], "lgpl-2.1": ["lgpl 2 1"], "lgpl-3": ["lgpl 3 0"], "agpl-3": ["agpl 3 0"],
    "cc0": ["cc0 1 0"],
} | {f"cc-by{x}": [f"cc by{x.replace('-', ' ')} {n}" for n in ("1 0", "2 0", "2 5", "3 0", "4 0")] for x in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd")}

# Names of the Creative Commons licenses behind "creative commons attribution"; words may be written as one.
CREATIVE_COMMONS = {
    "cc-by": "",
    "cc-by-sa": "share alike",
    "cc-by-nd": "no derivatives",
    "cc-by-nc": "non commercial",
    "cc-by-nc-sa": "non commercial share alike",
    "cc-by-nc-nd": "non commercial no derivatives",
}

# Names of the licenses of the GNU project with their versions; each version has its label.
GNU = {
    "gnu general public license": {"2": "gpl-2", "3": "gpl-3"},
    "gnu lesser general public license": {"2 1": "lgpl-2.1", "3": "lgpl-3"},
    "gnu affero general public license": {"3": "agpl-3"},
}

# Words with which an SPDX identifier goes on to that of another license, and those between identifiers.
GOES_ON = set("clear clause attribution modification lbnl nuclear open views shortened patent uc advertising cmu enna feh modern testregex festival khronos wu sa nd nc igo".split())
BETWEEN = {b"or", b"and"}

_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] [[{{1}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] [[{{1}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)

# Wording of public licenses and of the usual notices, with optional and replaceable regions.
NOTICES = [
    ("mit", "[[this {{4}} is]] [[dual]] [[licensed]] [[released]] [[distributed]] under the [[terms of the]] mit license"),
    ("mit", "((or|and)) the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement]]"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind"),
    ("apache", "[[licensed]] [[released]] under the [[terms of the]] apache [[software]] license"),
    ("apache-1.0", "[[licensed]] [[released]] ((under|or|and)) the [[terms of the]] apache [[software]] license ((version 1 0|v1 0))"),
    ("apache-1.1", "[[licensed]] [[released]] ((under|or|and)) the [[terms of the]] apache [[software]] license ((version 1 1|v1 1))"),
    ("apache-2", "[[licensed]] [[released]] ((under|or|and)) the [[terms of the]] apache [[software]] license ((version 2 0|version 2!|v2 0|v2!|2 0))"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-2", _BSD),
    ("bsd-3", _BSD + " [[and]] [[3]] [[{{1}}]] neither the name of {{12}} nor the names of [[its]] [[contributors]] {{4}} may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("bsl-1", "boost software license version 1 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "((mozilla public license|mpl)) ((v2 0|v2!|[[v]] [[version]] 2 0|version 2!))"),
    ("epl-2", "((eclipse public license|epl)) ((v2 0|v2!|[[v]] [[version]] 2 0|version 2!))"),
    ("cc0", "creative commons [[cc0]] [[zero]] [[v1 0]] [[v]] [[1 0]] [[universal]] public domain dedication"),
    ("cc0", "creative commons ((cc0|zero|cc0 zero)) ((v1 0|[[v]] 1 0)) [[universal]]"),
    ("cc0", "under [[the]] cc0 [[v1 0]] [[1 0]]"),
]


def _spellings(name: str) -> list[str]:
    """``name`` with each of its pairs of words written apart or as one."""
    out, words = [""], name.split()
    for pair in zip(words[::2], words[1::2], strict=True):
        out = [f"{x} {y}".strip() for x in out for y in (" ".join(pair), "".join(pair))]
    return out


def _version(number: str) -> str:
    """Wordings of a version; a number alone isn't followed by another."""
    last = number if " " in number else f"{number} 0|{number}!"
    return "((" + "|".join(f"v{x}|[[v]] [[version]] {x}" for x in last.split("|")) + "))"


def _templates() -> list[tuple[str, str]]:
    out = list(NOTICES)
    out += [(label, f"spdx license identifier {words}!! [[only]] [[or later]]") for label, ids in SPDX.items() for words in ids]
    numbers = ("1 0", "2 0", "2 5", "3 0", "4 0")
    number = "((" + "|".join(f"v{x}|[[version]] [[v]] {x}" for x in numbers) + "))"
    kind = "[[international]] [[unported]] [[generic]]"
    for label, name in CREATIVE_COMMONS.items():
        short = label.replace("-", " ")
        for spelled in _spellings(name):
            out.append((label, f"creative commons attribution {spelled} [[{number}]] {kind} [[public]] license"))
            out.append((label, f"creative commons attribution {spelled} {number} {kind} [[public]] [[license]]"))
        out.append((label, f"[[this {{{{4}}}} is]] [[licensed]] [[released]] under [[a]] [[the]] {short} [[{number}]] {kind} [[license]]"))
        out.append((label, f"[[creative commons]] {short} {number} {kind} [[license]]"))
    for name, versions in GNU.items():
        for version, label in versions.items():
            out.append((label, f"[[this {{{{4}}}} is]] [[licensed]] [[under]] [[the]] [[terms of the]] {name} [[as published by the free software foundation]] [[either]] {_version(version)} [[only]] [[of the license]] [[or at your option any later version]] [[or later]]"))
    return out


TEMPLATES = _templates()

SPDX_TAG, LONGEST_IDENTIFIER = [b"spdx", b"license", b"identifier"], 12

#: Bytes that are no part of a word become spaces; A-Z become a-z; bytes of other characters stay.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, matches array<struct<label:string,start:long,end:long>>"
)


class Automaton:
    """A nondeterministic automaton over words, made from one template."""

    def __init__(self, label: str, template: str) -> None:
        self.label = label
        self.words: list[dict[bytes, list[int]]] = [{}]  # state -> word -> next states
        self.any: list[list[int]] = [[]]  # state -> next states by any word
        self.free: list[list[int]] = [[]]  # state -> next states by no word
        self.mandatory: set[bytes] = set()
        self.ends_number: set[int] = set()  # states in which no number may follow
        self.ends_name: set[int] = set()  # and those in which no identifier may go on
        marks = re.findall(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\}\}|[^\s\[\]{}()|]+", template)
        state, opened, choices = 0, [], []
        for mark in marks:
            if mark == "[[":
                opened.append(state)
            elif mark == "]]":
                after = self._state()
                self.free[state].append(after)
                self.free[opened.pop()].append(after)
                state = after
            elif mark == "((":
                opened.append(state)
                choices.append([])
            elif mark == "|":
                choices[-1].append(state)
                state = self._state()
                self.free[opened[-1]].append(state)
            elif mark == "))":
                after = self._state()
                for end in (*choices.pop(), state):
                    self.free[end].append(after)
                opened.pop()
                state = after
            elif mark.startswith("{{"):
                after = self._state()
                for _ in range(int(mark[2:-2])):
                    self.free[state].append(after)
                    step = self._state()
                    self.any[state].append(step)
                    state = step
                self.free[state].append(after)
                state = after
            else:
                after = self._state()
                word = mark.rstrip("!").encode()
                self.words[state].setdefault(word, []).append(after)
                if mark.endswith("!"):
                    (self.ends_name if mark.endswith("!!") else self.ends_number).add(after)
                if not opened:
                    self.mandatory.add(word)
                state = after
        if opened:
            raise ValueError(f"a region of {label} does not end")
        self.end = state
        start = self._closure({0})
        self.first = {w for s in start for w in self.words[s]} if not any(self.any[s] for s in start) else None

    def _state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.free.append([])
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest stretch from ``at`` that the template accepts, or -1."""
        states, end, i = self._closure({0}), -1, at
        while states:
            if self.end in states and i > at:
                end = i
            if i == len(words):
                break
            after: set[int] = set()
            for s in states:
                after.update(self.words[s].get(words[i], ()))
                after.update(self.any[s])
            i += 1
            if i < len(words) and after & (self.ends_number | self.ends_name):
                number = len(words[i]) <= 2 and words[i].isdigit()
                after = {s for s in after if not (number and (s in self.ends_number or s in self.ends_name) or s in self.ends_name and words[i].decode() in GOES_ON)}
            states = self._closure(after)
        return end

    def find(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, int]]:
        """All accepted stretches that do not overlap, from left to right."""
        if not self.mandatory <= present:
            return []
        found, i = [], 0
        while i < len(words):
            if self.first is None or words[i] in self.first:
                end = self.match(words, i)
                if end > i:
                    found.append((i, end))
                    i = end
                    continue
            i += 1
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of ``phrase`` stand consecutively; places may overlap."""
    n, out, at = len(phrase), [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def longest(matches: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The stretches (start, end, label) that overlap no longer one."""
    stay: list[tuple[int, int, str]] = []
    held: dict[int, int] = {}  # word -> length of the stretch that stands there
    for start, end, label in sorted(set(matches), key=lambda m: (m[0] - m[1], m)):
        if all(held.get(i, end - start) == end - start for i in range(start, end)):
            stay.append((start, end, label))
            held.update(dict.fromkeys(range(start, end), end - start))
    return stay


def identifiers(words: list[bytes]) -> list[tuple[int, int]]:
    """The stretches of the second and later identifiers of SPDX expressions."""
    out = []
    for at in places(words, SPDX_TAG):
        begin, k = None, at + len(SPDX_TAG)
        while k < len(words):
            if words[k] in BETWEEN:
                if words[k : k + 2] != [b"or", b"later"]:
                    if begin is not None:
                        out.append((begin, k))
                    begin = k + 1
            elif k - (begin or at + len(SPDX_TAG)) > LONGEST_IDENTIFIER:
                break
            k += 1
        if begin is not None and begin < len(words):
            out.append((begin, min(len(words), begin + LONGEST_IDENTIFIER)))
    return out


def scan_text(text: str | None, base: list, automata: list[Automaton]) -> tuple:
    words = words_of(text)
    present = set(words)
    starts, base_labels, labels, matches = [], set(), set(), []
    for phrase, label in base:
        if present.issuperset(phrase) and (at := places(words, phrase)):
            starts += at
            base_labels.add(label)
    accepted = [(s, e, a.label) for a in automata for s, e in a.find(words, present)]
    for begin, stop in identifiers(words) if present.issuperset(SPDX_TAG) else ():
        one = [*SPDX_TAG, *words[begin : stop + 1]]
        accepted += [(begin, begin + end - len(SPDX_TAG), a.label) for a in automata if (end := a.match(one, 0)) > len(SPDX_TAG)]
    for start, end, label in longest(accepted):
        labels.add(label)
        matches.append((start, end, label))
    most = max((end - start for start, end, _ in matches), default=0)
    score = 1 - 4 / (8 + most) if labels else 0.5 if base_labels else 0.0
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score,
        [{"label": m[2], "start": m[0], "end": m[1]} for m in sorted(matches)],
    )


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base_phrases: dict[str, str] = BASE_PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Base places, labels and matched stretches of each document; score: from 0.5 towards 1 with the length of the
    longest accepted stretch, 0.5 with base phrases alone, else 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(p.encode().split(), label) for p, label in base_phrases.items()]
        automata = [Automaton(label, t) for label, t in templates]
        for batch in batches:
            rows = [scan_text(t, base, automata) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            long, text = pa.int64(), pa.string()
            kinds = (long, long, long, long, text, text, pa.float64(), MATCHES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    MATCHES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)

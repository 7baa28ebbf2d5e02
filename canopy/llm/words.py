"""Ids of a word-level BPE tokenizer that lowers case and drops white space, many texts at a time.

White space separates words for that tokenizer, so words are encoded independently: each distinct word of a
few documents is merged once, all of them together in NumPy.  Texts with rare characters, whose classes may
differ between libraries, are left to the tokenizer's own splitting.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cached_property

import numpy as np

from canopy.llm.batches import Encoded

#: Characters before this one are split here.
SIMPLE_END = 0x250
_NONE = np.iinfo(np.int32).max


class Merges:
    """The merges of a BPE model with word ends, as a hash table of pairs of ids."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str) -> None:
        named = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that name themselves
        names = {b: chr(b) for b in named} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in named)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.bits = 1 << (4 * len(pairs) - 1).bit_length()
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.keys = np.full(self.bits, -1, np.int64)
        self.ranks = np.full(self.bits, _NONE, np.int32)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] not in (-1, key):
                at = (at + 1) & (self.bits - 1)
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.bits.bit_length())).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.ranks[at]
        wrong = np.flatnonzero(found != keys)
        out[wrong] = _NONE
        wrong = wrong[found[wrong] != -1]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (self.bits - 1)
            found = self.keys[at[wrong]]
            hit = found == keys[wrong]
            out[wrong[hit]] = self.ranks[at[wrong[hit]]]
            wrong = wrong[~hit & (found != -1)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), _NONE, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.rank(ids[inside] << 32 | ids[inside + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            going = best != _NONE
            least = np.repeat(best, lengths)
            stay = np.repeat(going, lengths)
            done_ids.append(ids[~stay])
            done_words.append(word[~stay])
            merge = stay & (rank == least)
            twice = np.flatnonzero(merge[1:] & merge[:-1])
            if len(twice):  # of overlapping pairs every second one merges, from the left
                at = np.flatnonzero(merge)
                run = np.append(True, np.diff(at) > 1)
                first = at[np.flatnonzero(run)[np.cumsum(run) - 1]]
                merge[at[(at - first) % 2 == 1]] = False
            at = np.flatnonzero(merge)
            ids[at] = self.results[rank[at]]
            stay[at + 1] = False
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        flat = ids[by].astype("<u4").tobytes()
        edges = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *edges], edges, strict=False)]


class WordEncoder:
    """The tokenizer of a file, opened once per Python worker."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(SIMPLE_END)}
        letters, numbers = (re.escape("".join(c for c, k in kinds.items() if k == kind)) for kind in "LN")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\x09-\\x0d \\x85\\xa0{letters}{numbers}]+")
        self.simple = re.compile(f"[\\x00-{chr(SIMPLE_END - 1)}]*").fullmatch
        self.words = Encoded(lambda words: self.merges.encode([w.encode() for w in words]))

    @cached_property
    def tokenizer(self):
        """The library's tokenizer; only odd texts need it, so most workers never load it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words, own = [], {}
        for k, text in enumerate(texts):
            if "<|" in text or not (text.isascii() or self.simple(text)):
                own[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                words.append([])
            else:
                words.append(self.split.findall(unicodedata.normalize("NFC", text).lower()))
        return [own.get(k, b) for k, b in enumerate(self.words.join(words))]

"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest prefixes through the model's compiled character map (a double array of
bytes with the replacements behind it); for each normalised byte the source byte is recorded.  The
normalised text is cut where no piece can reach across, the chunks are segmented by the model without its
own normaliser, and every piece is projected through the recorded alignment to a span of source bytes.

Rows: null counts as empty; an empty text has no pieces but the begin and end ids; texts are encoded whole;
each of several equal rows gets its result; an empty table gives an empty result; other columns are ignored;
a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopy.llm.batches import Encoded, id_and_text, slices, tidy

SPACE = "▁"
#: In front of a chunk that has no space mark.
BARE = "\x01"


class CharacterMap:
    """The compiled map: size of the double array, the array (32-bit units), replacements ended by zeros."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._child(self.units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """A SentencePiece BPE model, opened once per Python worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.characters = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kind = pb.ModelProto.SentencePiece
        names = [p.piece for p in proto.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)]
        own = any(p.type == kind.USER_DEFINED for p in proto.pieces)
        across = [p for p in names if SPACE in p.lstrip(SPACE)]
        # no piece has a space mark behind another character, or a line break: chunks are independent there
        self.chunks = None if own or across or any("\n" in p for p in names) else re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.widths = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.bos, self.eos, self.unk = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache = Encoded(self._segment)
        self.identity = bool(self.chunks) and not self.characters.units and not self.squeeze and self.dummy and self.escape

    @cached_property
    def mark(self) -> bytes:
        return SPACE.encode() if self.escape else b" "

    def _segment(self, keys: list[str]) -> list[bytes]:
        chunks = [k if k[0] in (SPACE, "\n") else k[1:] if k[0] == BARE else SPACE + k for k in keys]
        return [np.array(x, "<u4").tobytes() for x in self.plain.encode(chunks, num_threads=1)]

    def cut(self, text: str, normal: bytes) -> list[str]:
        """Keys of the chunks of the normalised text; no piece reaches across chunks.

        A key is a chunk with its space marks, a line break, BARE and a chunk that has no mark, or just the
        word of a chunk with one mark.
        """
        if self.identity and not text.startswith(" ") and SPACE not in text and BARE not in text:
            # the usual text: single spaces and line breaks between words, so plain splitting does
            parts = text.replace("\n", f" \n {BARE}").split(" ")
            if "" not in parts and BARE not in parts and parts[0] != "\n":
                return parts
        whole = normal.decode()
        if not self.chunks:
            return [whole if whole.startswith(SPACE) else BARE + whole] if whole else []
        keys = []
        for c in self.chunks.findall(whole):
            if c[0] not in (SPACE, "\n"):
                c = BARE + c
            elif len(c) > 1 and c[1] not in (SPACE, "\n", BARE):
                c = c[1:]
            keys.append(c)
        return keys

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the byte of the source where it comes from."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, np.int64)
        if not self.characters.units and not self.squeeze:  # every character stands for itself
            prefix = self.mark if self.dummy else b""
            width = np.ones(len(source) + 1, np.int64)
            width[:-1][np.frombuffer(source, np.uint8) == 32] = len(self.mark)
            align = np.repeat(np.arange(len(source) + 1), width)
            return prefix + source.replace(b" ", self.mark), np.concatenate((np.zeros(len(prefix), np.int64), align))
        out, align, at = bytearray(), [], 0
        begun = spaced = False
        while at < len(source):
            found = self.characters.longest(source, at)
            if found is None:
                lead = source[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = (size, source[at : at + size])
            size, to = found
            if self.squeeze and (spaced or not begun):
                to = to.lstrip(b" ")
            if to:
                if not begun and self.dummy:
                    out += self.mark
                    align += [at] * len(self.mark)
                begun, spaced = True, to.endswith(b" ")
                to = to.replace(b" ", self.mark)
                out += to
                align += [at] * len(to)
            at += size
        if self.squeeze:
            while out.endswith(self.mark) and begun:
                del out[-len(self.mark) :]
                at = align[-len(self.mark)]
                del align[-len(self.mark) :]
        return bytes(out), np.array([*align, at], np.int64)

    def encode(self, texts: list[str], spans: bool = True) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """Ids (no begin or end id), and first source byte and end of each piece."""
        normal = [self.normalise(t) for t in texts]
        joined = self.cache.join([self.cut(t, n) for t, (n, _) in zip(texts, normal, strict=True)])
        out = []
        for (n, align), b in zip(normal, joined, strict=True):
            ids = np.frombuffer(b, "<u4")
            if not spans:
                out.append((ids, None, None))
                continue
            width = self.widths[ids]
            edges = np.concatenate(([0], np.cumsum(width)))
            if edges[-1] != len(n):  # pieces of unknown characters: the library tells how long they are
                at = [0]
                for p in self.plain.encode(n.decode(), out_type="immutable_proto").pieces:
                    at.append(at[-1] + len(p.surface.encode()))
                edges = np.array(at)
            out.append((ids, align[edges[:-1]], align[edges[1:]]))
        return out


_OPEN: dict[str, PieceModel] = {}


def opened(path: str) -> PieceModel:
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends): all ids, with begin and end ids, and the span of source bytes of each piece
    (empty at the start and the end of the text for those two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, long = opened(model), pa.list_(pa.int64())
        for ids, texts in slices(batches):
            rows = [
                ([m.bos, *i.tolist(), m.eos], [0, *b.tolist(), len(t.encode())], [0, *e.tolist(), len(t.encode())])
                for t, (i, b, e) in zip(texts, m.encode(texts), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], long) for k in range(3))],
                names=["doc_id", "ids", "begins", "ends"],
            )
        m.cache.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<long>, begins array<long>, ends array<long>")


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and give digests of ids and decoded text; ``covered_bytes``: source bytes in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(model)
        for ids, texts in slices(batches):
            rows = []
            for i, begins, ends in m.encode(texts):
                all_ids = np.concatenate(([m.bos], i, [m.eos])).astype("<u4")
                decoded = m.library.decode(all_ids.tolist())
                rows.append(
                    (len(all_ids), hashlib.sha256(all_ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int((ends - begins).sum()))
                )
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )
        m.cache.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    )

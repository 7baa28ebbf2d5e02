"""TIFF files of rasters: the directory of their blocks, and blocks as bytes, in NumPy.

Blocks are tiles, or strips over the whole width.  A window needs the directory and its own blocks, so it is read by ranges from any
file that can seek.  Read are classic and big files of either byte order, bands stored together or apart, plain, LZW or
deflate, with horizontal differences of integers or the differences of bytes for floats.  Written are tiles with the bands together.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

# Fixed values of the format: tags, kinds of values (code -> struct letter), compressions and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA_SAMPLES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
FORMATS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Layout:
    """What the directory of a file says."""

    height: int
    width: int
    bands: int
    dtype: np.dtype  # with the file's byte order
    block: tuple[int, int]
    compression: int = NONE
    predictor: int = 1
    apart: bool = False
    offsets: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    tags: dict[int, tuple] = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])

    @property
    def no_data(self) -> float:
        """What cells are whose block isn't stored."""
        said = self.tags.get(NO_DATA)
        return float(said[0].split(b"\0")[0]) if said else 0.0


def read_layout(f: BinaryIO) -> Layout:
    """The first directory of a file."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    at, entry, long = (struct.unpack(f"{order}I", head[4:8])[0], 12, "I") if version == 42 else (struct.unpack(f"{order}Q", head[8:16])[0], 20, "Q")
    f.seek(at)
    n = struct.unpack(f"{order}{'H' if version == 42 else 'Q'}", f.read(2 if version == 42 else 8))[0]
    raw, tags = f.read(n * entry), {}
    for k in range(n):
        tag, kind = struct.unpack(f"{order}HH", raw[k * entry : k * entry + 4])
        many = struct.unpack(f"{order}{long}", raw[k * entry + 4 : k * entry + entry // 2 + 2])[0]
        value = raw[k * entry + entry // 2 + 2 : (k + 1) * entry]
        if kind not in KINDS:
            continue
        size = struct.calcsize(KINDS[kind]) * many
        if size > len(value):
            f.seek(struct.unpack(f"{order}{long}", value)[0])
            value = f.read(size)
        tags[tag] = (value[:many],) if kind == 2 else struct.unpack(f"{order}{many}{KINDS[kind]}", value[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    tiled = TILE_WIDTH in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, 1 << 31), one(HEIGHT, 0)), one(WIDTH, 0))
    kind = f"{order}{FORMATS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 1) // 8}"
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    return Layout(one(HEIGHT, 0), one(WIDTH, 0), one(SAMPLES, 1), np.dtype(kind), block, one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2, list(offsets), list(counts), tags)


def read_window(f: BinaryIO, layout: Layout, row: int, col: int, height: int, width: int, bands: list[int]) -> np.ndarray:
    """(bands, height, width) of the bands (from 1) of a window, from its own blocks."""
    out = np.full((len(bands), height, width), layout.no_data).astype(layout.dtype.newbyteorder("="))
    high, wide = layout.block
    planes = [(b - 1, [k]) for k, b in enumerate(bands)] if layout.apart else [(0, list(range(len(bands))))]
    for r in range(row // high, -(-(row + height) // high)):
        for c in range(col // wide, -(-(col + width) // wide)):
            for plane, places in planes:
                n = plane * layout.across * layout.down + r * layout.across + c
                if not layout.counts[n]:
                    continue
                f.seek(layout.offsets[n])
                data = decoded(f.read(layout.counts[n]), layout, high if TILE_WIDTH in layout.tags else min(high, layout.height - r * high))
                top, left = max(row, r * high), max(col, c * wide)
                end, right = min(row + height, r * high + data.shape[1]), min(col + width, (c + 1) * wide)
                for k in places:
                    part = data[0 if layout.apart else bands[k] - 1, top - r * high : end - r * high, left - c * wide : right - c * wide]
                    out[k, top - row : end - row, left - col : right - col] = part
    return out


def decoded(raw: bytes, layout: Layout, high: int) -> np.ndarray:
    """(bands, rows, columns) of a block."""
    if layout.compression == LZW:
        raw = lzw_decoded(raw)
    elif layout.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif layout.compression != NONE:
        raise ValueError(f"compression {layout.compression} isn't known")
    bands, wide, size = 1 if layout.apart else layout.bands, layout.block[1], layout.dtype.itemsize
    cells = np.frombuffer(raw[: high * wide * bands * size], np.uint8)
    if layout.predictor == 3:
        lines = np.add.accumulate(cells.reshape(high, wide * size, bands), axis=1, dtype=np.uint8).reshape(high, size, wide * bands)
        big = np.ascontiguousarray(lines.transpose(0, 2, 1)).view(layout.dtype.newbyteorder(">"))
        data = big.reshape(high, wide, bands).astype(layout.dtype.newbyteorder("="))
    else:
        data = cells.view(layout.dtype).reshape(high, wide, bands).astype(layout.dtype.newbyteorder("="))
        if layout.predictor == 2:
            data = np.add.accumulate(data, axis=1, dtype=data.dtype)
    return data.transpose(2, 0, 1)


def encoded(data: np.ndarray, layout: Layout) -> bytes:
    """A whole tile (bands, rows, columns) as the layout stores it, bands together."""
    cells = np.ascontiguousarray(data.transpose(1, 2, 0)).astype(layout.dtype)
    if layout.predictor == 2:
        cells[:, 1:] -= cells[:, :-1].copy()
    elif layout.predictor == 3:
        high, wide, bands = cells.shape
        lines = cells.astype(layout.dtype.newbyteorder(">")).reshape(high, wide * bands, 1).view(np.uint8).transpose(0, 2, 1)
        cells = np.ascontiguousarray(lines).reshape(high, wide * layout.dtype.itemsize, bands)
        cells[:, 1:] -= cells[:, :-1].copy()
    raw = cells.tobytes()
    return lzw_encoded(raw) if layout.compression == LZW else zlib.compress(raw, 6) if layout.compression == DEFLATE else raw


def header(layout: Layout) -> bytes:
    """Header and directory of a file of tiles, which follow in order; the layout's offsets are set.  Big if it must be."""
    big = sum(layout.counts) + 64 * len(layout.counts) > (1 << 32) - (1 << 20)
    kind = {"u": 1, "i": 2, "f": 3}[layout.dtype.kind]
    long, many = (16, "Q") if big else (4, "I")
    tags: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (layout.width,)), HEIGHT: (4, (layout.height,)), BITS: (3, (8 * layout.dtype.itemsize,) * layout.bands), COMPRESSION: (3, (layout.compression,)),
        PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (layout.bands,)), PLANAR: (3, (1,)), PREDICTOR: (3, (layout.predictor,)), TILE_WIDTH: (4, (layout.block[1],)),
        TILE_HEIGHT: (4, (layout.block[0],)), TILE_OFFSETS: (long, (0,) * len(layout.counts)), TILE_COUNTS: (long, tuple(layout.counts)), SAMPLE_FORMAT: (3, (kind,) * layout.bands),
    }
    if layout.bands > 1:
        tags[EXTRA_SAMPLES] = (3, (0,) * (layout.bands - 1))
    for tag, code in ((PIXEL_SCALE, 12), (TIE_POINT, 12), (GEO_KEYS, 3), (NO_DATA, 2)):
        if tag in layout.tags:
            tags[tag] = (code, layout.tags[tag])

    entry, begin = (20, 16) if big else (12, 8)
    room = entry - entry // 2 - 2  # of a value in its entry
    rest_at = begin + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    sizes = {t: len(v[0]) if code == 2 else struct.calcsize(KINDS[code]) * len(v) for t, (code, v) in tags.items()}
    data_at = rest_at + sum(s + s % 2 for s in sizes.values() if s > room)
    layout.offsets = [0] * len(layout.counts)
    for n, size in enumerate(layout.counts):  # a running sum of what is stored
        layout.offsets[n], data_at = (data_at, data_at + size) if size else (0, data_at)
    tags[TILE_OFFSETS] = (long, tuple(layout.offsets))
    out = [b"II", struct.pack("<HHHQ", 43, 8, 0, begin) if big else struct.pack("<HI", 42, begin), struct.pack("<Q" if big else "<H", len(tags))]
    rest = []
    for tag, (code, values) in sorted(tags.items()):
        raw = values[0] if code == 2 else struct.pack(f"<{len(values)}{KINDS[code]}", *values)
        out.append(struct.pack(f"<HH{many}", tag, code, len(raw) if code == 2 else len(values)))
        if len(raw) > room:
            out.append(struct.pack(f"<{many}", rest_at))
            rest.append(raw + b"\0" * (len(raw) % 2))
            rest_at += len(rest[-1])
        else:
            out.append(raw.ljust(room, b"\0"))
    return b"".join([*out, struct.pack(f"<{many}", 0), *rest])


_CLEAR, _END = 256, 257


def lzw_decoded(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; the width grows one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, held, bits, before = list(first), [], 9, 0, 0, b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, before = list(first), 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before:
            table.append(before + now[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        before = now
    return b"".join(out)


def lzw_encoded(raw: bytes) -> bytes:
    first = {bytes([k]): k for k in range(256)}
    table, free, width, held, bits, out = dict(first), 258, 9, _CLEAR, 9, bytearray()
    word = b""
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if longer in table:
            word = longer
            continue
        held, bits = held << width | table[word], bits + width
        table[longer], free = free, free + 1
        if free == 4095:
            held, bits = held << width | _CLEAR, bits + width
            table, free, width = dict(first), 258, 9
        elif free == 1 << width:
            width += 1
        word = raw[k : k + 1]
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1
    if word:
        held, bits, free = held << width | table[word], bits + width, free + 1
        if free == 1 << width and width < 12:
            width += 1
    held, bits = held << width | _END, bits + width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes((bits + pad) // 8, "big")

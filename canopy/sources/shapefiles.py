"""Shapefiles: geometries (.shp) by the offsets of their index (.shx), with the attributes of the table beside them (.dbf).

A file is read in ranges of records, each by a task that reads its own bytes of the three files.  Written are shapefiles
of one partition each, in a folder.
"""

from __future__ import annotations

import datetime
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from canopy.sources.rasters import _at

#: Records of a task.
RECORDS = 20_000
# Fixed values of the format: kinds of shapes (those with further dimensions are 10 and 20 more), and of fields.
POINT, LINES, POLYGON = 1, 3, 5
KINDS = {POINT: "Point", LINES: "LineString", POLYGON: "Polygon", 8: "MultiPoint"}
_POINT = "struct<x:double,y:double>"
_GEOMETRY = f"kind string, polygons array<array<array<{_POINT}>>>, x double, y double"


class Fields:
    """The columns of a .dbf table."""

    def __init__(self, raw: bytes) -> None:
        self.rows, self.begin, self.width = struct.unpack("<IHH", raw[4:12])
        self.columns, at, end = [], 1, self.begin
        for k in range(32, end - 1, 32):
            if raw[k] == 0x0D:
                break
            size, places = raw[k + 16], raw[k + 17]
            self.columns.append((raw[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(raw[k + 11]), at, size, places))
            at += size

    def schema(self) -> T.StructType:
        kinds = {"N": T.LongType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}
        return T.StructType([T.StructField(name, T.DoubleType() if kind == "N" and places else kinds.get(kind, T.StringType())) for name, kind, _, _, places in self.columns])

    def values(self, raw: bytes) -> list:
        out = []
        for _, kind, at, size, places in self.columns:
            text = raw[at : at + size].decode("utf-8", "replace").strip("\0 ")
            if not text or text.startswith("*"):
                out.append(None)
            elif kind == "D":
                out.append(datetime.datetime.strptime(text, "%Y%m%d").date() if text.isdigit() else None)
            elif kind == "L":
                out.append(True if text in "YyTt" else False if text in "NnFf" else None)
            elif kind == "F" or kind == "N" and places:
                out.append(float(text))
            else:
                out.append(int(float(text)) if kind == "N" else text)
        return out


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def polygons_of(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Outer rings run clockwise; the others are holes, of the smallest outer ring that holds them, or else outer rings too."""
    shells = [[r] for r in rings if _area(r) <= 0]
    for hole in (r for r in rings if _area(r) > 0):
        around = [s for s in shells if _holds(s[0], *hole[0])]
        min(around, key=lambda s: -_area(s[0])).append(hole) if around else shells.append([hole])
    return shells


def geometry(raw: bytes) -> tuple[str | None, list | None, float | None, float | None]:
    """(kind, polygons, x, y) of a record; of lines and groups of points only the kind."""
    kind = struct.unpack_from("<i", raw)[0] % 10 if len(raw) >= 4 else 0
    if kind == POINT:
        return "Point", None, *struct.unpack_from("<2d", raw, 4)
    if kind != POLYGON:
        return KINDS.get(kind), None, None, None
    parts, points = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), points]
    flat = np.frombuffer(raw, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    shells = polygons_of([[tuple(p) for p in flat[a:b]] for a, b in zip(starts, starts[1:], strict=False) if b > a])
    return "Polygon" if len(shells) == 1 else "MultiPolygon", [[[{"x": x, "y": y} for x, y in ring] for ring in s] for s in shells], None, None


def _shapefiles(path: str) -> list[str]:
    if path.lower().endswith(".shp"):
        return [path]
    fs, at = _at(path)
    head = path.rstrip("/").removesuffix(at.rstrip("/"))
    return sorted(head + i.path for i in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if i.path.lower().endswith(".shp") and "/_staged-" not in i.path)


def _beside(path: str, ending: str) -> str:
    return path[:-3] + (ending.upper() if path.endswith("SHP") else ending)


def _range(path: str, begin: int, size: int) -> bytes:
    fs, at = _at(path)
    with fs.open_input_file(at) as f:
        f.seek(begin)
        return f.read(size)


def read_shapefile(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """(attributes, kind, polygons, x, y) of each record of a shapefile, or of all in a folder, which have the same attributes."""
    files = _shapefiles(path)
    if not files:
        raise ValueError(f"no shapefiles in {path}")
    schema = Fields(_range(_beside(files[0], "dbf"), 0, 1 << 16)).schema()
    ranges = []
    for f in files:
        fs, at = _at(_beside(f, "shx"))
        n = (fs.get_file_info(at).size - 100) // 8
        ranges += [(f, k, min(records, n - k)) for k in range(0, n, records)]
    whole = T.StructType([*schema.fields, *T._parse_datatype_string(_GEOMETRY).fields])
    if not ranges:
        return spark.createDataFrame([], whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = np.frombuffer(_range(_beside(f, "shx"), 100 + 8 * first, 8 * n), ">i4").reshape(n, 2).astype(np.int64) * 2
                low, high = int(index[:, 0].min()), int((index[:, 0] + index[:, 1]).max()) + 8
                raw = _range(f, low, high - low)
                dbf = _beside(f, "dbf")
                fields = Fields(_range(dbf, 0, 1 << 16))
                table = _range(dbf, fields.begin + first * fields.width, n * fields.width)
                rows = [(*fields.values(table[k * fields.width : (k + 1) * fields.width]), *geometry(raw[at - low + 8 : at - low + 8 + size])) for k, (at, size) in enumerate(index.tolist())]
                live = [r for k, r in enumerate(rows) if table[k * fields.width : k * fields.width + 1] != b"*"]  # others are deleted
                columns = list(zip(*live, strict=True)) or [()] * len(whole)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=whole.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(x.dataType) for x in whole.fields]
    return spark.createDataFrame(ranges, "path string, first long, n long").repartition(len(ranges), "path", "first").mapInArrow(run, whole)


def write_shapefiles(df: DataFrame, path: str, ring: str | None = "ring", point: tuple[str, str] | None = None, projection: str | None = None) -> None:
    """Rows (ring, attributes) as shapefiles of polygons, or (point: two columns, attributes) of points: ``<path>/part-<n>.shp`` and so on,
    one for each partition that has rows.

    The folder is replaced.  Attributes are numbers, dates, booleans and texts (names of at most 10 and texts of at most 254 bytes, as the
    format has it; others raise).  projection: text of the .prj file.
    """
    places = list(point) if point else [ring]
    names = [c for c in df.columns if c not in places]
    if any(len(n.encode()) > 10 for n in names):
        raise ValueError(f"names of at most 10 bytes: {', '.join(names)}")
    kinds = {f.name: f.dataType for f in df.schema if f.name in names}
    staging = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def field(name: str) -> tuple[str, int, int]:
        kind = kinds[name]
        if isinstance(kind, T.BooleanType):
            return "L", 1, 0
        if isinstance(kind, T.DateType):
            return "D", 8, 0
        if isinstance(kind, T.IntegralType):
            return "N", 20, 0
        return ("F", 24, 15) if isinstance(kind, T.FractionalType) else ("C", 254, 0)

    def text(value: object, kind: str, size: int) -> bytes:
        if value is None or isinstance(value, float) and not math.isfinite(value):
            return b" " * size
        out = ("T" if value else "F") if kind == "L" else value.strftime("%Y%m%d") if kind == "D" else f"{value:.16e}" if kind == "F" else str(value)
        raw = out.encode()
        if len(raw) > size:
            raise ValueError(f"texts of at most {size} bytes")
        return raw.ljust(size) if kind == "C" else raw.rjust(size)

    def shape(row: dict) -> tuple[bytes, tuple | None]:
        if point:
            x, y = (row[c] for c in point)
            return (struct.pack("<i", 0), None) if x is None or y is None else (struct.pack("<i2d", POINT, x, y), (x, y, x, y))
        points = row[ring]
        flat = [(p["x"], p["y"]) for p in points or ()]
        if not flat:
            return struct.pack("<i", 0), None
        flat = flat if _area(flat) <= 0 else flat[::-1]  # outer rings run clockwise
        flat = flat if flat[0] == flat[-1] else [*flat, flat[0]]
        xs, ys = zip(*flat, strict=True)
        box = min(xs), min(ys), max(xs), max(ys)
        return struct.pack(f"<i4d3i{2 * len(flat)}d", POLYGON, *box, 1, len(flat), 0, *(v for p in flat for v in p)), box

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shp, shx, dbf, boxes, n, at = [], [], [], [], 0, 50
        for batch in batches:
            for row in batch.to_pylist():
                raw, box = shape(row)
                n += 1
                shp.append(struct.pack(">2i", n, len(raw) // 2) + raw)
                shx.append(struct.pack(">2i", at, len(raw) // 2))
                at += 4 + len(raw) // 2
                boxes += [box] if box else []
                dbf.append(b" " + b"".join(text(row[c], field(c)[0], field(c)[1]) for c in names))
        if not n:
            return
        if at >= 1 << 30:
            raise ValueError("a shapefile holds 2 GB at most; use more partitions")
        lows = [min(b[k] for b in boxes) if boxes else 0.0 for k in (0, 1)]
        highs = [max(b[k] for b in boxes) if boxes else 0.0 for k in (2, 3)]
        head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, POINT if point else POLYGON, *lows, *highs, 0, 0, 0, 0)
        columns = b"".join(c.encode().ljust(11, b"\0") + field(c)[0].encode() + b"\0" * 4 + bytes([field(c)[1], field(c)[2]]) + b"\0" * 14 for c in names)
        table = struct.pack("<4BIHH20x", 3, 126, 1, 1, n, 33 + len(columns), 1 + sum(field(c)[1] for c in names)) + columns + b"\r" + b"".join(dbf) + b"\x1a"
        name = f"part-{uuid.uuid4().hex}"
        files = {"shp": head(at) + b"".join(shp), "shx": head(50 + 4 * n) + b"".join(shx), "dbf": table, "cpg": b"UTF-8", **({"prj": projection.encode()} if projection else {})}
        for ending, raw in files.items():
            fs, to = _at(f"{staging}/{name}.{ending}")
            fs.create_dir(to.rsplit("/", 1)[0])
            with fs.open_output_stream(to) as f:
                f.write(raw)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sorted(files)])], names=["name", "endings"])

    try:
        parts = df.select(*places, *names).mapInArrow(run, "name string, endings array<string>").orderBy("name").collect()  # names of files
        fs, to = _at(path)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(to, allow_not_found=True)) if i.is_file]
        for k, part in enumerate(parts):
            for ending in part.endings:
                fs.move(_at(f"{staging}/{part.name}.{ending}")[1], f"{to.rstrip('/')}/part-{k:05d}.{ending}")
        kept = {f"part-{k:05d}.{e}" for k, part in enumerate(parts) for e in part.endings}
        for stale in old:
            if stale.rsplit("/", 1)[-1] not in kept:
                fs.delete_file(stale)
    finally:
        fs, at = _at(staging)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


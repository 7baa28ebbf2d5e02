"""Vector layers as tables: GeoJSON, GeoPackage and Parquet files with WKB geometries, without a geometry library.

A geometry is (kind, polygons, x, y): polygons as lists of rings of points, the outer ring first; x and y of points.
Of a null or broken geometry, and of lines and mixed collections, polygons, x and y are null.
"""

from __future__ import annotations

import json
import re
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.sources import shapefiles
from canopy.sources.rasters import _at
from canopy.sources.tables import geojson, geojson_points, read_csv, write_csv

RING = "array<struct<x:double,y:double>>"
_POINT = "array<double>"
_LEVELS = {"Polygon": f"array<array<{_POINT}>>", "MultiPolygon": f"array<array<array<{_POINT}>>>"}


#: Collections of more bytes are read in ranges of so many.
SPLIT = 64 << 20


def read_geojson(spark: SparkSession, path: str, properties: str | T.StructType, lines: bool = False, split: int = SPLIT) -> DataFrame:
    """(properties, kind, polygons, x, y) of each feature.

    lines: one feature a line, which are read in parts; else each file is one collection or feature: read whole, or in
    ranges of ``split`` bytes where it is a larger collection.
    """
    wanted = properties if isinstance(properties, T.StructType) else T.StructType.fromDDL(properties)
    feature = f"struct<geometry:struct<type:string,coordinates:string>,properties:{wanted.simpleString()}>"
    if lines:
        features = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", feature).alias("f"))
    else:
        sized = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names of files
        large = [(r.path, r.length) for r in sized if r.length > split]
        small = [r.path for r in sized if r.length <= split]
        parts = [split_features(spark, large, split).select(F.from_json("value", feature).alias("f"))] if large else []
        if small or not large:
            text = spark.read.text(small or path, wholetext=True).filter(F.trim("value") != "")
            whole = text.select(F.from_json("value", f"struct<features:array<{feature}>>").alias("c"), F.from_json("value", feature).alias("one"))
            parts.append(whole.select(F.explode(F.coalesce("c.features", F.array("one"))).alias("f")))
        features = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.when(kind == "Point", F.from_json(raw, _POINT))
    single, several = (F.when(kind == k, F.from_json(raw, shape)) for k, shape in _LEVELS.items())
    polygons = F.coalesce(F.when(single.isNotNull(), F.array(single)), several)
    return features.select("f.properties.*", kind.alias("kind"), _points(polygons).alias("polygons"), point[0].alias("x"), point[1].alias("y"))


#: What matters for the structure of JSON: strings, taken whole, and brackets.
_MARK = re.compile(rb'"(?:[^"\\]|\\.)*+"?|[\[\]{}]', re.S)
#: The first unescaped quote, where a range begins inside a string.
_REST = re.compile(rb'(?:[^"\\]|\\.)*+"?', re.S)
#: Brackets that are open where a feature of a collection begins.
_LIST = b"{["


def _scan(raw: bytes, inside: bool) -> tuple[int, bytes, bool]:
    """How many brackets that were open before a stretch it closes, which it leaves open, and whether it ends in a string."""
    at = 0
    if inside:
        m = _REST.match(raw)
        at, inside = m.end(), not m[0].endswith(b'"') or _escaped(m[0])
    closed, opened = 0, bytearray()
    if not inside:
        for m in _MARK.finditer(raw, at):
            mark = m[0]
            if mark in (b"{", b"["):
                opened += mark
            elif mark in (b"}", b"]"):
                if opened:
                    opened.pop()
                else:
                    closed += 1
            else:
                inside = len(mark) == 1 or not mark.endswith(b'"') or _escaped(mark)
    return closed, bytes(opened), inside


def _escaped(text: bytes) -> bool:
    """Whether the last character is escaped."""
    return (len(text) - 1 - len(text[:-1].rstrip(b"\\"))) % 2 == 1


def split_features(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """(value): the text of each feature of GeoJSON collections (path, bytes), each file read by ranges in many tasks.

    Where a range begins, in a string or not and under which open brackets, follows from what stands before: each task finds
    out what its range does to either state, the driver composes these few bytes a range in order, and tasks read
    the features that begin in their ranges, up to their ends.
    """
    ranges = [(f, a, min(a + split, size)) for f, size in files for a in range(0, size, split)]

    def cut(f: pa.NativeFile, at: int, size: int) -> int:
        """``at``, moved behind backslashes, which belong to what follows them."""
        while 0 < at < size:
            f.seek(at - 1)
            if f.read(1) != b"\\":
                break
            at += 1
        return at

    def opened(path: str) -> tuple[pa.NativeFile, int]:
        fs, at = _at(path)
        return fs.open_input_file(at), fs.get_file_info(at).size

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, size = opened(path)
                with f:
                    begin, end = cut(f, a, size), cut(f, b, size)
                    f.seek(begin)
                    raw = f.read(max(end - begin, 0))
                for inside in (False, True):
                    rows.append((path, a, begin, end, inside, *_scan(raw, inside)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k.name for k in kinds])

    schema = "path string, at long, begin long, end long, inside boolean, closed long, opened binary, ends boolean"
    kinds = [pa.field(*x) for x in zip(("path", "at", "begin", "end", "inside", "closed", "opened", "ends"), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.bool_()), strict=True)]
    dealt = spark.createDataFrame(ranges, "path string, a long, b long").repartition(len(ranges), "path", "a")
    found = {(r.path, r.at, r.inside): r for r in dealt.mapInArrow(summary, schema).collect()}  # two short rows a range
    starts, before, inside, stack = [], None, False, b""
    for path, a, _ in ranges:
        if path != before:
            before, inside, stack = path, False, b""
        r = found[path, a, inside]
        starts.append((path, r.begin, r.end, inside, bytearray(stack)))
        stack = stack[: max(0, len(stack) - r.closed)] + bytes(r.opened)
        inside = r.ends

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end, inside, stack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, size = opened(path)
                with f:
                    f.seek(begin)
                    raw = f.read(max(end - begin, 0))
                    out, start, stack = [], None, bytearray(stack)
                    at = _REST.match(raw).end() if inside else 0
                    while True:
                        again = None  # a string that the end of what was read cuts
                        for m in _MARK.finditer(raw, at):
                            mark = m[0]
                            if mark in (b"{", b"["):
                                if mark == b"{" and bytes(stack) == _LIST and begin + m.start() < end:
                                    start = m.start()
                                stack += mark
                            elif mark in (b"}", b"]"):
                                stack and stack.pop()
                                if start is not None and bytes(stack) == _LIST:
                                    out.append(raw[start : m.end()].decode())
                                    start = None
                            elif m.end() == len(raw) and (len(mark) == 1 or not mark.endswith(b'"') or _escaped(mark)):
                                again = m.start()
                        if start is None or f.tell() >= size:
                            break
                        at = len(raw) if again is None else again
                        raw += f.read(1 << 20)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    kept = spark.createDataFrame([(p, a, b, i, s) for p, a, b, i, s in starts], "path string, begin long, end long, inside boolean, stack binary")
    return kept.repartition(len(starts), "path", "begin").mapInArrow(read, "value string")


def _points(polygons: Column) -> Column:
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def _geometry(raw: bytes | None) -> tuple[str | None, list | None, float | None, float | None]:
    """A WKB geometry; further dimensions are skipped, in both ways of marking them."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(order + form, raw, at)
        at += struct.calcsize(order + form)
        return out

    def head() -> tuple[int, int]:
        nonlocal at, order
        order = "<" if raw[at] == 1 else ">"
        at += 1
        (code,) = take("I")
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            take("I")  # the coordinate system
        code &= 0x0FFFFFFF
        return code % 1000, size + (0, 1, 1, 2)[code // 1000]

    def rings(size: int) -> list:
        out = []
        for _ in range(take("I")[0]):
            n = take("I")[0]
            flat = take(f"{n * size}d")
            out.append([{"x": x, "y": y} for x, y in zip(flat[::size], flat[1::size], strict=True)])
        return out

    order = "<"
    try:
        kind, size = head()
        if kind == 1:
            x, y = take(f"{size}d")[:2]
            return "Point", None, x, y
        if kind == 3:
            return "Polygon", [rings(size)], None, None
        if kind == 6:
            return "MultiPolygon", [rings(head()[1]) for _ in range(take("I")[0])], None, None
    except (struct.error, IndexError, TypeError):  # cut short, or none
        pass
    return None, None, None, None


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry", columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """(columns, kind, polygons, x, y) of a Parquet table with WKB geometries; conditions on other columns reach the scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return decoded(df.select(*(columns if columns is not None else [c for c in df.columns if c != geometry]), geometry), geometry)


def decoded(df: DataFrame, geometry: str) -> DataFrame:
    """``df`` with (kind, polygons, x, y) in place of its WKB column."""

    @F.pandas_udf(f"kind string, polygons array<array<{RING}>>, x double, y double")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in parts:
            yield pd.DataFrame([_geometry(r) for r in raw], columns=["kind", "polygons", "x", "y"], dtype=object)

    return df.withColumn("_g", decode(geometry)).select(*[c for c in df.columns if c != geometry], "_g.*")


def _ring_wkb(points: list | None) -> bytes | None:
    """A ring as a WKB polygon, closed."""
    if points is None or not len(points):
        return None
    flat = [v for p in (*points, points[0]) for v in (p["x"], p["y"])]
    return struct.pack(f"<BIII{len(flat)}d", 1, 3, 1, len(flat) // 2, *flat)


def write_geoparquet(df: DataFrame, path: str, ring: str = "ring", geometry: str = "geometry", crs: dict | None = None) -> None:
    """GeoParquet: the ring as a WKB polygon, closed, and its bounds (xmin, ymin, xmax, ymax), by which scans can skip files.

    Each task writes its rows as a file with the format's own metadata; files get their places when all are written.
    crs: the coordinate system as PROJJSON.
    """
    from canopy.operators.geo import bounds

    @F.pandas_udf("binary")
    def encode(rings: pd.Series) -> pd.Series:
        return rings.map(_ring_wkb)

    box = {k: v for k, v in bounds(F.col(ring)).items() if k not in df.columns}
    rows = df.withColumns({geometry: encode(F.col(ring)), **box}).drop(ring)
    covering = {"bbox": {k: [k] for k in ("xmin", "ymin", "xmax", "ymax")}} if len(box) == 4 else None
    column = {"encoding": "WKB", "geometry_types": ["Polygon"], **({"crs": crs} if crs else {}), **({"covering": covering} if covering else {})}
    geo = json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}).encode()
    staging = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, f"part-{uuid.uuid4().hex}.parquet"
        fs, at = _at(f"{staging}/{name}")
        for batch in batches:
            if writer is None:
                fs.create_dir(at.rsplit("/", 1)[0])
                writer = pq.ParquetWriter(at, batch.schema.with_metadata({b"geo": geo}), filesystem=fs)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    _put(path, staging, lambda: [r.name for r in rows.mapInArrow(run, "name string").collect()])


def _put(path: str, staging: str, write: object) -> None:
    """Replace the files of a folder by those that ``write`` has staged (their names)."""
    fs, to = _at(path)
    try:
        names = write()
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(to, allow_not_found=True)) if i.is_file]
        fs.create_dir(to)
        for name in names:
            fs.move(_at(f"{staging}/{name}")[1], f"{to.rstrip('/')}/{name}")
        for stale in old:
            fs.delete_file(stale)
    finally:
        at = _at(staging)[1]
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


# Fixed values of the format: its mark, version and tables.
_GPKG = [
    f"PRAGMA application_id = {0x47504B47}",
    "PRAGMA user_version = 10300",
    "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)",
    "CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)",
    "CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))",
    "INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL)",
]
_SQL_KINDS = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "TINYINT": "long", "SMALLINT": "long", "BOOLEAN": "boolean", "DOUBLE": "double", "REAL": "double", "FLOAT": "double", "BLOB": "binary"}
_quoted = lambda name: '"' + name.replace('"', '""') + '"'


def write_geopackages(df: DataFrame, path: str, layer: str = "layer", ring: str | None = "ring", point: tuple[str, str] | None = None, epsg: int = -1) -> None:
    """Rows (ring or point, attributes) as GeoPackages of one layer, one for each partition that has rows; the folder is replaced.

    A package is made in the memory of its task, so partitions should be of moderate size.
    """
    places = list(point) if point else [ring]
    names = [c for c in df.columns if c not in places]
    kinds = {f.name: {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "DOUBLE", "binary": "BLOB"}.get(f.dataType.simpleString(), "TEXT") for f in df.schema}
    texts = [F.col(c) if kinds[c] != "TEXT" else F.col(c).cast("string").alias(c) for c in names]
    staging = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def blob(row: dict) -> bytes | None:
        if point:
            x, y = (row[c] for c in point)
            wkb = None if x is None or y is None else struct.pack("<BI2d", 1, 1, x, y)
        else:
            wkb = _ring_wkb(row[ring])
        return wkb and b"GP\0\1" + struct.pack("<i", epsg) + wkb

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, name = None, f"part-{uuid.uuid4().hex}.gpkg"
        for batch in batches:
            if con is None:
                con = sqlite3.connect(":memory:")
                for statement in _GPKG:
                    con.execute(statement)
                if epsg > 0:
                    con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{epsg}", epsg, epsg))
                con.execute(f"CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom {'POINT' if point else 'POLYGON'}{''.join(f', {_quoted(c)} {kinds[c]}' for c in names)})")
                con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, epsg))
                con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (layer, "POINT" if point else "POLYGON", epsg))
            con.executemany(f"INSERT INTO {_quoted(layer)} (geom{''.join(f', {_quoted(c)}' for c in names)}) VALUES (?{', ?' * len(names)})", ((blob(r), *(r[c] for c in names)) for r in batch.to_pylist()))
        if con is not None:
            con.commit()
            fs, at = _at(f"{staging}/{name}")
            fs.create_dir(at.rsplit("/", 1)[0])
            with fs.open_output_stream(at) as f:
                f.write(con.serialize())
            con.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    _put(path, staging, lambda: [r.name for r in df.select(*places, *texts).mapInArrow(run, "name string").collect()])


def _package(path: str) -> sqlite3.Connection:
    """A package opened where it is, or, from a store, in memory."""
    fs, at = _at(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return sqlite3.connect(f"file:{at}?mode=ro", uri=True)
    con = sqlite3.connect(":memory:")
    with fs.open_input_file(at) as f:
        con.deserialize(f.read())
    return con


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, rows: int = 100_000) -> DataFrame:
    """(attributes, kind, polygons, x, y) of a layer (default: the first) of a GeoPackage, or of all in a folder, by ranges of rows."""
    fs, at = _at(path)
    head = path.rstrip("/").removesuffix(at.rstrip("/"))
    files = [path] if path.endswith(".gpkg") else sorted(head + i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.path.endswith(".gpkg"))
    if not files:
        raise ValueError(f"no packages in {path}")
    con = _package(files[0])
    layer = layer or con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name").fetchone()[0]
    geometry = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
    columns = [(r[1], _SQL_KINDS.get(r[2].split("(")[0].upper(), "string")) for r in con.execute(f"PRAGMA table_info({_quoted(layer)})") if r[1] != geometry and not r[5]]
    con.close()
    ranges = []
    for f in files:
        con = _package(f)
        least, most = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(layer)}").fetchone()
        con.close()
        ranges += [(f, a, a + rows) for a in range(least, most + 1, rows)] if least is not None else []
    schema = T.StructType.fromDDL(", ".join([*(f"{_quoted(n).replace(chr(34), chr(96))} {k}" for n, k in columns), "_wkb binary"]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f, a, b in part.itertuples(index=False):
                con = _package(f)
                wanted = ", ".join(_quoted(n) for n in (*(n for n, _ in columns), geometry))
                found = con.execute(f"SELECT {wanted} FROM {_quoted(layer)} WHERE rowid >= ? AND rowid < ?", (int(a), int(b))).fetchall()
                con.close()
                out = pd.DataFrame(found, columns=schema.names, dtype=object)
                for n, k in columns:
                    if k == "boolean":
                        out[n] = out[n].map(lambda v: None if v is None else bool(v))
                out["_wkb"] = out["_wkb"].map(_package_wkb)
                yield out

    if not ranges:
        return decoded(spark.createDataFrame([], schema), "_wkb")
    dealt = spark.createDataFrame(ranges, "path string, a long, b long").repartition(len(ranges), "path", "a")
    return decoded(dealt.mapInPandas(run, schema), "_wkb")


def _package_wkb(raw: bytes | None) -> bytes | None:
    """The WKB behind the head of a geometry, whose envelope may have 0 to 8 numbers."""
    if not raw or raw[:2] != b"GP":
        return None
    return raw[8 + 8 * (0, 4, 6, 6, 8)[raw[3] >> 1 & 7] :]


def read_vectors(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """A layer by its ending: .parquet, .shp, .gpkg, .csv, else GeoJSON (properties: a schema string)."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        return read_geoparquet(spark, path)
    if ending == "shp":
        return shapefiles.read_shapefile(spark, path)
    if ending == "gpkg":
        return read_geopackage(spark, path)
    return read_csv(spark, path) if ending == "csv" else read_geojson(spark, path, properties or "id string", lines=ending in ("geojsonl", "ndjson", "jsonl"))


def export_layers(df: DataFrame, path: str, ring: str = "ring") -> list[str]:
    """A table as GeoJSON lines, shapefiles and GeoPackages below ``path``: its rings, else its points by the usual names of longitude and
    latitude; without either, as CSV.  Returns the folders."""
    at = path.rstrip("/")
    point = next(((x, y) for x, y in (("longitude", "latitude"), ("lon", "lat")) if {x, y} <= set(df.columns)), None)
    if ring not in df.columns and point is None:
        write_csv(df, f"{at}/csv")
        return [f"{at}/csv"]
    rings = ring in df.columns
    (geojson(df, ring) if rings else geojson_points(df, *point)).write.mode("overwrite").text(f"{at}/geojson")
    shapefiles.write_shapefiles(df, f"{at}/shp", ring, None if rings else point)
    write_geopackages(df, f"{at}/gpkg", "layer", ring, None if rings else point)
    return [f"{at}/{k}" for k in ("geojson", "shp", "gpkg")]


def outer_rings(features: DataFrame) -> DataFrame:
    """One row (ring) for each polygon of each feature: its outer ring, without the repeated last point; holes are left out."""
    rows = features.withColumn("_p", F.explode("polygons")).withColumn("ring", F.col("_p")[0]).drop("_p", "polygons", "x", "y")
    closed = F.try_element_at("ring", F.lit(1)) == F.try_element_at("ring", F.lit(-1))
    return rows.withColumn("ring", F.when(closed & (F.size("ring") > 1), F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring")))

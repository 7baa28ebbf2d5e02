"""A Spark data source for rasters in GeoTIFF and NumPy files, read and written window by window, with only the wanted bands.

.tif files (``canopy.sources.tiff``) and .npy arrays (bands, height, width) are read by ranges from any file system that
pyarrow knows.  Each window is a partition, and reads its own bytes.  The source writes files of one window
each, ``<path>/<tile>/block_<row>_<col>.npy``; they are read back with the folder as their path and rows and columns of the
whole tile.  ``write_geotiffs`` writes one GeoTIFF a raster: tasks encode blocks, running sums give each block its place in the
file, and the blocks of a file stream into it in order.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from canopy.sources import tiff

BLOCK_NAME = re.compile(r"^(.*)/block_(\d+)_(\d+)\.npy$")


class RasterWindow(InputPartition):
    def __init__(self, path: str, row: int, col: int, height: int, width: int) -> None:
        self.path, self.row, self.col, self.height, self.width = path, row, col, height, width


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


#: Headers are read and windows are put in place so many at a time.
THREADS = 32


def _each(do: Callable, items: list) -> list:
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(do, items))


def _header(f: pa.NativeFile) -> tuple[tuple[int, int, int], np.dtype]:
    """Shape and type of an array; the file is left where its values begin."""
    version = np.lib.format.read_magic(f)
    reading = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = reading(f)
    if fortran or len(shape) != 3:
        raise ValueError("rasters are arrays (bands, height, width) in C order")
    return shape, kind


def _shape(path: str) -> tuple[int, int, int]:
    fs, at = _at(path)
    with fs.open_input_file(at) as f:
        if path.endswith(".npy"):
            return _header(f)[0]
        layout = tiff.read_layout(f)
        return layout.bands, layout.height, layout.width


def _read(part: RasterWindow, bands: list[int]) -> np.ndarray:
    fs, at = _at(part.path)
    with fs.open_input_file(at) as f:
        if not part.path.endswith(".npy"):
            return tiff.read_window(f, tiff.read_layout(f), part.row, part.col, part.height, part.width, bands)
        (_, height, width), kind = _header(f)
        begin = f.tell()
        out = np.empty((len(bands), part.height, part.width), kind)
        whole = part.width == width  # its lines follow each other
        for k, b in enumerate(bands):
            for r in range(1 if whole else part.height):
                f.seek(begin + (((b - 1) * height + part.row + r) * width + part.col) * kind.itemsize)
                lines = part.height if whole else 1
                out[k, r : r + lines] = np.frombuffer(f.read(lines * part.width * kind.itemsize), kind).reshape(lines, part.width)
        return out


def _files(path: str) -> list[str]:
    """A raster itself, or the rasters below a folder in the order of their names; what a write has staged doesn't count."""
    if path.endswith((".npy", ".tif")):
        return [path]
    fs, at = _at(path)
    found = [i.path for i in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if i.is_file and i.path.endswith((".npy", ".tif"))]
    head = path.rstrip("/").removesuffix(at.rstrip("/"))  # the scheme, if there is one
    return [head + f for f in sorted(found) if "/_staged-" not in f]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = [f for p in options["path"].split(",") for f in _files(p)]
        if not self.files:
            raise ValueError(f"no rasters in {options['path']}")
        self.block = int(options.get("block", 512))
        wanted = options.get("bands")
        self.bands = [int(b) for b in wanted.split(",")] if wanted else list(range(1, _shape(self.files[0])[0] + 1))

    def partitions(self) -> list[RasterWindow]:
        out = []
        for path, (_, height, width) in zip(self.files, _each(_shape, self.files), strict=True):
            for r in range(0, height, self.block):
                for c in range(0, width, self.block):
                    out.append(RasterWindow(path, r, c, min(self.block, height - r), min(self.block, width - c)))
        return out

    def read(self, part: RasterWindow) -> Iterator[pa.RecordBatch]:
        data = _read(part, self.bands).astype(np.float64)
        block = BLOCK_NAME.match(part.path)
        name, top, left = (block[1], int(block[2]), int(block[3])) if block else (part.path, 0, 0)
        rows, cols = np.mgrid[top + part.row : top + part.row + part.height, left + part.col : left + part.col + part.width]
        arrays = [pa.array([name] * rows.size), pa.array(rows.ravel(), pa.int32()), pa.array(cols.ravel(), pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(b.ravel()) for b in data], names=["path", "row", "col", *[f"band_{b}" for b in self.bands]])


@dataclass
class Written(WriterCommitMessage):
    """(staged file, its place) of each window that a task has written."""

    files: list[tuple[str, str]]


class RasterWriter(DataSourceArrowWriter):
    """Each task writes whole windows beside the table, under names of its own; they get their places when all tasks are done."""

    def __init__(self, options: dict, names: list[str]) -> None:
        self.path = options["path"].rstrip("/")
        self.block, self.kind, self.fill = int(options.get("block", 512)), np.dtype(options.get("dtype", "float64")), float(options.get("fill", "nan"))
        if np.isnan(self.fill) and self.kind.kind != "f":
            self.fill = 0.0
        self.bands = [n for n in names if n not in ("tile", "row", "col")]
        self.staging = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def _store(self, key: tuple[str, int, int], parts: list[pd.DataFrame]) -> tuple[str, str]:
        cells = pd.concat(parts)
        rows, cols = cells["row"].to_numpy() - key[1], cells["col"].to_numpy() - key[2]
        out = np.full((len(self.bands), rows.max() + 1, cols.max() + 1), self.fill).astype(self.kind)
        for k, b in enumerate(self.bands):
            values = cells[b].to_numpy(dtype=np.float64, na_value=np.nan)
            out[k, rows, cols] = np.where(np.isnan(values), self.fill, values).astype(self.kind)
        staged = f"{self.staging}/{uuid.uuid4().hex}.npy"
        fs, at = _at(staged)
        fs.create_dir(at.rsplit("/", 1)[0])
        with fs.open_output_stream(at) as f:
            np.lib.format.write_array(f, out, allow_pickle=False)
        return staged, f"{self.path}/{key[0]}/block_{key[1]}_{key[2]}.npy"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, key, parts, seen = [], None, [], set()
        for batch in iterator:
            cells = batch.to_pandas()
            corner = [cells["tile"], cells["row"] // self.block * self.block, cells["col"] // self.block * self.block]
            for k, some in cells.groupby(corner, sort=False):
                if k != key:
                    if parts:
                        done.append(self._store(key, parts))
                    if k in seen:
                        raise ValueError("rows of a window must follow each other; use write_rasters")
                    key, parts = k, []
                    seen.add(k)
                parts.append(some)
        if parts:
            done.append(self._store(key, parts))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        def put(one: tuple[str, str]) -> None:
            fs, to = _at(one[1])
            fs.create_dir(to.rsplit("/", 1)[0])
            fs.move(_at(one[0])[1], to)

        _each(put, [one for message in messages if message for one in message.files])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _at(self.staging)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


class RasterSource(DataSource):
    """spark.read.format("raster").option("bands", "1,3").option("block", 512).load(path), a file, files or a folder."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "path string, row int, col int, " + ", ".join(f"band_{b} double" for b in RasterReader(self.options).bands)

    def reader(self, schema: object) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> RasterWriter:
        if overwrite:
            raise ValueError("rasters are written with mode append, which replaces windows of the same place")
        return RasterWriter(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)


def write_rasters(cells: DataFrame, tile: str, bands: list[str], path: str, block: int = 512, dtype: str = "float64", fill: float | None = None) -> None:
    """Cells (tile, row, col, bands) as files of a window each, dealt by windows, so that no tile lies in one task.

    Windows that are there already are replaced, others stay; a run done twice is as one.  A window's file reaches to its last
    row and column with a cell; cells left out in it, and nulls, are ``fill`` (not a number, or 0 for integers).  Rows and
    columns are counted from 0.
    """
    register(cells.sparkSession)
    corner = [F.floor(F.col(c) / block) for c in ("row", "col")]
    dealt = cells.select(F.col(tile).cast("string").alias("tile"), F.col("row").cast("int"), F.col("col").cast("int"), *[F.col(b).cast("double") for b in bands])
    dealt = dealt.repartition("tile", *corner).sortWithinPartitions("tile", *corner)
    writer = dealt.write.format("raster").mode("append").option("block", block).option("dtype", dtype)
    (writer if fill is None else writer.option("fill", fill)).save(path)


COMPRESSIONS = {None: tiff.NONE, "lzw": tiff.LZW, "deflate": tiff.DEFLATE}


def write_geotiffs(
    cells: DataFrame, tile: str, bands: list[str], path: str, block: int = 256, dtype: str = "float32", fill: float = 0.0, compression: str | None = "deflate",
    corner: tuple[float, float] = (0.0, 0.0), size: float = 10.0, epsg: int | None = None,
) -> None:
    """Cells (tile, row, col, bands) as ``<path>/<tile>.tif``, tiled by ``block`` (a multiple of 16).

    corner, size: x and y of the first cell's outer corner, and the cells' width.  A raster reaches to its last row and column
    with a cell; cells left out, and nulls, are ``fill``, and blocks without cells aren't stored.  One
    task writes a file, block by block; blocks are made by all.  Files that are there are replaced whole; what a run has staged goes.
    """
    spark = cells.sparkSession
    kind = np.dtype(dtype).newbyteorder("<")
    tags: dict[int, tuple] = {tiff.PIXEL_SCALE: (size, size, 0.0), tiff.TIE_POINT: (0.0, 0.0, 0.0, *map(float, corner), 0.0), tiff.NO_DATA: (f"{fill:g}\0".encode(),)}
    if epsg:
        tags[tiff.GEO_KEYS] = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)

    def layout(height: int, width: int, counts: list[int]) -> tiff.Layout:
        predictor = 1 if compression is None else 3 if kind.kind == "f" else 2
        return tiff.Layout(int(height), int(width), len(bands), kind, (block, block), COMPRESSIONS[compression], predictor, counts=counts, tags=tags)

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.full((len(bands), block, block), fill).astype(kind)
        for k, b in enumerate(bands):
            values = rows[b].to_numpy(dtype=np.float64, na_value=np.nan)
            gone = np.isnan(values) if kind.kind != "f" else rows[b].isna().to_numpy()
            data[k, rows["row"] % block, rows["col"] % block] = np.where(gone, fill, values).astype(kind)
        return pd.DataFrame({"tile": rows["tile"].iloc[:1], "r": rows["_r"].iloc[:1], "c": rows["_c"].iloc[:1], "rows": rows["row"].max() + 1, "cols": rows["col"].max() + 1, "data": [tiff.encoded(data, layout(0, 0, []))]})

    dealt = cells.select(F.col(tile).cast("string").alias("tile"), F.col("row").cast("int"), F.col("col").cast("int"), *[F.col(b).cast("double") for b in bands])
    dealt = dealt.withColumns({"_r": F.floor(F.col("row") / block).cast("int"), "_c": F.floor(F.col("col") / block).cast("int")})
    staging = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    schema = "tile string, r int, c int, rows int, cols int, data binary"
    dealt.groupBy("tile", "_r", "_c").applyInPandas(encode, schema).write.parquet(staging)
    blocks = spark.read.schema(schema).parquet(staging)

    @F.pandas_udf(T.BinaryType())
    def head(height: pd.Series, width: pd.Series, stored: pd.Series) -> pd.Series:
        out = []
        for h, w, some in zip(height, width, stored, strict=True):
            across = -(-w // block)
            counts = [0] * (across * -(-h // block))
            for x in some:
                counts[x["r"] * across + x["c"]] = x["n"]
            out.append(tiff.header(layout(h, w, counts)))
        return pd.Series(out)

    one = F.collect_list(F.struct("r", "c", F.length("data").alias("n")))
    shapes = blocks.groupBy("tile").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), one.alias("stored"))
    heads = shapes.select("tile", F.lit(-1).alias("r"), F.lit(0).alias("c"), head("rows", "cols", "stored").alias("data"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, done = None, None, []

        def end() -> None:
            if f is not None:
                f.close()
                fs, to = _at(f"{path.rstrip('/')}/{name}.tif")
                fs.move(_at(f"{staging}/{name}-{mark}")[1], to)
                done.append(name)

        for batch in batches:
            for tile_name, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if tile_name != name:
                    end()
                    name, mark = tile_name, uuid.uuid4().hex
                    fs, at = _at(f"{staging}/{name}-{mark}")
                    f = fs.open_output_stream(at)
                f.write(data.as_buffer())
        end()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["tile"])

    try:
        heads.unionByName(blocks.select("tile", "r", "c", "data")).repartition("tile").sortWithinPartitions("tile", "r", "c").mapInArrow(put, "tile string").write.format("noop").mode("overwrite").save()
    finally:
        fs, at = _at(staging)
        fs.delete_dir(at)

"""Token counts from flat token files without an index, by scanning for separators.

A flat token file is a row of unsigned little-endian ids; a document ends with the separator id.  Files are
cut into blocks of bytes that tasks read and search for separators at once in NumPy; a prefix scan over the
blocks of a file, one narrow row for each, tells how many documents end before a block and where its first
document begins, and the documents are then made where their block is read.

Writing: each task writes files of its own under new names and reports them with the ids in their order, so
what a lost or repeated task attempt has written is named by no row.  Tokenizing treats strings of special
tokens as ordinary text.  The files lie in the shared folder and are reached through ``pyarrow.fs``.

Rows: null and empty texts are documents of no tokens; texts are taken whole; repeated rows are documents of
their own; an empty table makes no file and gives an empty result; empty files hold no document; ids after the
last separator of a file are one more document; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.batches import id_and_text, slices, tidy
from canopy.llm.store import drop, drop_path, new_path, save

FILE_TOKENS, BLOCK_TOKENS = 32_000_000, 2_000_000
#: Documents of a block leave a task in batches of so many rows.
BATCH_ROWS = 100_000

_OPEN: dict[str, object] = {}


def byte_encoder(path: str, pattern: str):
    """A tiktoken encoding without special tokens, opened once per Python worker."""
    if path not in _OPEN:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _OPEN[path] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path]


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    separator: int,
    dtype: str = "<u2",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all documents; (file, bytes, ordinal, doc_id) of every document."""
    folder = new_path(docs.sparkSession, "tokens")
    end = np.array([separator], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer, pattern)
        file, out, size, ids = "", None, 0, []

        def close() -> pa.RecordBatch:
            out.close()
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n), pa.array([size] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64())],
                names=["file", "bytes", "ordinal", "doc_id"],
            )

        for some, texts in slices(batches):
            for doc_id, text in zip(some, texts, strict=True):
                if out is None:
                    file, size, ids = f"{folder}/{uuid.uuid4().hex}.bin", 0, []
                    store, path = fs.FileSystem.from_uri(file)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                tokens = np.array(encoder.encode_ordinary(text), dtype).tobytes() + end
                out.write(tokens)
                size += len(tokens)
                ids.append(doc_id)
                if size >= FILE_TOKENS * len(end):
                    yield close()
                    out = None
        if out is not None:
            yield close()

    written = id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "file string, bytes long, ordinal long, doc_id long")
    order = save(written, "token-order")
    order._token_folder = folder
    return order


def _read_ids(file: str, size: int, at: int, step: int, dtype: str) -> np.ndarray:
    if size % np.dtype(dtype).itemsize:
        raise ValueError(f"{file} doesn't hold whole ids: {size} bytes")
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at(min(step, size - at), at), dtype)


def scan_token_files(files: DataFrame, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in files (file, bytes), without its separator.

    Blocks are read twice: for the number of separators and the place of the last, which is one narrow row a block
    that the prefix scan takes, and then for the documents that end in the block, whose first one it has told.
    """
    spark, width = files.sparkSession, np.dtype(dtype).itemsize
    step = block_tokens * width
    blocks = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("at"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, last = [], []
            for file, size, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = np.flatnonzero(_read_ids(file, size, at, step, dtype) == separator)
                ends.append(len(found))
                last.append(int(found[-1]) + at // width if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64()), pa.array(last, pa.int64())], names=["file", "bytes", "at", "ends", "last"])

    counted = blocks.repartition(tasks, "file", "at").mapInArrow(tidy(count), "file string, bytes long, at long, ends long, last long")
    # the prefix scan
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.select(
        "file", "bytes", "at", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("begin")
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at, ordinal, begin in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                stops = np.flatnonzero(_read_ids(file, size, at, step, dtype) == separator) + at // width
                # ids behind a file's last separator are a document whose end is the end of the file
                if at + step >= size and (stops[-1] + 1 if len(stops) else begin) < size // width:
                    stops = np.append(stops, size // width)
                starts = np.concatenate(([begin], stops[:-1] + 1))[: len(stops)]
                for k in range(0, len(stops), BATCH_ROWS):
                    part = slice(k, k + BATCH_ROWS)
                    n = len(stops[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]).take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(n) + (ordinal + k)), pa.array(starts[part]), pa.array(stops[part] - starts[part])],
                        names=["file", "ordinal", "start", "n_tokens"],
                    )

    return known.repartition(tasks, "file", "at").mapInArrow(tidy(documents), "file string, ordinal long, start long, n_tokens long")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the flat files in a folder, as Spark's file listing has them."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    )


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document, read back from flat files, which are deleted when they are counted."""
    order = write_token_files(docs, tokenizer, pattern, separator, "<u2", id_col, text_col)
    files = order.select("file", "bytes").distinct()
    # a merge join: the rows of a block are estimated as one, so they must not be broadcast on that estimate
    counts = order.select("file", "ordinal", "doc_id").join(scan_token_files(files, separator).hint("merge"), ["file", "ordinal"])
    counted = save(counts.select("doc_id", "n_tokens"), "token-counts")
    drop_path(docs.sparkSession, order._token_folder)
    drop(order)
    return counted

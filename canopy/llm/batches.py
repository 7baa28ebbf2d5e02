"""Small helpers for functions that run on Arrow batches of documents."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows go to Python in batches of so many bytes, as texts may be long (one row at least).
BATCH_BYTES = 8 << 20
#: Python objects of so many characters of text are alive at a time (one document at least).
SLICE_CHARS = 1_000_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives the memory that it freed back to the system, as it lives on for later tasks.

    Arrow takes its memory from the C library, which can be told to give it back.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may not have it
            if trim:
                trim(0)

    return wrapped


def slices(batches: Iterable[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of a few documents at a time; columns 0 and 1."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py() or ""
            if ids and size + len(text) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(batch.column(0)[k].as_py())
            texts.append(text)
            size += len(text)
        if ids:
            yield ids, texts


def text_column(kind: str, values: Callable[[list[str]], list]):
    """A column function of a text: ``values`` of a few texts (null: empty) at a time, as Arrow values of ``kind``.

    Only the text goes to Python, whatever the other columns of the rows.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            out = []
            for _, part in slices([pa.RecordBatch.from_arrays([pa.nulls(len(some)), some], names=["id", "text"])]):
                out += values(part)
            yield pa.array(out, KINDS[kind])

    def wrapped(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(run)(texts)

    # not deterministic: so that a filter on the column doesn't compute it once more
    return F.arrow_udf(wrapped, kind).asNondeterministic()


#: Kinds of text columns.
KINDS = {"double": pa.float64(), "boolean": pa.bool_()}


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, so that the scan reads no more."""
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Encoded:
    """Token ids, as bytes, of chunks of text that are encoded independently of each other.

    At most ``entries`` chunks are kept; when there are more, they are forgotten and encoded anew.
    """

    def __init__(self, encode: Callable[[list], list[bytes]], entries: int = 300_000) -> None:
        self.encode, self.entries, self.kept = encode, entries, {}

    def forget(self) -> None:
        """Give the memory back: workers live on after a task."""
        self.kept = {}

    def join(self, chunks_of: list[list]) -> list[bytes]:
        """The ids of each list of chunks."""
        new = set().union(*chunks_of).difference(self.kept)
        if len(self.kept) + len(new) > self.entries:
            self.kept.clear()
            new = set().union(*chunks_of)
        if new:
            chunks = list(new)
            self.kept.update(zip(chunks, self.encode(chunks), strict=True))
        get = self.kept.__getitem__
        return [b"".join(map(get, chunks)) for chunks in chunks_of]

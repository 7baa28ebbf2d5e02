"""Tables that cut lineage, kept in the folder which all executors share.

The folder is the one named in ``spark.checkpoint.dir``.  Only where that setting is missing, and only
on a local master (as in tests), a folder of this machine is used.

Operators delete the tables that they have read for the last time themselves.  The tables that their result is
still read from are deleted by whoever has read the result: what is saved in a ``with scratch():`` block is
deleted at its end, but for the tables that are handed to ``keep``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Paths saved in each scratch block that is open, the innermost last.
_BLOCKS: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/canopy/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, without its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    if _BLOCKS:
        _BLOCKS[-1].add(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is saved in this block at its end."""
    _BLOCKS.append(set())
    try:
        yield
    finally:
        for path in sorted(_BLOCKS.pop()):
            drop_path(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """``df``, a saved table, which outlives the innermost block."""
    path = getattr(df, "_saved_path", None)
    if _BLOCKS:
        _BLOCKS[-1].discard(path)
        if len(_BLOCKS) > 1:
            _BLOCKS[-2].add(path)
    return df


def drop(df: DataFrame) -> None:
    """Delete a saved table whose rows nobody needs any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        for block in _BLOCKS:
            block.discard(path)
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

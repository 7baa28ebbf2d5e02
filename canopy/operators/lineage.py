"""Cutting the lineage of loops, by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without one, on a local master only, a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read back; the tables ``done``, earlier ones that nobody reads any more, go."""
    path = f"{shared_folder(df.sparkSession)}/canopy-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    release(*done)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written; others are left alone."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

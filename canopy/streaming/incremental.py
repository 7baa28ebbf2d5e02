"""Incremental runs: what has arrived since the last run goes into a table, region by region.

The workflows have no streams; this is their resumable batch, for which a stream with an ``availableNow`` trigger and a
checkpoint keeps the state that scripts keep in files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.sources.tables import merge_partitions


def run_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: str, key: list[str], change: Callable[[DataFrame], DataFrame] = lambda df: df, order: list[str] = ()) -> None:
    """Read the Parquet files that are new since the checkpoint, change them, and merge them into the target by key.

    Rows of earlier files stay unless a new one has their key, whatever its region; of a batch's rows of one key the last by ``order`` counts; a batch that is run again after a failure changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        merge_partitions(change(batch), target, by, key, order)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

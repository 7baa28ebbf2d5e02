"""Running sums, ranks and numbers of groups of any size.

Rows are dealt by ranges of group and order and written with the number of their part; a sum runs inside each part,
and the parts' totals, a row for each group in a part, do the rest.  So no group needs to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.lineage import cut
from canopy.operators.quantiles import _same

#: At most so many rows are numbered in one task, with equal results.
WINDOW_ROWS = 1_000_000


def _before(amount: str, group: list, order: list[str]) -> Column:
    """Sum over the rows of a group that stand before."""
    rows = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(rows), F.lit(0))


def running(df: DataFrame, by: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the group that stand before; rows differ in (by, order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum"))
    starts = sums.select(*by, "_part", _before("_sum", by or [F.lit(1)], ["_part"]).alias("_start"))  # without groups a row a part
    out = _same(dealt.withColumn("_inside", _before(amount, [*by, "_part"], order)), starts, [*by, "_part"])
    return out.withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_part")


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rank): the rank of each value in its group from 1, the mean one for ties; without nulls.

    Equal values are counted first, so a value that very many rows have is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running(counts, by, [value], "_n", "_first").select(*by, value, (F.col("_first") + (F.col("_n") + 1) / 2).alias("rank"))


def numbered(values: DataFrame, order: list[str], name: str) -> DataFrame:
    """``values``, whose rows differ in ``order``, with their number from 0."""
    one = values.withColumn("_one", F.lit(1).cast("long"))
    if values.count() <= WINDOW_ROWS:
        return one.withColumn(name, _before("_one", [F.lit(1)], order)).drop("_one")
    return running(one, [], order, "_one", name).drop("_one")

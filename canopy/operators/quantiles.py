"""Exact quantiles of groups of any size: no group's values meet in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that a group's values are cut into; only those that hold a wanted rank are sorted.
PIECES = 64


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys in which null is a key like others; the keys of ``a`` stay."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    renamed = b.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys))
    return a.join(renamed, on, how).drop(*[f"_{k}_" for k in keys])


#: Groups of at most so many values are put in order by one task each.
SMALL = 1_000_000


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, q): values at each share, in the order of ``shares``, linear between neighbours; groups without values are left out.

    Groups are counted first: small ones go through one aggregation, larger ones in pieces, with equal results.
    """
    some = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    large = some.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > SMALL).select(*by, F.lit(1).alias("_large"))
    if large.isEmpty():
        return _at_once(some, by, shares)
    if not by:
        return _in_pieces(some, by, shares)
    return _at_once(_same(some, large, by, "left_anti"), by, shares).unionByName(_in_pieces(_same(some, large, by).drop("_large"), by, shares))


def _at_once(some: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    out = some.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    return out.filter("n > 0")


def _in_pieces(some: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, n, q) of the values (by, _v).

    Equal values are counted first.  Rough percentiles cut the values of a group into pieces; counts of pieces say which of them
    hold the wanted ranks, and only these are put in order.  Without ``by``, one row, or none.
    """
    cuts = some.groupBy(*by).agg(F.percentile_approx("_v", [k / PIECES for k in range(1, PIECES)]).alias("_cuts"))
    counts = some.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    placed = _same(counts, cuts, by).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    group = by or [F.lit(1)]  # without groups there are at most PIECES rows
    pieces = placed.groupBy(*by, "_piece").agg(F.sum("_n").alias("_m"))
    pieces = pieces.withColumns({"_end": F.sum("_m").over(Window.partitionBy(*group).orderBy("_piece")), "n": F.sum("_m").over(Window.partitionBy(*group))})
    at = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    needed = pieces.withColumns({"_begin": F.col("_end") - F.col("_m"), "_ranks": ranks})
    needed = needed.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_begin")) & (r < F.col("_end")))).filter(F.size("_ranks") > 0)
    inside = _same(placed, needed.drop("_m", "_end"), [*by, "_piece"])
    upto = F.sum("_n").over(Window.partitionBy(*by, "_piece").orderBy("_v")) + F.col("_begin")
    picked = inside.withColumn("_upto", upto).withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))))
    found = picked.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks a share

    def between(x: Column) -> Column:
        low, high = (F.col("_at")[f(x).cast("long")] for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return found.select(*by, "n", F.array(*[between(x) for x in at]).alias("q"))


def with_quantiles(summary: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``summary`` (by, ...) with a column for each share; groups without values have nulls."""
    q = quantiles(df, by, value, list(shares.values())).select(*by, *[F.col("q")[k].alias(name) for k, name in enumerate(shares)])
    return _same(summary, q, by, "left") if by else summary.join(F.broadcast(q), how="left")

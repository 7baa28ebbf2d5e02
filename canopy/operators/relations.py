"""Joins, codes and top rows, as the workflows use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import finite
from canopy.operators.ranks import numbered
from canopy.schemas import require_unique


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, missing: str = "Unknown") -> DataFrame:
    """``df`` with ``value`` from the table (key, value); misses get ``missing``."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of tables whose keys are checked to be unique on both sides."""
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """A join in which columns of the same name get suffixes."""
    same = [c for c in left.columns if c in right.columns and c not in keys]
    a, b = (t.withColumnsRenamed({c: c + s for c in same}) for t, s in zip((left, right), suffixes, strict=True))
    return a.join(b, keys, how)


def with_context(left: DataFrame, context: DataFrame, keys: list[str], suffix: str = "_ctx") -> DataFrame:
    """``left`` with the columns of a context table, whose keys are checked to be unique; columns that both have keep the left one's name, the context's gets the suffix."""
    same = {c: c + suffix for c in context.columns if c in left.columns and c not in keys}
    return left.join(require_unique(context, keys).withColumnsRenamed(same), keys, "left")


def first_of_group(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, value): the first value of each group by ``order`` that isn't null; groups without one are left out."""
    return df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.min_by(value, F.struct(*order, value)).alias(value))


def left_joins(base: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """All tables joined to the base in turn."""
    return reduce(lambda df, t: df.join(t, key, "left"), tables, base)


def full_with_zeros(left: DataFrame, right: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    return left.join(right, keys, "full_outer").fillna(0, zeros)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key has no new row."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of the columns hold finite numbers."""
    return df.withColumns({c: finite(F.col(c)) for c in columns}).na.drop(subset=columns)


def codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values from 1 in their order, without null."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return numbered(values, [column], "code").withColumn("code", (F.col("code") + 1).cast("int"))


def top_in_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def widened(ranked: DataFrame, group: list[str], columns: list[str], n: int) -> DataFrame:
    """One row for each group: top1_<column>, top2_<column>, ... by ``rank``."""
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return ranked.groupBy(*group).agg(*[at(k, c).alias(f"top{k}_{c}") for k in range(1, n + 1) for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values by how often they occur; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())


def listed_first(column: str, names: list[str]) -> list[Column]:
    """Sort keys: the listed names in their order, then the rest by name."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return [F.when(place > 0, place).otherwise(len(names) + 1), F.col(column).asc_nulls_last()]


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b) of the keys of either side."""
    a, b = (t.select(key).distinct().withColumn(n, F.lit(True)) for t, n in ((left, "in_a"), (right, "in_b")))
    return a.join(b, key, "full_outer").fillna(False, ["in_a", "in_b"])


def positional(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The i-th key of one side with the i-th of the other, in their order; without one, with the first."""

    def placed(t: DataFrame, key: str) -> DataFrame:
        return numbered(t.select(key).distinct(), [key], "i").withColumn("i", (F.col("i") + 1).cast("int"))

    b = placed(right, right_key)
    first = b.filter("i = 1").select(F.col(right_key).alias("_first"))
    out = placed(left, left_key).join(b, "i", "left").crossJoin(F.broadcast(first))
    return out.select("i", left_key, F.coalesce(right_key, "_first").alias(right_key))


def with_enough_pixels(tiles: DataFrame, least: float, percent: str = "perc", pixels: int = 62500) -> DataFrame:
    """Tiles whose labelled share makes at least so many pixels."""
    return tiles.filter(F.col(percent) / 100 * pixels >= least)


def year_suffixed(df: DataFrame, key: str, year: int) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{year}" for c in df.columns if c != key})


def spreads(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Differences high - low under new names, where both columns are there."""
    return df.withColumns({n: F.col(high) - F.col(low) for n, (high, low) in pairs.items() if high in df.columns and low in df.columns})


def merged_metrics(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, relative): two tables of metrics side by side, with the difference relative to the first in percent."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.withColumn("relative", 100 * (F.col("b") - F.col("a")) / F.nullif(F.abs("a"), F.lit(0.0)))

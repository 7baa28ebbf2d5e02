"""Polygons burnt into rasters by scan lines.

Each side of a ring crosses the lines through the centres of some rows of cells; sorted by row and place, every second
crossing begins a span of cells whose centres lie inside.  That is an expression on the polygon's row, in proportion
to its sides and crossings, without a test for each cell.  Spans meet cells by row and block of columns, in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.geo import _edges

#: Columns of a block in which spans and cells meet.
BLOCK = 256


def _from(value: Column, origin: float, size: float) -> Column:
    """Index of the first cell whose centre isn't before a coordinate; the rounding of the division is put right by comparing centres."""
    k = F.ceil((value - origin) / size - 0.5)
    centre = lambda i: origin + (i + 0.5) * size
    return F.when(centre(k - 1) >= value, k - 1).when(centre(k) < value, k + 1).otherwise(k)


def spans(polygons: DataFrame, size: float = 1.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The polygons' columns but for ``ring``, and (row, first, last): the runs of cells whose centres lie inside."""
    ends = lambda e: (F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def crossings(e: Column) -> Column:
        low, high = (_from(v, origin[1], size) for v in ends(e))
        place = lambda r: (e["x2"] - e["x1"]) * (origin[1] + (r + 0.5) * size - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        rows = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(rows, lambda r: F.struct(r.alias("row"), place(r).alias("x")))

    every = F.array_sort(F.flatten(F.transform(_edges(F.col("ring")), crossings)))
    crossed = polygons.withColumn("_cross", every)

    def span(k: Column) -> Column:
        a, b = F.col("_cross")[(2 * k).cast("int")], F.col("_cross")[(2 * k + 1).cast("int")]
        return F.struct(a["row"].alias("row"), _from(a["x"], origin[0], size).alias("first"), (_from(b["x"], origin[0], size) - 1).alias("last"))

    many = F.floor(F.size("_cross") / 2)
    pairs = F.transform(F.when(many > 0, F.sequence(F.lit(0).cast("bigint"), many - 1)), span)
    return crossed.select(*[c for c in polygons.columns if c != "ring"], F.inline(pairs)).filter("first <= last")


def burnt(
    cells: DataFrame, polygons: DataFrame, values: dict[str, str], order: list[str], size: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), background: int = 0
) -> DataFrame:
    """``cells`` (row, col, ...) with new columns (name -> the polygons' column): of the polygon that holds the cell's centre, of several the last by ``order``; none: background."""
    own = polygons.select("ring", F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c).alias(f"v{k}") for k, c in enumerate(values.values())]).alias("_own"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    placed = spans(own, size, origin).withColumn("_block", F.explode(F.sequence(block("first"), block("last"))))
    lines = placed.groupBy("row", "_block").agg(F.sort_array(F.collect_list(F.struct("_own", "first", "last")), asc=False).alias("_spans"))
    lines = lines.withColumnsRenamed({"row": "_row", "_block": "_at"})
    met = cells.withColumn("_block", block("col")).join(lines, (F.col("row") == F.col("_row")) & (F.col("_block") == F.col("_at")), "left")
    hit = F.get(F.filter("_spans", lambda s: (s["first"] <= F.col("col")) & (F.col("col") <= s["last"])), F.lit(0))
    found = met.withColumn("_hit", hit)
    return found.select(*cells.columns, *[F.coalesce(F.col(f"_hit._own.v{k}"), F.lit(background)).alias(name) for k, name in enumerate(values)])

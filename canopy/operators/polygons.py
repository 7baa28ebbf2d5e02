"""Polygons against polygons and boxes: candidates by an equi-join on grid cells, then exact tests on the rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.geo import _cells, _edges, bounds, contains

_BOX = ("xmin", "ymin", "xmax", "ymax")


def _turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def sides_meet(a: Column, b: Column) -> Column:
    """Whether two sides have a point in common, ends included."""
    turns = lambda s, t: (_turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]), _turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"]))
    (p, q), (r, s) = turns(a, b), turns(b, a)
    overlap = lambda c: (F.least(a[f"{c}1"], a[f"{c}2"]) <= F.greatest(b[f"{c}1"], b[f"{c}2"])) & (F.least(b[f"{c}1"], b[f"{c}2"]) <= F.greatest(a[f"{c}1"], a[f"{c}2"]))
    return (p * q <= 0) & (r * s <= 0) & overlap("x") & overlap("y")


def _near(ring: Column, box: str) -> Column:
    """The sides of a ring that may reach a box."""
    low, high = (lambda e, c: F.least(e[f"{c}1"], e[f"{c}2"])), (lambda e, c: F.greatest(e[f"{c}1"], e[f"{c}2"]))
    get = lambda k: F.col(f"{box}.{k}")
    return F.filter(_edges(ring), lambda e: (low(e, "x") <= get("xmax")) & (high(e, "x") >= get("xmin")) & (low(e, "y") <= get("ymax")) & (high(e, "y") >= get("ymin")))


def rings_meet(a: str, b: str) -> Column:
    """Whether two polygons (structs a and b: ring and the bounds) share a point: sides meet, or one holds the other."""
    ring = lambda s: F.col(f"{s}.ring")
    first = lambda s: (ring(s)[0]["x"], ring(s)[0]["y"])
    sides = F.exists(_near(ring(a), b), lambda p: F.exists(_near(ring(b), a), lambda q: sides_meet(p, q)))
    return sides | contains(ring(b), *first(a)) | contains(ring(a), *first(b))


def _tiled(df: DataFrame, cell: float, s: str) -> DataFrame:
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias(s))
    return rows.withColumn(f"_x{s}", F.explode(_cells(F.col(f"{s}.xmin"), F.col(f"{s}.xmax"), cell))).withColumn(f"_y{s}", F.explode(_cells(F.col(f"{s}.ymin"), F.col(f"{s}.ymax"), cell)))


def _box_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a, b): pairs of rows whose bounds meet, each pair once: in the first grid cell that both lie in."""
    get = lambda s, k: F.col(f"{s}.{k}")
    first = lambda k, n: F.greatest(F.floor(get("a", k) / cell), F.floor(get("b", k) / cell)) == F.col(n)
    meet = (get("a", "xmin") <= get("b", "xmax")) & (get("b", "xmin") <= get("a", "xmax")) & (get("a", "ymin") <= get("b", "ymax")) & (get("b", "ymin") <= get("a", "ymax"))
    on = (F.col("_xa") == F.col("_xb")) & (F.col("_ya") == F.col("_yb")) & first("xmin", "_xa") & first("ymin", "_ya") & meet
    return _tiled(a, cell, "a").join(_tiled(b, cell, "b"), on).select("a", "b")


def bounded(polygons: DataFrame) -> DataFrame:
    return polygons.withColumns(bounds(F.col("ring")))


def intersecting(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(id_a, id_b) of the polygons (id_a, ring) and (id_b, ring) that touch or overlap, each pair once.

    Equal rings are tested once; then each pair of rings becomes the pairs of those that have them.
    """
    pairs = _box_pairs(bounded(a.select("ring").distinct()), bounded(b.select("ring").distinct()), cell).filter(rings_meet("a", "b"))
    rings = pairs.select(F.col("a.ring").alias("ring"), F.col("b.ring").alias("_other"))
    one = a.select("id_a", "ring").join(rings, "ring").select("id_a", F.col("_other").alias("ring"))
    return one.repartition("id_a").join(b.select("id_b", "ring"), "ring").select("id_a", "id_b")  # dealt anew, as a row becomes many


def _half(ring: Column, axis: str, bound: Column, least: bool) -> Column:
    """The part of a ring on one side of a line across an axis, the line included."""
    other = "y" if axis == "x" else "x"
    inside = lambda v: v >= bound if least else v <= bound

    def part(e: Column) -> Column:
        a, b = inside(e[f"{axis}1"]), inside(e[f"{axis}2"])
        share = (bound - e[f"{axis}1"]) / F.nullif(e[f"{axis}2"] - e[f"{axis}1"], F.lit(0.0))
        at = {axis: bound, other: e[f"{other}1"] + share * (e[f"{other}2"] - e[f"{other}1"])}
        cut = F.struct(at["x"].cast("double").alias("x"), at["y"].cast("double").alias("y"))
        end = F.struct(e["x2"].cast("double").alias("x"), e["y2"].cast("double").alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(a & b, F.array(end)).when(a & ~b, F.array(cut)).when(~a & b, F.array(cut, end)).otherwise(none)

    return F.flatten(F.transform(_edges(ring), part))


def clipped(polygons: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """The columns of polygons (ring, ...) and boxes (xmin, ymin, xmax, ymax, ...), a row for each pair that overlaps, with the ring's part in the box.

    One half plane after the other is cut off; a concave ring may get sides that run along the box and back, which hold no area.
    """
    pairs = _box_pairs(bounded(polygons), boxes, cell).withColumn("ring", F.col("a.ring"))
    for axis in "xy":
        pairs = pairs.withColumn("ring", _half(F.col("ring"), axis, F.col(f"b.{axis}min"), True))
        pairs = pairs.withColumn("ring", _half(F.col("ring"), axis, F.col(f"b.{axis}max"), False))
    own = [F.col(f"a.{c}") for c in polygons.columns if c != "ring"]
    return pairs.filter(F.size("ring") >= 3).select(*own, *[F.col(f"b.{c}") for c in boxes.columns], "ring")

"""Map projections in closed form: Lambert conformal conic and transverse Mercator, forth and back, as column expressions.

The formulas are those of the geodesists' public guidance notes; each also works on plain numbers (``on=math``), for corners of boxes.
Coordinates are degrees and metres; datums aren't shifted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.raster import cropped

_STEPS = 6  # of the inverse latitude, each of which adds more than two digits


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening

    @property
    def e(self) -> float:
        return math.sqrt(2 * self.f - self.f**2)


GRS80, WGS84 = Ellipsoid(6378137.0, 298.257222101), Ellipsoid(6378137.0, 298.257223563)


@dataclass(frozen=True)
class LambertConic:
    """Two standard parallels (degrees)."""

    ellipsoid: Ellipsoid
    lat_origin: float
    lon_origin: float
    parallels: tuple[float, float]
    false_east: float
    false_north: float

    def _t(self, lat: Any, on: ModuleType) -> Any:
        e = self.ellipsoid.e
        s = on.sin(lat)
        return on.tan(math.pi / 4 - lat / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    def _constants(self) -> tuple[float, float, float]:
        """Exponent, scale and radius of the origin."""
        e = self.ellipsoid.e
        p1, p2, origin = (math.radians(v) for v in (*self.parallels, self.lat_origin))
        m = [math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in (p1, p2)]
        t = [self._t(p, math) for p in (p1, p2)]
        n = (math.log(m[0]) - math.log(m[1])) / (math.log(t[0]) - math.log(t[1])) if p1 != p2 else math.sin(p1)
        scale = self.ellipsoid.a * m[0] / (n * t[0] ** n)
        return n, scale, scale * self._t(origin, math) ** n

    def forward(self, lon: Any, lat: Any, on: ModuleType = F) -> tuple[Any, Any]:
        n, scale, origin = self._constants()
        r, turn = scale * self._t(on.radians(lat), on) ** n, n * on.radians(lon - self.lon_origin)
        return self.false_east + r * on.sin(turn), self.false_north + origin - r * on.cos(turn)

    def inverse(self, x: Any, y: Any, on: ModuleType = F) -> tuple[Any, Any]:
        n, scale, origin = self._constants()
        east, north, e, sign = x - self.false_east, origin - (y - self.false_north), self.ellipsoid.e, math.copysign(1, n)
        t = (sign * on.sqrt(east**2 + north**2) / scale) ** (1 / n)
        lat = math.pi / 2 - 2 * on.atan(t)
        for _ in range(_STEPS):
            s = e * on.sin(lat)
            lat = math.pi / 2 - 2 * on.atan(t * ((1 - s) / (1 + s)) ** (e / 2))
        return on.degrees(on.atan2(sign * east, sign * north) / n) + self.lon_origin, on.degrees(lat)


@dataclass(frozen=True)
class TransverseMercator:
    """By the series in the third flattening, to its fourth power."""

    ellipsoid: Ellipsoid
    lat_origin: float
    lon_origin: float
    scale: float
    false_east: float
    false_north: float

    def _series(self) -> tuple[float, list[float], list[float]]:
        n = self.ellipsoid.f / (2 - self.ellipsoid.f)
        radius = self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        to = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
        back = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
        return radius, to, back

    def _conformal(self, lat: Any, on: ModuleType) -> Any:
        e = self.ellipsoid.e
        return on.atan(on.sinh(on.asinh(on.tan(lat)) - e * on.atanh(e * on.sin(lat))))

    def _origin(self) -> float:
        """Length of the meridian from the equator to the origin."""
        radius, to, _ = self._series()
        start = self._conformal(math.radians(self.lat_origin), math)
        return radius * (start + sum(h * math.sin(2 * (k + 1) * start) for k, h in enumerate(to)))

    def forward(self, lon: Any, lat: Any, on: ModuleType = F) -> tuple[Any, Any]:
        radius, to, _ = self._series()
        beta, turn = self._conformal(on.radians(lat), on), on.radians(lon - self.lon_origin)
        eta = on.atanh(on.cos(beta) * on.sin(turn))
        xi = on.asin(on.sin(beta) * on.cosh(eta))
        east = eta + sum(h * on.cos(2 * (k + 1) * xi) * on.sinh(2 * (k + 1) * eta) for k, h in enumerate(to))
        north = xi + sum(h * on.sin(2 * (k + 1) * xi) * on.cosh(2 * (k + 1) * eta) for k, h in enumerate(to))
        return self.false_east + self.scale * radius * east, self.false_north + self.scale * (radius * north - self._origin())

    def inverse(self, x: Any, y: Any, on: ModuleType = F) -> tuple[Any, Any]:
        radius, _, back = self._series()
        eta, xi, e = (x - self.false_east) / (radius * self.scale), (y - self.false_north + self.scale * self._origin()) / (radius * self.scale), self.ellipsoid.e
        xi0 = xi - sum(h * on.sin(2 * (k + 1) * xi) * on.cosh(2 * (k + 1) * eta) for k, h in enumerate(back))
        eta0 = eta - sum(h * on.cos(2 * (k + 1) * xi) * on.sinh(2 * (k + 1) * eta) for k, h in enumerate(back))
        beta = on.asin(on.sin(xi0) / on.cosh(eta0))
        q = on.asinh(on.tan(beta))
        full = q
        for _ in range(_STEPS):
            full = q + e * on.atanh(e * on.tanh(full))
        return on.degrees(on.asin(on.tanh(eta0) / on.cos(beta))) + self.lon_origin, on.degrees(on.atan(on.sinh(full)))


# Parameters of coordinate systems by their public codes.
LAMBERT_93 = LambertConic(GRS80, 46.5, 3.0, (44.0, 49.0), 700_000.0, 6_600_000.0)
SYSTEMS: dict[int, LambertConic | TransverseMercator] = {2154: LAMBERT_93} | {
    base + zone: TransverseMercator(WGS84, 0.0, zone * 6 - 183.0, 0.9996, 500_000.0, north) for base, north in ((32600, 0.0), (32700, 10_000_000.0)) for zone in range(1, 61)
}
GEOGRAPHIC = 4326


def projected(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one system (2154, 326xx, 327xx or 4326: longitude and latitude) in another."""
    if source == target:
        return x, y
    lon, lat = (x, y) if source == GEOGRAPHIC else SYSTEMS[source].inverse(x, y)
    return (lon, lat) if target == GEOGRAPHIC else SYSTEMS[target].forward(lon, lat)


def reprojected(df: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with its coordinates in another system."""
    # one step after the other, so that a step's result is computed once
    steps = [(source, GEOGRAPHIC), (GEOGRAPHIC, target)] if GEOGRAPHIC not in (source, target) else [(source, target)]
    for a, b in steps:
        to = projected(F.col(x), F.col(y), a, b)
        df = df.withColumns({x: to[0], y: to[1]})
    return df


def looks_geographic(df: DataFrame, x: str = "x", y: str = "y") -> bool:
    """Whether all coordinates are within the degrees of the earth, whatever the layer says of its system; one pass."""
    inside = (F.abs(x) <= 180) & (F.abs(y) <= 90)
    return bool(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.every(inside)).first()[0])


def corners_box(box: tuple[float, float, float, float], system: int) -> tuple[float, float, float, float]:
    """The box (xmin, ymin, xmax, ymax) of a system around the four corners of one in degrees."""
    corners = [SYSTEMS[system].forward(x, y, math) for x in (box[0], box[2]) for y in (box[1], box[3])]
    xs, ys = zip(*corners, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def cropped_to_degrees(cells: DataFrame, box: tuple[float, float, float, float], system: int, size: float, origin: tuple[float, float]) -> DataFrame:
    """The cells that the corners of a box in degrees span, with rows and columns from its corner."""
    return cropped(cells, corners_box(box, system), size, origin)


def warped(cells: DataFrame, source: DataFrame, columns: list[str], systems: tuple[int, int], grids: tuple[tuple[float, float, float], tuple[float, float, float]]) -> DataFrame:
    """Cells (row, col, ...) of a grid in one system with the columns of the source cell, in another system, that holds their centre.

    systems: of the cells and of the source; grids: (x and y of the first corner, width of a cell) of either.  Nearest resampling is
    arithmetic on the cell's own row, so both rasters meet in one equi-join; cells outside the source get nulls.
    """
    (x0, y0, size), (sx, sy, source_size) = grids
    placed = cells.withColumns({"_x": x0 + (F.col("col") + 0.5) * size, "_y": y0 + (F.col("row") + 0.5) * size})
    placed = reprojected(placed, *systems, "_x", "_y")
    placed = placed.withColumns({"_r": F.floor((F.col("_y") - sy) / source_size), "_c": F.floor((F.col("_x") - sx) / source_size)})
    found = source.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), *columns)
    return placed.join(found, ["_r", "_c"], "left").drop("_r", "_c", "_x", "_y")

"""Projections as columns: each has forward(lat, lon) to metres and inverse(x, y) to degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geodesy

# WGS 84.
_A, _F = 6378137.0, 1 / 298.257223563
#: A UTM zone whose series the general Transverse Mercator borrows.
_ZONE = 32631


@dataclass(frozen=True)
class Geographic:
    """x is the longitude, y the latitude."""

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return lon, lat

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return y, x


@dataclass(frozen=True)
class WebMercator:
    """The sphere's Mercator that web maps use; null at the poles."""

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        inside = F.when(F.abs(lat) < 90, lat)
        return _A * F.radians(lon), _A * F.asinh(F.tan(F.radians(inside)))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(F.atan(F.sinh(y / _A))), F.degrees(x / _A)


@dataclass(frozen=True)
class TransverseMercator:
    """Of any meridian, scale and false origin, on WGS 84; a UTM zone by its defaults. North counts from the latitude `parallel`."""

    meridian: float
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    parallel: float = 0.0

    def _rise(self) -> float:
        return self.north - geodesy.place(self.parallel, geodesy.zone(_ZONE)[0], _ZONE)[1] / 0.9996 * self.scale

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        x, y = geodesy.to_utm(lat, lon - self.meridian + geodesy.zone(_ZONE)[0], _ZONE)
        return (x - 500_000.0) / 0.9996 * self.scale + self.east, y / 0.9996 * self.scale + self._rise()

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        lat, lon = geodesy.from_utm((x - self.east) / self.scale * 0.9996 + 500_000.0, (y - self._rise()) / self.scale * 0.9996, _ZONE)
        return lat, lon - geodesy.zone(_ZONE)[0] + self.meridian


@dataclass(frozen=True)
class LambertConformal:
    """A cone through two parallels, with the origin at (parallel, meridian)."""

    first: float
    second: float
    parallel: float
    meridian: float
    east: float = 0.0
    north: float = 0.0
    axis: float = _A
    flattening: float = _F

    @property
    def _e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, its scale in metres and the radius of the origin's parallel."""
        e = self._e

        def psi(lat: float) -> float:
            s = math.sin(math.radians(lat))
            return math.atanh(s) - e * math.atanh(e * s)

        def m(lat: float) -> float:
            return math.cos(math.radians(lat)) / math.sqrt(1 - (e * math.sin(math.radians(lat))) ** 2)

        one = self.first == self.second
        n = math.sin(math.radians(self.first)) if one else math.log(m(self.first) / m(self.second)) / (psi(self.second) - psi(self.first))
        size = self.axis * m(self.first) * math.exp(n * psi(self.first)) / n
        return n, size, size * math.exp(-n * psi(self.parallel))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        n, size, origin = self._cone()
        s = F.sin(F.radians(lat))
        r = size * F.exp(-n * (F.atanh(s) - self._e * F.atanh(self._e * s)))
        turn = n * F.radians(lon - self.meridian)
        return self.east + r * F.sin(turn), self.north + origin - r * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, size, origin = self._cone()
        sign = math.copysign(1.0, n)
        dx, dy = x - self.east, origin - (y - self.north)
        psi = -F.log(F.sqrt(dx * dx + dy * dy) / abs(size)) / n
        chi = F.atan(F.sinh(psi))
        m = self.flattening / (2 - self.flattening)
        # The series from the conformal latitude, to the fourth order.
        series = [2 * m - 2 * m**2 / 3 - 2 * m**3 + 116 * m**4 / 45, 7 * m**2 / 3 - 8 * m**3 / 5 - 227 * m**4 / 45, 56 * m**3 / 15 - 136 * m**4 / 35, 4279 * m**4 / 630]
        lat = chi
        for j, d in enumerate(series, 1):
            lat = lat + d * F.sin(2 * j * chi)
        return F.degrees(lat), self.meridian + F.degrees(F.atan2(sign * dx, sign * dy) / n)


def of(epsg: int):
    """The projection of an EPSG code: 4326, 3857, UTM zones of WGS 84 and ETRS89, and the conformal cones of Europe (3034) and France (2154)."""
    if epsg == 4326:
        return Geographic()
    if epsg == 3857:
        return WebMercator()
    if epsg == 3034:
        return LambertConformal(35.0, 65.0, 52.0, 10.0, 4_000_000.0, 2_800_000.0)
    if epsg == 2154:
        return LambertConformal(49.0, 44.0, 46.5, 3.0, 700_000.0, 6_600_000.0)
    if 25828 <= epsg <= 25838:
        epsg += 32600 - 25800
    meridian, north = geodesy.zone(epsg)
    return TransverseMercator(meridian, north=north)


def reprojected(rows: DataFrame, x: str, y: str, source, target) -> DataFrame:
    """rows with columns x and y turned from one projection to another. Degrees are columns in between, so that no expression is spelled out inside another."""
    lat, lon = source.inverse(F.col(x), F.col(y))
    rows = rows.withColumns({"_lat": lat, "_lon": lon})
    to_x, to_y = target.forward(F.col("_lat"), F.col("_lon"))
    return rows.withColumns({x: to_x, y: to_y}).drop("_lat", "_lon")

"""Geodesy and angles as column expressions: Transverse Mercator by Krueger's series, poses, tiles, spheres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and the UTM grid.
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
EARTH = 6371000.0

_n = _F / (2 - _F)
_R = _A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
# Coefficients of the series, forward to the fifth order and back to the fourth.
_ALPHA = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880, 49561 * _n**4 / 161280 - 179 * _n**5 / 168, 34729 * _n**5 / 80640,
]
_BETA = [_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280]
_DELTA = [2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630]


def zone(epsg: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing of a UTM zone's EPSG code."""
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"EPSG {epsg} is not a UTM zone of WGS 84")
    return (epsg % 100) * 6 - 183.0, 0.0 if epsg < 32700 else 10_000_000.0


def to_utm(lat: Column, lon: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    meridian, north = zone(epsg)
    k = 2 * math.sqrt(_n) / (1 + _n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    dl = F.radians(lon - meridian)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, up = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        up = up + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _R * east, north + _K0 * _R * up


def from_utm(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    meridian, false_north = zone(epsg)
    xi, eta = (north - false_north) / (_K0 * _R), (east - _E0) / (_K0 * _R)
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), meridian + F.degrees(F.atan2(F.sinh(e), F.cos(x)))


def place(lat: float, lon: float, epsg: int) -> tuple[float, float]:
    """Easting and northing of one place, on the driver."""
    meridian, north = zone(epsg)
    k, sine, dl = 2 * math.sqrt(_n) / (1 + _n), math.sin(math.radians(lat)), math.radians(lon - meridian)
    t = math.sinh(math.atanh(sine) - k * math.atanh(k * sine))
    xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
    east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    up = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _E0 + _K0 * _R * east, north + _K0 * _R * up


def origin(lat: float, lon: float, alt: float, epsg: int) -> dict:
    """An origin for local metres: lat, lon, alt, epsg and its easting and northing, which are worked out once."""
    east, north = place(lat, lon, epsg)
    return {"lat": lat, "lon": lon, "alt": alt, "epsg": epsg, "east": east, "north": north}


def to_local(lat: Column, lon: Column, alt: Column, origin: dict, epsg: int) -> tuple[Column, Column, Column]:
    """Metres from an origin (lat, lon, alt)."""
    e, n = to_utm(lat, lon, epsg)
    e0, n0 = to_utm(F.lit(origin["lat"]), F.lit(origin["lon"]), epsg)
    return e - e0, n - n0, alt - origin["alt"]


def from_local(x: Column, y: Column, z: Column, origin: dict, epsg: int) -> tuple[Column, Column, Column]:
    e0, n0 = to_utm(F.lit(origin["lat"]), F.lit(origin["lon"]), epsg)
    return *from_utm(x + e0, y + n0, epsg), z + origin["alt"]


def convergence(lat: Column, lon: Column, epsg: int) -> Column:
    """Angle in degrees of true north on the grid, negative east of the central meridian: where a step of 1 m north leads."""
    m = _A * (1 - _F * (2 - _F)) / F.pow(1 - _F * (2 - _F) * F.pow(F.sin(F.radians(lat)), F.lit(2.0)), F.lit(1.5))
    e0, n0 = to_utm(lat, lon, epsg)
    e1, n1 = to_utm(lat + F.degrees(1 / m), lon, epsg)
    return F.degrees(F.atan2(e1 - e0, n1 - n0))


def wrapped(angle: Column) -> Column:
    """The angle between 0 and 360 degrees."""
    return F.pmod(angle, F.lit(360.0))


def gimbal_to_rotation(pitch: Column, roll: Column, yaw: Column, offset: float = 0.0) -> tuple[Column, Column, Column]:
    """Tilt (0 looks down), roll and heading."""
    return wrapped(pitch + 90), roll, wrapped(yaw + offset)


def rotation_to_gimbal(tilt: Column, roll: Column, heading: Column) -> tuple[Column, Column, Column]:
    return F.pmod(tilt - 90 + 180, F.lit(360.0)) - 180, roll, heading


def shortest_turn(a: Column, b: Column) -> Column:
    """From angle a to b the short way, in degrees."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def offset_point(x: Column, y: Column, d: Column, theta: Column) -> tuple[Column, Column]:
    return x + d * F.cos(theta), y + d * F.sin(theta)


def destination(lat: Column, lon: Column, metres: Column, bearing: Column) -> tuple[Column, Column]:
    """Where a great circle of the sphere leads."""
    d, b, p, q = metres / EARTH, F.radians(bearing), F.radians(lat), F.radians(lon)
    end = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(end), F.degrees(q + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(end)))


def frame_corners(lat: Column, lon: Column, heading: Column, w: Column, h: Column) -> list[tuple[Column, Column]]:
    """Corners of a frame of w by h metres around a point: top left, top right, bottom right, bottom left."""
    d = F.sqrt(w * w + h * h) / 2
    a = F.degrees(F.atan2(w, h))
    return [destination(lat, lon, d, wrapped(heading + t)) for t in (-a, a, 180 - a, 180 + a)]


def truncated(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10.0**digits) / 10.0**digits


def to_dms(decimal: Column) -> Column:
    """Degrees, minutes and seconds of the value without its sign."""
    a = F.abs(decimal)
    m = (a - F.floor(a)) * 60
    return F.struct(F.floor(a).alias("deg"), F.floor(m).alias("min"), ((m - F.floor(m)) * 60).alias("sec"))


def from_dms(deg: Column, minute: Column, sec: Column, ref: Column) -> Column:
    return F.when(ref.isin("S", "W"), -1.0).otherwise(1.0) * (deg + minute / 60 + sec / 3600)


def to_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    x = F.floor((lon + 180) / 360 * n)
    return x, F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)


def from_tile(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360 - 180


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))

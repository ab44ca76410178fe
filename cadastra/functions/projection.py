"""Transverse Mercator zones and web Mercator, as columns and as arrays: the public series in the third flattening, to its sixth power.

Longitudes and latitudes are degrees, eastings and northings metres. The two geographic systems in use lie on spheroids that are equal
to a tenth of a millimetre, and are taken as one.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The spheroid of 1980, and what zones have in common.
RADIUS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_E = (FLATTENING * (2 - FLATTENING)) ** 0.5
_RECTIFIED = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_POWERS = [_N**k for k in range(1, 7)]
# Coefficients of the powers of the third flattening from the first on, for each multiple of the angle.
_FORTH = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360], [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600], [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840], [0, 0, 0, 0, 0, 212378941 / 319334400],
]
_BACK = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720], [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600], [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680], [0, 0, 0, 0, 0, 20648693 / 638668800],
]
FORTH, BACK = ([sum(c * p for c, p in zip(row, _POWERS)) for row in table] for table in (_FORTH, _BACK))

_COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, sinh=F.sinh, cosh=F.cosh, arcsinh=F.asinh, arctanh=F.atanh, arctan2=F.atan2, arctan=F.atan, sqrt=F.sqrt, radians=F.radians, degrees=F.degrees, log=F.log, tan=F.tan, exp=F.exp)


def _names(x: object) -> object:
    """The functions for a value: columns' or arrays'."""
    return _COLUMNS if isinstance(x, Column) else np


def _series(m: object, c: list[float], xi: object, eta: object, sign: int) -> tuple:
    a, b = xi, eta
    for k, w in enumerate(c, 1):
        a, b = a + sign * w * m.sin(2 * k * xi) * m.cosh(2 * k * eta), b + sign * w * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
    return a, b


def meridian(zone: int) -> float:
    """The central meridian of a zone of six degrees."""
    return 6.0 * zone - 183


def to_zone(lon: object, lat: object, zone: int, south: bool = True) -> tuple:
    """(easting, northing) of longitude and latitude in a zone, for columns or arrays."""
    m = _names(lat)
    phi, lam = m.radians(lat), m.radians(lon - meridian(zone))
    t = m.sinh(m.arctanh(m.sin(phi)) - _E * m.arctanh(_E * m.sin(phi)))
    xi, eta = m.arctan2(t, m.cos(lam)), m.arcsinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
    xi, eta = _series(m, FORTH, xi, eta, 1)
    return EAST + SCALE * _RECTIFIED * eta, SOUTH * south + SCALE * _RECTIFIED * xi


def from_zone(east: object, north: object, zone: int, south: bool = True) -> tuple:
    """(longitude, latitude) of easting and northing in a zone, for columns or arrays."""
    m = _names(east)
    xi, eta = _series(m, BACK, (north - SOUTH * south) / (SCALE * _RECTIFIED), (east - EAST) / (SCALE * _RECTIFIED), -1)
    lam = m.arctan2(m.sinh(eta), m.cos(xi))
    want = m.sin(xi) / m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi))

    def nearer(t: object) -> object:
        """A step of Newton's method for the latitude's tangent."""
        root = m.sqrt(1 + t * t)
        s = m.sinh(_E * m.arctanh(_E * t / root))
        have = t * m.sqrt(1 + s * s) - s * root
        return t + (want - have) / m.sqrt(1 + have * have) * (1 + (1 - _E**2) * t * t) / ((1 - _E**2) * root)

    if isinstance(east, Column):  # a fold, so that the expression doesn't grow with each step
        t = F.aggregate(F.sequence(F.lit(1), F.lit(4)), want, lambda t, _: nearer(t))
    else:
        t = want
        for _ in range(4):
            t = nearer(t)
    return m.degrees(lam) + meridian(zone), m.degrees(m.arctan(t))


def to_web(lon: object, lat: object) -> tuple:
    """Web Mercator of longitude and latitude."""
    m = _names(lat)
    return RADIUS * m.radians(lon), RADIUS * m.log(m.tan(np.pi / 4 + m.radians(lat) / 2))


def from_web(x: object, y: object) -> tuple:
    m = _names(x)
    return m.degrees(x / RADIUS), m.degrees(2 * m.arctan(m.exp(y / RADIUS)) - np.pi / 2)


def between(x: object, y: object, source: int, target: int) -> tuple:
    """Coordinates of one system in another, by their registered numbers; ValueError for a system that isn't known."""
    if source == target:
        return x, y
    return _system(target)[1](*_system(source)[0](x, y))


def _system(number: int) -> tuple:
    """(to degrees, from degrees) of a system: 4283, 4326 and 7844 in degrees, 3857, zones 283xx and 78xx (south), 326xx (north), 327xx (south)."""
    if number in (4283, 4326, 7844):
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if number == 3857:
        return from_web, to_web
    group, zone = divmod(number, 100)
    south = {283: True, 78: True, 327: True, 326: False}.get(group)
    if south is None or not 1 <= zone <= 60:
        raise ValueError(f"the reference system {number} is not known")
    return (lambda x, y: from_zone(x, y, zone, south)), (lambda x, y: to_zone(x, y, zone, south))

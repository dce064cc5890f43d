"""Transverse Mercator grid (EPSG:3116) to WGS84 as column expressions.

Krüger's series in the third flattening n, to order n^4 (Karney, "Transverse Mercator with an
accuracy of a few nanometers", J. Geodesy 85, 2011). No UDF: the whole inverse is arithmetic that
stays inside code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid GRS80 and the parameters of the national grid.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
ORIGIN_LAT = 4.59620041666667
ORIGIN_LON = -74.0775079166667
FALSE_EASTING = 1_000_000.0
FALSE_NORTHING = 1_000_000.0

_F = 1 / INVERSE_FLATTENING
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)

# Series coefficients; row j holds the factors of n^j, n^(j+1), ... up to n^4.
ALPHA = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
BETA = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
DELTA = ((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _series(rows) -> list[float]:
    return [sum(c * _N ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, start=1)]


def _conformal(lat: float) -> float:
    s = math.sin(lat)
    return math.atan(math.sinh(math.atanh(s) - _E * math.atanh(_E * s)))


def to_grid(lat: float, lon: float) -> tuple[float, float]:
    """(northing, easting) of one point in degrees; used to check the inverse."""
    chi = _conformal(math.radians(lat))
    dlon = math.radians(lon - ORIGIN_LON)
    xi0 = math.atan2(math.tan(chi), math.cos(dlon))
    eta0 = math.asinh(math.sin(dlon) / math.hypot(math.tan(chi), math.cos(dlon)))
    a = _series(ALPHA)
    xi = xi0 + sum(c * math.sin(2 * j * xi0) * math.cosh(2 * j * eta0) for j, c in enumerate(a, 1))
    eta = eta0 + sum(c * math.cos(2 * j * xi0) * math.sinh(2 * j * eta0) for j, c in enumerate(a, 1))
    return FALSE_NORTHING + _RADIUS * (xi - _XI_ORIGIN), FALSE_EASTING + _RADIUS * eta


_CHI0 = _conformal(math.radians(ORIGIN_LAT))
_XI_ORIGIN = _CHI0 + sum(c * math.sin(2 * j * _CHI0) for j, c in enumerate(_series(ALPHA), 1))


def from_grid(northing: Column, easting: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of grid coordinates in metres."""
    xi = (northing - FALSE_NORTHING) / _RADIUS + _XI_ORIGIN
    eta = (easting - FALSE_EASTING) / _RADIUS
    xi1, eta1 = xi, eta
    for j, b in enumerate(_series(BETA), 1):
        xi1 = xi1 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta1 = eta1 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_series(DELTA), 1):
        lat = lat + F.lit(d) * F.sin(chi * (2 * j))
    lon = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lat), F.degrees(lon) + ORIGIN_LON

"""Transverse Mercator and pixel keys in UTM zones as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the UTM scale.
A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)


def utm_zone(lon) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1))


def utm(lon, lat) -> tuple[Column, Column]:
    """Easting and northing in the zone of the point, by Krueger's series to the third order (under a millimetre)."""
    dl = F.radians(lon - (utm_zone(lon) * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + SCALE * _RADIUS * x, F.when(lat < 0, 10000000.0).otherwise(0.0) + SCALE * _RADIUS * y


def from_utm(zone, south, easting, northing) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a zone."""
    xi = (northing - F.when(south, 10000000.0).otherwise(0.0)) / (SCALE * _RADIUS)
    eta = (easting - 500000.0) / (SCALE * _RADIUS)
    p, q = xi, eta
    for j, b in enumerate(_BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    goal = F.sin(p) / F.cosh(q)
    psi, s = F.atanh(goal), goal
    for _ in range(5):  # the isometric latitude is inverted by fixed rounds; each gains over two digits
        s = F.tanh(psi + _E * F.atanh(_E * s))
    return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (zone * 6 - 183), F.degrees(F.asin(s))

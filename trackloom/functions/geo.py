"""Column expressions on positions, times and grids. Angles are degrees, distances metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres.
R = 6371008.8


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * R * F.asin(F.sqrt(a))


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of an origin, on the plane that touches there."""
    return R * F.radians(lon - lon0) * F.cos(F.radians(lat0)), R * F.radians(lat - lat0)


def from_local_xy(x, y, lat0, lon0) -> tuple[Column, Column]:
    return lat0 + F.degrees(y / R), lon0 + F.degrees(x / (R * F.cos(F.radians(lat0))))


def step_metres(lat1, lon1, lat2, lon2) -> Column:
    """Length of a step on the plane at its middle latitude."""
    return F.hypot(R * F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), R * F.radians(lat2 - lat1))


def wrap_angle(a) -> Column:
    """An angle in radians, in [-pi, pi)."""
    return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()


def epoch_s(ts) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def solar_time(t_s, lon) -> dict[str, Column]:
    """Sine and cosine of local solar hour and of the phase of the tropical year, from epoch seconds."""
    hour = F.pmod(F.pmod(t_s, F.lit(86400.0)) / 3600 + lon / 15, F.lit(24.0))
    phase = F.pmod(t_s / 86400, F.lit(365.2422)) / 365.2422
    return {"hour_sin": F.sin(2 * F.pi() * hour / 24), "hour_cos": F.cos(2 * F.pi() * hour / 24), "year_sin": F.sin(2 * F.pi() * phase), "year_cos": F.cos(2 * F.pi() * phase)}


def season(ts) -> Column:
    md = F.month(ts) * 100 + F.dayofmonth(ts)
    return F.when(md.between(401, 630), "spring").when((md >= 1201) | (md <= 315), "winter").otherwise("summer_autumn")


def utm_epsg(lon, lat) -> Column:
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1))
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("long")


def bits(value, first: int, last: int) -> Column:
    """Bits first..last of an integer, both included."""
    if not 0 <= first <= last < 64:
        raise ValueError(f"no bit range {first}..{last}")
    return F.shiftright(value, first).bitwiseAND((1 << (last - first + 1)) - 1)


def hex_cell(x, y, edge: float, rings: int) -> dict[str, Column]:
    """Axial cell (q, r) of a point on a hexagon grid, by cube rounding with halves to even, and whether it is outside."""
    qf, rf = F.lit(3**0.5 / 3) * x / edge - y / (3 * edge), 2 * y / (3 * edge)
    sf = -qf - rf
    q, r, s = F.rint(qf), F.rint(rf), F.rint(sf)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q2 = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    r2 = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return {"q": q2.cast("long"), "r": r2.cast("long"), "outside": F.greatest(F.abs(q2), F.abs(r2), F.abs(q2 + r2)) > rings}

"""Distances and directions on the sphere, as column expressions and SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.sin((p2 - p1) / 2.0) * F.sin((p2 - p1) / 2.0) + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lon2 - lon1) / 2.0) * F.sin(F.radians(lon2 - lon1) / 2.0)
    return F.lit(2.0 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(sin((radians({lat2}) - radians({lat1})) / 2.0::DOUBLE) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2.0::DOUBLE) ** 2)"
    return f"({2.0 * EARTH_M}::DOUBLE * atan2(sqrt({a}), sqrt(greatest(1.0::DOUBLE - {a}, 0.0::DOUBLE))))"


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from the first to the second place, 0 to 360, 0 north."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Difference of two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def cell(x: Column, size: float) -> Column:
    """Number of the grid cell, rounded down."""
    return F.floor(x / size).cast("long")


def truncated_cell(x: Column, size: float) -> Column:
    """Number of the grid cell, rounded towards 0."""
    return (x / size).cast("long")


def project_to_segment(plat: Column, plon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Struct (lat, lon, t) of the nearest place on a segment, in degrees; t from 0 at a to 1 at b."""
    dlat, dlon = blat - alat, blon - alon
    n = dlat * dlat + dlon * dlon
    t = F.when(n < 1e-14, 0.0).otherwise(F.least(F.greatest(((plat - alat) * dlat + (plon - alon) * dlon) / n, F.lit(0.0)), F.lit(1.0)))
    return F.struct((alat + t * dlat).alias("lat"), (alon + t * dlon).alias("lon"), t.alias("t"))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from_deg(u: Column, v: Column) -> Column:
    """The direction that wind comes from."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


CARDINALS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def cardinal(direction: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CARDINALS)), (F.pmod(F.floor((direction + 11.25) / 22.5), F.lit(16)) + 1).cast("int"))


DEG_M = 111_320.0


def right_of(lat: Column, lon: Column, bearing: Column, offset_m: float) -> Column:
    """Struct (lat, lon) of the place so far to the right of a direction of travel."""
    across = F.radians(F.pmod(bearing + 90.0, F.lit(360.0)))
    return F.struct((lat + offset_m * F.cos(across) / DEG_M).alias("lat"), (lon + offset_m * F.sin(across) / (DEG_M * F.cos(F.radians(lat)))).alias("lon"))


def mercator(lat: Column, lon: Column) -> Column:
    """Struct (u, v) of Web Mercator, 0 to 1 over the world."""
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2.0))
    return F.struct(((lon + 180.0) / 360.0).alias("u"), ((1.0 - y / math.pi) / 2.0).alias("v"))


def from_mercator(u: Column, v: Column) -> Column:
    n = math.pi - 2 * math.pi * v
    return F.struct(F.degrees(F.atan(F.sinh(n))).alias("lat"), (u * 360.0 - 180.0).alias("lon"))


def metres_off_line(alat: Column, alon: Column, blat: Column, blon: Column, clat: Column, clon: Column) -> Column:
    """Metres of b from the segment a-c on a plane at a; null if a and c are one place."""
    k = F.cos(F.radians(alat)) * DEG_M
    bx, by, cx, cy = (blon - alon) * k, (blat - alat) * DEG_M, (clon - alon) * k, (clat - alat) * DEG_M
    n = cx * cx + cy * cy
    t = F.least(F.greatest((bx * cx + by * cy) / n, F.lit(0.0)), F.lit(1.0))
    return F.when(n > 1e-6, F.sqrt((bx - cx * t) * (bx - cx * t) + (by - cy * t) * (by - cy * t)))


def bounds_signature(south: Column, west: Column, north: Column, east: Column, eps: float = 1e-4) -> Column:
    """Bounds in steps of eps as a text that tells whether they changed."""
    return F.concat_ws("|", *(F.coalesce(F.floor(x / eps + 0.5).cast("string"), F.lit("nan")) for x in (south, west, north, east)))


def stretch(speed: Column, least: float, most: float, factor: float) -> Column:
    """How far a wind draws a field out: 1 to a factor, smooth between two speeds."""
    t = F.least(F.greatest((speed - least) / (most - least), F.lit(0.0)), F.lit(1.0))
    return 1.0 + (factor - 1.0) * t * t * (3.0 - 2.0 * t)


def drawn_out(dx: Column, dy: Column, wx: Column, wy: Column, factor: Column, upwind: float) -> Column:
    """Square of a distance that counts less along the wind, and less so against it."""
    along, across = dx * wx + dy * wy, dy * wx - dx * wy
    e = along / F.when(along > 0, factor).otherwise(factor * upwind)
    return e * e + across * across


def from_lambert(x: Column, y: Column, *, lat0: float = 25.0, lat1: float = 25.0, lat2: float = 25.0, lon0: float = -95.0, radius: float = 6_371_229.0) -> Column:
    """Struct (lat, lon) of a place on a Lambert conformal grid, on a sphere."""
    f0, f1, f2 = (math.pi / 4 + math.radians(a) / 2 for a in (lat0, lat1, lat2))
    n = math.sin(math.radians(lat1)) if abs(lat1 - lat2) < 1e-9 else math.log(math.cos(math.radians(lat1)) / math.cos(math.radians(lat2))) / math.log(math.tan(f2) / math.tan(f1))
    f = math.cos(math.radians(lat1)) * math.tan(f1) ** n / n
    rho0 = radius * f / math.tan(f0) ** n
    rho = F.lit(math.copysign(1.0, n)) * F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    lat = F.degrees(2.0 * F.atan(F.pow(F.lit(radius * f) / rho, F.lit(1 / n)))) - 90.0
    return F.struct(lat.alias("lat"), (lon0 + F.degrees(F.atan2(x, rho0 - y)) / n).alias("lon"))

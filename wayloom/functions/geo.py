"""Geometry as column expressions: no UDF, all inside whole-stage code generation.

Angles are degrees, points are (lon, lat); ``_m`` is metres, ``_km`` kilometres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
RADIUS_KM = 6367.0


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _to_one(x: Column) -> Column:
    """At most 1, and null where x is: ``least`` would pass over a null and make the distance half the globe."""
    return F.when(x > 1.0, 1.0).otherwise(x)


def spherical_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance by the mean-latitude form."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    mean = F.radians((lat1 + lat2) / 2)
    f = F.pow(F.sin(dlat), 2) * F.pow(F.cos(dlon), 2) + F.pow(F.sin(dlon), 2) * F.pow(F.cos(mean), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(_to_one(f)))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(_to_one(a)))


def euclidean(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def metres_to_degrees(m) -> Column:
    return F.degrees(_col(m) / RADIUS_M)


def speed_kmh(km, seconds) -> Column:
    """0 where no time passes."""
    km, seconds = _col(km), _col(seconds)
    return F.when(seconds > 0, km / (seconds / 3600)).otherwise(0.0)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Compass degrees of the way from the first point to the second."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    b = F.degrees(F.atan2(y, x)) + 360
    return b - 360 * F.floor(b / 360)


def cell_bits(lon, lat, bits: int = 24) -> tuple[Column, Column]:
    """Whole cell numbers of a square grid: x from the west, y from the north, with one step in degrees."""
    lon, lat = _col(lon), _col(lat)
    step = 180.0 / (1 << bits)
    top = (1 << bits) - 1
    x = F.floor((lon + 180) / (2 * step))
    y = F.floor((90 - lat) / step)
    fit = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("long")
    return fit(x), fit(y)


def quadtree_path(lon, lat, depth: int = 16) -> Column:
    """Base-4 key of a point, one digit a level: 2 for south plus 1 for east. A prefix is an ancestor."""
    x, y = cell_bits(lon, lat)
    digits = [(F.shiftright(y, 23 - k).bitwiseAND(F.lit(1)) * 2 + F.shiftright(x, 23 - k).bitwiseAND(F.lit(1))).cast("string") for k in range(depth)]
    return F.concat(*digits)


def geohash_cell(lon, lat, precision: int) -> Column:
    """One number per geohash cell: interleaving is not needed to count distinct cells."""
    n = 5 * precision
    x_bits, y_bits = (n + 1) // 2, n // 2
    x = F.least(F.floor((_col(lon) + 180) / 360 * (1 << x_bits)), F.lit((1 << x_bits) - 1))
    y = F.least(F.floor((_col(lat) + 90) / 180 * (1 << y_bits)), F.lit((1 << y_bits) - 1))
    return (x * (1 << y_bits) + y).cast("long")


def closest_on_segment(ax, ay, bx, by, px, py) -> Column:
    """Planar projection of p on a-b, clamped to its ends, as struct(lon, lat, u); a segment without length gives p."""
    ax, ay, bx, by, px, py = map(_col, (ax, ay, bx, by, px, py))
    size = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    u = F.least(F.greatest(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), size), F.lit(0.0)), F.lit(1.0))
    flat = size == 0
    return F.struct(F.when(flat, px).otherwise(ax + u * (bx - ax)).alias("lon"), F.when(flat, py).otherwise(ay + u * (by - ay)).alias("lat"), F.when(flat, F.lit(None)).otherwise(u).alias("u"))


def point_at(ax, ay, at, bx, by, bt, t) -> Column:
    """The place on the way from a to b at time t, as struct(lon, lat); the way is gone at even speed and t is clamped."""
    ax, ay, at, bx, by, bt, t = map(_col, (ax, ay, at, bx, by, bt, t))
    u = F.coalesce(F.least(F.greatest(F.try_divide(t - at, bt - at), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.struct((ax + u * (bx - ax)).alias("lon"), (ay + u * (by - ay)).alias("lat"))

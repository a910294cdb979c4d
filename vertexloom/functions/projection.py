"""Longitude and latitude to spherical Web Mercator and back, map tiles, query windows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vertexloom.types import Rect

RADIUS = 6_378_137.0
HALF_WORLD = math.pi * RADIUS


def to_mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(RADIUS)


def to_mercator_y(lat: Column) -> Column:
    """Held to the square map: at the poles the edge, not infinity."""
    y = F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.when(lat >= 90.0, F.lit(HALF_WORLD)).when(lat <= -90.0, F.lit(-HALF_WORLD)).otherwise(F.greatest(F.lit(-HALF_WORLD), F.least(F.lit(HALF_WORLD), y)))


def to_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(RADIUS))


def to_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(math.pi / 2))


# Codes that are other names of these two systems
SAME = {900913: 3857, 102100: 3857, 102113: 3857, 3785: 3857, 84: 4326}


def _pair(source: int, target: int):
    source, target = SAME.get(source, source), SAME.get(target, target)
    if source == target:
        return (lambda c: c), (lambda c: c)
    if (source, target) == (4326, 3857):
        return to_mercator_x, to_mercator_y
    if (source, target) == (3857, 4326):
        return to_lon, to_lat
    raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}")


def coordinates_between(xy: Column, source: int, target: int) -> Column:
    """A flat coordinate array in another CRS (4326 and 3857)."""
    if source == target:
        return xy
    fx, fy = _pair(source, target)
    return F.transform(xy, lambda v, i: F.when(i % 2 == 0, fx(v)).otherwise(fy(v)))


def geometry_between(geom: Column, source: int, target: int) -> Column:
    """A geometry struct in another CRS; z, m, ends stay."""
    move = lambda g: coordinates_between(g["xy"], source, target)
    parts = F.transform(geom["parts"], lambda p: p.withField("xy", move(p)))
    return F.when(geom.isNotNull(), geom.withField("xy", move(geom)).withField("parts", parts))


def extent_between(minx: Column, miny: Column, maxx: Column, maxy: Column, source: int, target: int) -> Column:
    """struct<minx, miny, maxx, maxy>: a rectangle in another CRS, null if a bound is null or NaN (such a rectangle holds nothing)."""
    fx, fy = ((lambda c: c),) * 2 if source == target else _pair(source, target)
    whole = ~(F.isnan(minx) | F.isnan(miny) | F.isnan(maxx) | F.isnan(maxy)) & minx.isNotNull() & miny.isNotNull() & maxx.isNotNull() & maxy.isNotNull()
    return F.when(whole, F.struct(fx(minx).alias("minx"), fy(miny).alias("miny"), fx(maxx).alias("maxx"), fy(maxy).alias("maxy")))


def rect_between(rect: Rect, source: int, target: int) -> Rect:
    """The rectangle in another CRS (both axes map monotonically, so corners suffice)."""
    _pair(source, target)
    source, target = SAME.get(source, source), SAME.get(target, target)
    if source == target:
        return rect
    if target == 4326:
        lon = lambda x: math.degrees(x / RADIUS)
        lat = lambda y: math.degrees(2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2)
        return Rect(lon(rect.minx), lat(rect.miny), lon(rect.maxx), lat(rect.maxy))
    x = lambda lon: math.radians(lon) * RADIUS
    y = lambda lat: HALF_WORLD if lat >= 90 else -HALF_WORLD if lat <= -90 else max(-HALF_WORLD, min(HALF_WORLD, RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))))
    return Rect(x(rect.minx), y(rect.miny), x(rect.maxx), y(rect.maxy))


def tile_rect(z: int, x: int, y: int) -> Rect:
    """The Web Mercator square of a map tile (row 0 in the north)."""
    size = 2 * HALF_WORLD / (1 << z)
    return Rect(-HALF_WORLD + x * size, HALF_WORLD - (y + 1) * size, -HALF_WORLD + (x + 1) * size, HALF_WORLD - y * size)


def tile_bbox(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """``tile_rect`` of columns."""
    size = F.lit(2 * HALF_WORLD) / F.pow(F.lit(2.0), z)
    return F.lit(-HALF_WORLD) + x * size, F.lit(HALF_WORLD) - (y + 1) * size, F.lit(-HALF_WORLD) + (x + 1) * size, F.lit(HALF_WORLD) - y * size


def tile_key(z: Column, x: Column, y: Column) -> Column:
    """The tile's coordinates as a JSON list."""
    return F.to_json(F.array(z, x, y))


def buffered(x: Column, y: Column, by: float) -> tuple[Column, Column, Column, Column]:
    """The square reaching ``by`` to all sides of a point."""
    return x - by, y - by, x + by, y + by


def metres_around(lon: Column, lat: Column, width_m: float) -> tuple[Column, Column, Column, Column]:
    """The box of a width in metres around a point in degrees: half of it in latitude, widened in longitude by the cosine."""
    dlat = F.lit(180.0 * width_m / 40_075_017.0)  # the equator's length in metres
    dlon = dlat / F.cos(F.radians(lat))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def inner_square(minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, Column, Column, Column]:
    """The square around a box's centre reaching 0.8 of the smaller half-extent."""
    cx, cy = (minx + maxx) / 2, (miny + maxy) / 2
    return buffered(cx, cy, F.least(maxx - cx, maxy - cy) * 0.8)

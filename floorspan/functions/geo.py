"""Distances, projections and rings as column expressions.

A ring is an array of structs (x, y) without a repeated first point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: WGS84.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_M)


def plane(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a near point."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment in the plane."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)


def ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    e2 = FLATTENING * (2 - FLATTENING)
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(SEMI_MAJOR) / F.sqrt(1 - sin * sin * e2)
    return (n + height) * cos * F.cos(F.radians(lon)), (n + height) * cos * F.sin(F.radians(lon)), (n * (1 - e2) + height) * sin


def to_millimetres(metres: Column) -> Column:
    """Rounded half away from zero."""
    return F.round(metres * 1000).cast("long")


def mercator_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SEMI_MAJOR), F.degrees(F.atan(F.sinh(y / SEMI_MAJOR)))


def edges(ring: Column) -> Column:
    """The ring's edges as structs (ax, ay, bx, by)."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, (i + 1) % n)["x"].alias("bx"), F.get(ring, (i + 1) % n)["y"].alias("by")))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule: a ray to the east crosses the ring an odd number of times."""
    crossed = F.filter(edges(ring), lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return F.size(crossed) % 2 == 1


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: point_segment(px, py, e["ax"], e["ay"], e["bx"], e["by"])))


def ring_area(ring: Column) -> Column:
    """Signed area, positive counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def ring_centroid(ring: Column) -> Column:
    """Area centroid; the mean of the points where the area is 0."""
    a = ring_area(ring)
    part = lambda k, l: F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e[k] + e[l]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 6)  # noqa: E731, E741
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    return F.when(a != 0, F.struct((part("ax", "bx") / a).alias("x"), (part("ay", "by") / a).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def polyline_length(line: Column) -> Column:
    """Sum of the haversine lengths of consecutive (x: lon, y: lat) points."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def rectangle(west: Column, south: Column, east: Column, north: Column) -> Column:
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(west, south), p(east, south), p(east, north), p(west, north))


def in_bounds(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def inner_points(line: Column) -> Column:
    return F.when(F.size(line) > 2, F.slice(line, F.lit(2), F.size(line) - 2)).otherwise(F.slice(line, 1, 0))


def vertical_cost(kind: Column, floors: Column) -> Column:
    """Metres that a change of floors costs."""
    return F.when(kind == "elevator", 15 + floors).when(kind == "escalator", 4 * floors).when(kind == "stairs", 10 * floors)

"""Nearest points and segments, and containment, by grid cells that grow until the answer is certain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspan.session import cut


def closest_point(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The point (x, y) of a segment in the plane that is closest to a point, and its place t from 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return F.struct((x1 + dx * t).alias("x"), (y1 + dy * t).alias("y"), t.alias("t"))


def cells_of(x1: Column, y1: Column, x2: Column, y2: Column, cell: float, around: int = 0) -> Column:
    """The grid cells of a segment's bounds, widened by some cells on each side, as structs (x, y)."""
    side = lambda p, q: F.sequence(F.floor(F.least(p, q) / cell) - around, F.floor(F.greatest(p, q) / cell) + around)
    return F.flatten(F.transform(side(x1, x2), lambda i: F.transform(side(y1, y2), lambda j: F.struct(i.alias("x"), j.alias("y")))))


#: Points that are sent to all segments, and the share of the segments that bounds their distances: one in so many.
FEW, BOUNDING = 256, 64


def nearest_segments(
    points: DataFrame, segments: DataFrame, on: str, point_key: str, segment_key: str, cell: float, k: int = 1, distance: Column | None = None, rim: Callable[[float], Column] = F.lit, part: str | None = None, few_points: int = FEW
) -> DataFrame:
    """The k nearest lines of each point (x, y) within the same ``on``: both sides' columns, near (x, y, t), distance and place.

    A line is a segment (x1, y1, x2, y2), or all segments of one segment_key, of which the nearest counts, the first by
    ``part`` of equals.  Ties go to the lower segment_key; a point whose ``on`` has no segment is left out.  Each round a
    point meets the segments that reach into the nine cells around it, and is done once its k-th distance is at most a
    cell's width, which no other segment can undercut; the others go on with cells four times as wide, at last as wide as
    everything.  ``distance`` may measure the way from (x, y) to near otherwise, and ``rim`` a cell's width.  A few points
    go to all segments instead.
    """
    left = cut(points)
    few = left.count()
    if few <= few_points:
        return _of_few(left, segments, on, point_key, segment_key, k, distance, part)
    segments = cut(segments)
    extent = [segments.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first(), left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()]
    known = [r for r in extent if r[0] is not None]
    size = max((max(r[i + 1] for r in known) - min(r[i] for r in known) for i in (0, 2)), default=0.0)
    columns, extra, done = left.columns, [c for c in segments.columns if c not in (on, segment_key, *left.columns)], None
    plane = _plane()
    while True:
        spread = segments.withColumn("_c", F.explode(cells_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), cell, 1)))
        here = left.withColumn("_c", F.struct(F.floor(F.col("x") / cell).alias("x"), F.floor(F.col("y") / cell).alias("y")))
        pairs = here.join(spread, [on, "_c"]).withColumn("near", closest_point(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))).withColumn("distance", plane if distance is None else distance)
        of_line = Window.partitionBy(point_key, segment_key).orderBy("distance", *([part] if part else []))
        pairs = pairs.withColumn("_first", F.row_number().over(of_line)).filter("_first = 1")
        ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy(point_key).orderBy("distance", segment_key))).filter(F.col("place") <= k)
        last = cell > size
        if not last:
            whole = Window.partitionBy(point_key)
            ranked = ranked.withColumn("_n", F.count("*").over(whole)).withColumn("_far", F.max("distance").over(whole)).filter((F.col("_n") == k) & (F.col("_far") <= rim(cell)))
        found = cut(ranked.select(*columns, segment_key, *extra, "near", "distance", "place"))
        done = found if done is None else done.union(found)
        if last:
            return done
        left = cut(left.join(found.select(point_key).distinct(), point_key, "left_anti").select(columns))
        if left.isEmpty():
            return done
        cell *= 4


def _plane() -> Column:
    return F.sqrt((F.col("x") - F.col("near.x")) * (F.col("x") - F.col("near.x")) + (F.col("y") - F.col("near.y")) * (F.col("y") - F.col("near.y")))


def _of_few(points: DataFrame, segments: DataFrame, on: str, point_key: str, segment_key: str, k: int, distance: Column | None, part: str | None) -> DataFrame:
    """``nearest_segments`` of a few points, which go to all segments.

    A point's k-th distance among a part of the lines bounds that among all; all segments are then looked at, and those within the bound ranked.
    """
    columns, extra = points.columns, [c for c in segments.columns if c not in (on, segment_key, *points.columns)]
    near = lambda few, some: few.join(some, on).withColumn("near", closest_point(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))).withColumn("distance", _plane() if distance is None else distance)
    hashed = F.xxhash64(segment_key)
    met = near(F.broadcast(points), segments.filter(F.pmod(hashed, F.lit(BOUNDING)) == 0)) if not points.isEmpty() else None
    if met is not None:
        # lines of different buckets are different lines
        mins = met.groupBy(F.col(point_key).alias("_p"), F.pmod(F.shiftright(hashed, 20), F.lit(8 * k)).alias("_b")).agg(F.min("distance").alias("_d"))
        place = F.row_number().over(Window.partitionBy("_p").orderBy("_d"))
        bound = cut(mins.withColumn("_k", place).filter(F.col("_k") == k).select("_p", F.col("_d").alias("_most")))
        points = cut(points.join(bound, F.col(point_key) == F.col("_p"), "left").select(*columns, F.coalesce("_most", F.lit(float("inf"))).alias("_most")))
    else:
        points, segments = points.withColumn("_most", F.lit(0.0)), segments.limit(0)
    pairs = near(F.broadcast(points), segments).filter((F.col("distance") <= F.col("_most")) | (F.col("_most") == float("inf")))
    of_line = Window.partitionBy(point_key, segment_key).orderBy("distance", *([part] if part else []))
    ranked = pairs.withColumn("_first", F.row_number().over(of_line)).filter("_first = 1").withColumn("place", F.row_number().over(Window.partitionBy(point_key).orderBy("distance", segment_key))).filter(F.col("place") <= k)
    return cut(ranked.select(*columns, segment_key, *extra, "near", "distance", "place"))


def nearest_segment(points: DataFrame, segments: DataFrame, on: str, point_key: str, cell: float) -> DataFrame:
    """The closest point of any segment of the same ``on``: the point's columns, near_x, near_y and distance."""
    keyed = segments.select(on, "x1", "y1", "x2", "y2", F.struct("x1", "y1", "x2", "y2").alias("_s"))
    found = nearest_segments(points, keyed, on, point_key, "_s", cell)
    return found.select(*points.columns, F.col("near.x").alias("near_x"), F.col("near.y").alias("near_y"), "distance")


def segments_in(points: DataFrame, segments: DataFrame, on: str, point_key: str, cell: float = 16.0) -> DataFrame:
    """The points inside the rings that the segments make, by the even-odd rule: a ray to the east crosses an odd number of them.

    A segment is sent to the rows of cells that it reaches over, and meets the points in them.
    """
    rows = F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))
    spread = segments.filter("y1 <> y2").select(on, "x1", "y1", "x2", "y2", F.explode(rows).alias("_r"))
    met = points.withColumn("_r", F.floor(F.col("y") / cell)).join(spread, [on, "_r"])
    crossed = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    return met.filter(crossed).groupBy(point_key).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(point_key)


def hausdorff(a: DataFrame, b: DataFrame, on: str, cell: float) -> DataFrame:
    """(on, hausdorff): the greatest distance from a point (x, y) of either set to the nearest of the other, within each ``on``.

    Points at the same place have the same distance, so each place is looked at once.
    """
    places = [d.select(on, "x", "y").distinct().withColumn("_k", F.struct(on, "x", "y")) for d in (a, b)]
    there, back = (nearest_segment(p, _as_segments(q, on), on, "_k", cell) for p, q in (places, places[::-1]))
    return there.select(on, "distance").union(back.select(on, "distance")).groupBy(on).agg(F.max("distance").alias("hausdorff"))


def _as_segments(points: DataFrame, on: str) -> DataFrame:
    return points.select(on, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))

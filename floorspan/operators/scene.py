"""Scene geometry: triangles and walls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspan.functions.lookups import quantize
from floorspan.operators import ranges
from floorspan.session import cut, ship

Point = tuple[int, int]


def _turn(a: Point, b: Point, c: Point) -> int:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def ears(ring: list[Point]) -> list[tuple[int, int, int]]:
    """Triangles (indices) of a simple ring in integers, by cutting off convex corners that hold no other point."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    left = list(range(len(ring))) if area >= 0 else list(range(len(ring)))[::-1]
    out = []
    while len(left) > 2:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            if _turn(a, b, c) <= 0:
                continue
            if any(_turn(a, b, ring[p]) >= 0 and _turn(b, c, ring[p]) >= 0 and _turn(c, a, ring[p]) >= 0 for p in left if p not in (i, j, m)):
                continue
            out.append((i, j, m))
            left.pop(k)
            break
        else:  # only flat corners are left
            break
    return out


def triangulate(rings: DataFrame, key: str) -> DataFrame:
    """(key, triangles) of rings (array of [x, y] in millimetres); a triangle has its corners' indices and doubled area."""
    ship(rings.sparkSession)
    kind = rings.schema[key].dataType.simpleString()
    item = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("doubled_area", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for ring in batch.column(1).to_pylist():
                points = [tuple(p) for p in ring or ()]
                done.append([{"a": i, "b": j, "c": m, "doubled_area": _turn(points[i], points[j], points[m])} for i, j, m in ears(points)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(item))], [key, "triangles"])

    return rings.select(key, "ring").mapInArrow(run, f"{key} {kind}, triangles array<struct<a int, b int, c int, doubled_area long>>")


def walls(edges: DataFrame, level: str, wall: str) -> DataFrame:
    """Uses of each wall of a level; one that is used once is an outer wall."""
    return edges.groupBy(level, wall).agg(F.count("*").alias("uses")).withColumn("outer_wall", F.col("uses") == 1)


def batches(triangles: DataFrame, *keys: str) -> DataFrame:
    """One batch for each of the keys: (keys, vertices, triangles, least and greatest corners).

    Corners that are the same point are one vertex.  Corners are struct columns a, b, c of (x, y, z).
    """
    per = triangles.groupBy(*keys).agg(F.count("*").alias("triangles"))
    points = triangles.select(*keys, F.explode(F.array("a", "b", "c")).alias("p"))
    own = points.groupBy(*keys).agg(F.count_distinct("p").alias("vertices"), *[f(F.col(f"p.{k}")).alias(f"{name}_{k}") for name, f in (("least", F.min), ("greatest", F.max)) for k in "xyz"])
    return own.join(per, list(keys))


def quantized(points: DataFrame, key: str) -> DataFrame:
    """Points (key, x, y, z) in 65,535 steps between the bounds of their key."""
    bounds = points.groupBy(key).agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    d = points.join(bounds, key)
    return d.select(*points.columns, *[quantize(F.col(c), F.col(f"_lo{c}"), F.col(f"_hi{c}")).alias(f"q{c}") for c in "xyz"])


#: Vertices that an index of 16 bits can name, and the least size of a normal.
MOST_VERTICES, EPSILON = 65_535, 1.1920929e-07


def facet_normal(a: Column, b: Column, c: Column) -> Column:
    """The unit normal (x, y, z) of a triangle from its winding; up for one without area."""
    u, v = [[q[k] - a[k] for k in "xyz"] for q in (b, c)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    flat = size <= EPSILON
    return F.struct(*[F.when(flat, float(k == "z")).otherwise(x / size).alias(k) for k, x in zip("xyz", n, strict=True)])


def indexed(triangles: DataFrame, keys: list[str], tri_key: str, most: int = MOST_VERTICES) -> tuple[DataFrame, DataFrame]:
    """Batches as vertices (keys, part, place, x, y, z) and triangles (keys, part, tri_key, i, j, k, normal).

    Corners that are the same point of a batch are one vertex, numbered in order by counted ranges.  A batch of more than ``most``
    vertices, or of more than twice as many triangles, goes in parts of as many triangles (in the order of their corners)
    as can't have more.  Triangles are (keys, tri_key, a, b, c) with corners (x, y, z).
    """
    own = triangles.select(*keys, tri_key, "a", "b", "c")
    size = own.select(*keys, F.explode(F.array("a", "b", "c")).alias("v")).groupBy(*keys).agg(F.count_distinct("v").alias("_v")).join(own.groupBy(*keys).agg(F.count("*").alias("_t")), keys)
    each = F.when(F.col("_v") > most, most // 3).otherwise(2 * most)
    crowded = size.filter((F.col("_v") > most) | (F.col("_t") > 2 * most)).select(*keys, each.alias("_each"))
    numbered = ranges.number_within(own.join(crowded, keys), keys, ["a", "b", "c", tri_key], "_n")
    split = numbered.select(*own.columns, F.floor((F.col("_n") - 1) / F.col("_each")).cast("long").alias("part"))
    own = cut(split.unionByName(own.join(crowded, keys, "left_anti").withColumn("part", F.lit(0).cast("long"))))
    batch = [*keys, "part"]
    corners = own.select(*batch, tri_key, F.posexplode(F.array("a", "b", "c")).alias("_at", "v"))
    vertices = cut(ranges.number_within(corners.select(*batch, "v").distinct(), batch, ["v"], "place").withColumn("place", F.col("place") - 1))
    named = corners.join(vertices, [*batch, "v"]).groupBy(*batch, tri_key).agg(*[F.max(F.when(F.col("_at") == n, F.col("place"))).alias(c) for n, c in enumerate("ijk")])
    normals = own.select(*batch, tri_key, facet_normal(F.col("a"), F.col("b"), F.col("c")).alias("normal"))
    return vertices.select(*batch, "place", "v.*"), named.join(normals, [*batch, tri_key])


def decoded(vertices: DataFrame, triangles: DataFrame, keys: list[str], tri_key: str) -> DataFrame:
    """(keys, tri_key, a, b, c): the corners that the indices of batches name."""
    batch = [*keys, "part"]
    d = triangles.select(*batch, tri_key, F.posexplode(F.array("i", "j", "k")).alias("_at", "place"))
    d = d.join(vertices.select(*batch, "place", F.struct("x", "y", "z").alias("v")), [*batch, "place"])
    return d.groupBy(*keys, tri_key).agg(*[F.max(F.when(F.col("_at") == n, F.col("v"))).alias(c) for n, c in enumerate("abc")])

"""Compiled walls and meshes, stack pairing, counted ranges and the streamed reducer against plain versions."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from floorspan.operators import building, changes, ranges, scene, walls
from floorspan.streaming import reducer

# -- walls ------------------------------------------------------------------------------------------


def plain_panels(units, openings, tolerance=200, door=2400):
    sides = defaultdict(list)
    for u, level, ring, height, platform in units:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if a != b:
                sides[(level, *min(a, b), *max(a, b))].append((3000 if height is None else height, platform, u))

    def project(p, k):
        dx, dy = k[3] - k[1], k[4] - k[2]
        return min(max((p[0] - k[1]) * dx + (p[1] - k[2]) * dy, 0), dx * dx + dy * dy)

    def line2(p, k):
        dx, dy = k[3] - k[1], k[4] - k[2]
        return Fraction(((p[0] - k[1]) * dy - (p[1] - k[2]) * dx) ** 2, dx * dx + dy * dy)

    def segment2(p, k):
        dx, dy = k[3] - k[1], k[4] - k[2]
        t = (p[0] - k[1]) * dx + (p[1] - k[2]) * dy
        if t <= 0:
            return Fraction((p[0] - k[1]) ** 2 + (p[1] - k[2]) ** 2)
        if t >= dx * dx + dy * dy:
            return Fraction((p[0] - k[3]) ** 2 + (p[1] - k[4]) ** 2)
        return line2(p, k)

    def at(k, n):
        l2 = (k[3] - k[1]) ** 2 + (k[4] - k[2]) ** 2
        way = lambda a, b: a + (1 if b >= a else -1) * math.floor(Fraction(abs(b - a) * n, l2) + Fraction(1, 2))
        return way(k[1], k[3]), way(k[2], k[4])

    hosted, cuts = {}, defaultdict(list)
    for o, level, p, q in openings:
        own = [k for k in sides if k[0] == level and project(p, k) != project(q, k) and max(line2(p, k), line2(q, k)) <= tolerance**2]
        if not own:
            continue
        h = min(own, key=lambda k: (segment2(p, k) + segment2(q, k), k))
        ends = at(h, min(project(p, h), project(q, h))), at(h, max(project(p, h), project(q, h)))
        if ends[0] == ends[1]:
            continue
        same = lambda k: line2(k[1:3], h) == 0 == line2(k[3:5], h)  # noqa: B023, E731
        all_ = [k for k in own if max(segment2(p, k), segment2(q, k)) <= tolerance**2 or same(k)]
        high = min(door, *(x[0] for k in all_ for x in sides[k]))
        if high > 0:
            hosted[o] = (level, *h[1:], high, *ends[0], *ends[1], len(all_))
            for k in all_:
                cuts[k].append((min(project(p, k), project(q, k)), max(project(p, k), project(q, k)), high))
    out = set()
    for k, own in sides.items():
        height = min(x[0] for x in own)
        if all(x[1] for x in own) or height <= 0:
            continue
        marks = sorted({0, (k[3] - k[1]) ** 2 + (k[4] - k[2]) ** 2, *(m for s, e, _ in cuts[k] for m in (s, e))})
        spans = []
        for s, e in zip(marks, marks[1:]):
            void = max((min(high, height) for a, b, high in cuts[k] if a < e and b > s), default=0)
            if spans and spans[-1][2] == void:
                spans[-1][1] = e
            else:
                spans.append([s, e, void])
        for s, e, void in spans:
            if at(k, s) != at(k, e) and void < height:
                out.add((*k, *at(k, s), *at(k, e), 100 + void, 100 + height))
    return hosted, out


@pytest.mark.parametrize("turn", [(1, 0), (3, 4), (5, -12)])
def test_walls_of_turned_rooms(spark, turn):
    """Rooms in any direction, split sides, openings over several walls, off the wall, overlapping and of different heights."""
    rng = random.Random(turn[0])
    place = lambda x, y: (x * turn[0] - y * turn[1], x * turn[1] + y * turn[0])
    units, openings = [], []
    for i in range(24):
        x, y = i % 6 * 400, i // 6 * 300
        ring = [(x, y), (x + 200, y), (x + 400, y), (x + 400, y + 300), (x, y + 300)] if i % 3 else [(x, y), (x + 400, y), (x + 400, y + 300), (x, y + 300), (x, y + 300)]
        units.append((i, f"L{i % 2 if i > 20 else 0}", [place(*p) for p in ring], rng.choice([None, 900, 2000, 2600]), i % 5 == 0))
        for k in range(3):
            a, w, off = rng.randrange(0, 380), rng.randrange(0, 260), rng.randrange(-40, 40)
            p, q = ((x + a, y + off // 4), (x + a + w, y + off // 5)) if k < 2 else ((x + off // 4, y + a % 250), (x + off // 5, y + a % 250 + w // 2))
            openings.append((i * 3 + k, "L0", place(*p), place(*q)))
    hosted, want = plain_panels(units, openings)
    point = "struct<x: long, y: long>"
    u = spark.createDataFrame([(a, b, [{"x": p[0], "y": p[1]} for p in r], h, f) for a, b, r, h, f in units], f"unit_id long, level_id string, ring array<{point}>, height long, platform boolean")
    d = spark.createDataFrame([(o, level, *p, *q) for o, level, p, q in openings], "opening_id long, level_id string, px long, py long, qx long, qy long")
    sides = walls.sides(u)
    edges = walls.walls(sides)
    found, cuts = walls.host(d, edges)
    got = {r.opening_id: tuple(r)[1:] for r in found.collect()}
    assert got == hosted and 20 < len(got)
    planes = spark.createDataFrame([("L0", 100), ("L1", 100)], "level_id string, z long")
    rows = walls.panels(edges, cuts, planes).collect()
    assert {(r.level_id, r.ax, r.ay, r.cx, r.cy, r.x1, r.y1, r.x2, r.y2, r.bottom, r.top) for r in rows} == want and len(rows) == len(want)
    assert walls.connected_units(cuts, sides).filter("to_unit <= from_unit").count() == 0
    assert walls.panels(edges, cuts.limit(0), planes).count() == edges.filter("not platform").count()


# -- meshes -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [65_535, 12, 3])
def test_index_buffers_name_every_corner(spark, most):
    rng = random.Random(most)
    point = lambda: tuple(float(rng.randrange(4)) for _ in range(3))
    rows = [("a" if i < 90 else "b", i, point(), point(), point()) for i in range(100)] + [("c", 100, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0))]
    kind = "struct<x: double, y: double, z: double>"
    d = spark.createDataFrame(rows, f"batch string, tri long, a {kind}, b {kind}, c {kind}")
    vertices, triangles = scene.indexed(d, ["batch"], "tri", most)
    back = scene.decoded(vertices, triangles, ["batch"], "tri")
    assert sorted((r.batch, r.tri, tuple(r.a), tuple(r.b), tuple(r.c)) for r in back.collect()) == sorted(rows)
    sizes = vertices.groupBy("batch", "part").agg(F.count("*").alias("n"), F.max("place").alias("m"), F.count_distinct("x", "y", "z").alias("d")).collect()
    assert all(r.n == r.m + 1 == r.d <= most for r in sizes) and (len(sizes) > 3) == (most < 65)
    by = {r[1]: r for r in rows}
    for r in triangles.collect():
        a, b, c = by[r.tri][2:]
        u, v = [[q[k] - a[k] for k in range(3)] for q in (b, c)]
        n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        size = math.sqrt(sum(x * x for x in n))
        assert tuple(r.normal) == pytest.approx(tuple(x / size for x in n) if size else (0, 0, 1))


# -- pairing ----------------------------------------------------------------------------------------


def plain_pairs(paths):
    waiting, slots, seen = defaultdict(list), {}, defaultdict(int)
    for place, p, r, a, b in sorted(paths):
        if waiting[r, p, b, a]:
            slot = waiting[r, p, b, a].pop()
            first = slots[slot][0]
            slots[slot] = (place, slot, first, slots[slot][3]) if p < r else (first, slot, place, slots[slot][3])
        else:
            waiting[p, r, a, b].append(place)
            slots[place] = (place, place, None, seen[min(p, r), max(p, r)] > 0)
            seen[min(p, r), max(p, r)] += 1
    return set(slots.values())


@pytest.mark.parametrize("ids", [1, 2, 4])
def test_pairs_are_stacks(spark, ids):
    rng = random.Random(ids)
    rows = [(i, rng.randrange(ids), rng.randrange(ids), rng.randrange(2), rng.randrange(2)) for i in range(400)]
    d = spark.createDataFrame(rows, "place long, path_id long, back_id long, from_id long, to_id long").repartition(5)
    assert {tuple(r) for r in building.pair_paths(d).collect()} == plain_pairs(rows)


# -- ranges -----------------------------------------------------------------------------------------


def test_counted_ranges(spark):
    """One group holds nearly all rows; others are small; null is a group."""
    rng = random.Random(1)
    rows = [(None if i % 90 == 0 else "hot" if i % 10 else f"g{i % 7}", i, rng.choice([None, 1.0, 2.5, 2.5, 7.0, -3.0])) for i in range(3000)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    got = ranges.running(d, ["k"], ["i"], {"n": F.lit(1).cast("long"), "s": F.col("v")}, {"m": F.col("v")})
    want, held = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, s, m = held.get(k, (0, 0.0, None))
        held[k] = n + 1, s + (v or 0.0), v if m is None else m if v is None else max(m, v)
        want[i] = held[k]
    assert {r.i: (r.n, r.s, r.m) for r in got.collect()} == want
    last, expected = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        expected[i] = last.get(k)
        last[k] = v
    assert {r.i: r.b for r in ranges.before(d, ["k"], ["i"], "v", "b").collect()} == expected
    found = {r.k: (r.p50, r.p90, r.mid) for r in ranges.percentiles(d, ["k"], "v", {"p50": "0.5", "p90": "0.9"}, "mid").collect()}
    for k, x in found.items():
        own = sorted(v for g, _, v in rows if g == k and v is not None)
        rank = lambda q: own[math.ceil(Fraction(q) * len(own)) - 1]  # noqa: B023, E731
        assert x == (rank("1/2"), rank("9/10"), (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)
    assert len(found) == len({g for g, _, v in rows})
    assert ranges.percentiles(d.limit(0), ["k"], "v", middle="m").count() == 0


# -- streamed reducer -------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [0, 1, 2])
def test_streamed_reducer_restarts(spark, tmp_path, order):
    """Files in any order, actions repeated, stopped and started again at any file: the end states are the reducer's."""
    rng = random.Random(order)
    rows = [(v, i, rng.choice(["observed", "fetched"]) if v else "observed", rng.randrange(30)) for v in range(8) for i in range(12)]
    batch = changes.reduced(spark.createDataFrame(rows, "version_id long, i long, action string, revision long"), "version_id", "i")
    last = batch.groupBy("version_id").agg(F.max_by(F.struct("observed", "applied", "stale"), "i").alias("x")).select("version_id", "x.*")
    want = {tuple(r) for r in last.collect()}
    rng.shuffle(rows)
    files = [rows[k::5] for k in range(5)] + [rows[:20]]
    rng.shuffle(files)
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "version_id long, i long, action string, revision long"
    for part in files:  # a run each
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if rng.random() < 0.7 or part is files[-1]:
            reducer.reduce(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), folder)
    got = {tuple(r) for r in reducer.last_states(spark.read.parquet(f"{folder}/out")).collect()}
    assert got == want

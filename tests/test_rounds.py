"""Middle lines, references and walls near routes against plain versions."""

import math
import random

from pyspark.sql import functions as F

from floorspan.operators import centerlines, references, walk


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 1500 nodes between two junctions, leaves on them, and a ring apart from all."""
    n = 1500
    edges = [(i, i + 1) for i in range(n)] + [(0, 2000), (0, 2001), (n, 2002), (n, 2003)] + [(3000 + i, 3000 + (i + 1) % 7) for i in range(7)]
    nodes = [(i, 0, float(i), 0.0) for i in range(n + 1)] + [(2000, 0, 0.0, 2.5), (2001, 0, 0.0, -50.0), (2002, 0, float(n), 5.0), (2003, 0, float(n), -5.0)] + [(3000 + i, 0, 9e3 + i, 0.0) for i in range(7)]
    d = spark.createDataFrame([(*p, 0.1 if p[0] == 2002 else 1.0, p[0] == 2003) for p in nodes], "node_id long, floor long, x double, y double, clearance double, endcap boolean")
    e = spark.createDataFrame(edges, "from_id long, to_id long")
    rounds = []
    monkeypatch.setattr(centerlines, "cut", lambda df, real=centerlines.cut: rounds.append(1) or real(df))
    ways = {(r.from_id, r.to_id): (r.end, r.metres, r.steps) for r in centerlines.chain_ends(d, e).collect()}
    assert len(rounds) <= 2 + math.ceil(math.log2(n)) + 2
    assert ways[0, 1] == (n, float(n), n) and ways[700, 699] == (0, 700.0, 700) and ways[2000, 0] == (0, 2.5, 1)
    assert ways[3000, 3001][0] is None and len(ways) == 2 * len(edges)
    gone = {r.tip: r.why for r in centerlines.spurs(d, e).collect()}
    assert gone == {2000: "short", 2002: "wedge"}  # 2003 is as wide as its junction, 2001 is long
    kept, _ = centerlines.pruned(d, e)
    assert kept.count() == len(edges) - 2
    assert centerlines.spurs(d, e.limit(0)).count() == 0


def test_first_links_are_those_taken_in_order(spark):
    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}) + [(100, 101)]
    parent = {i: i for i in range(102)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for a, b in links:
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b))
    d = spark.createDataFrame(links, "lo long, hi long")
    assert {tuple(r) for r in centerlines.spanning(d).collect()} == want
    assert centerlines.spanning(d.limit(0)).count() == 0


def test_references_step_by_step(spark):
    rng = random.Random(5)
    name = lambda: rng.choice([None, *[f"f{i}" for i in range(30)], "gone"])
    rows = [(i, f"f{i % 28}", rng.choice([None, None, None, "L1", "L2"]), name(), name(), [x for x in (name() for _ in range(rng.randrange(4))) if x], rng.choice([None, float(i)])) for i in range(120)]
    schema = "place long, id string, level_id string, unit_id string, anchor_id string, unit_ids array<string>, center double"
    by, level, center, warned = {r[1]: r for r in rows}, {}, {}, []
    for place, _, own, unit, anchor, listed, middle in rows:
        found = own
        if found is None and unit is not None:
            if unit in by:
                found = by[unit][2]
            else:
                warned.append((place, "unit_id", unit))
        if found is None and anchor is not None:
            if anchor not in by:
                warned.append((place, "anchor_id", anchor))
            elif by[anchor][3] is None:
                warned.append((place, "anchor unit_id", anchor))
            elif by[anchor][3] not in by:
                warned.append((place, "unit_id", by[anchor][3]))
            else:
                found = by[by[anchor][3]][2]
        if found is None:
            for x in listed:
                if x not in by:
                    warned.append((place, "unit_ids", x))
                elif by[x][2] is not None:
                    found = by[x][2]
                    break
        level[place] = found
        steps = [middle, *[by[x][6] for x in (anchor, unit, *listed) if x in by]]
        center[place] = next((x for x in steps if x is not None), None)
    d = spark.createDataFrame(rows, schema)
    levels, warnings = references.resolve_levels(d)
    assert {r.place: r.level_id for r in levels.collect()} == level
    assert sorted((r.place, r.reference, r.value) for r in warnings.collect()) == sorted(warned)
    got = references.resolve_centers(d.withColumn("display_point", F.lit(None).cast("double"))).collect()
    assert {r.place: r.center for r in got} == center


def test_points_near_walls_of_turned_areas(spark):
    rng = random.Random(7)
    turn = lambda x, y: (x * 0.6 - y * 0.8, x * 0.8 + y * 0.6)
    ring = [turn(*p) for p in ((0, 0), (12, 0), (12, 7), (6, 9), (0, 7))]
    points = [(i, float(i % 2), *turn(rng.uniform(-2, 14), rng.uniform(-2, 11))) for i in range(300)]
    locks = [(0.0, points[0][2], points[0][3] + 0.1), (0.0, *turn(6, 0))]
    far = lambda p, a, b: math.dist(p, (a[0] + (t := max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2))) * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    want = {i for i, o, x, y in points if o == 0 and min(far((x, y), a, b) for a, b in zip(ring, ring[1:] + ring[:1])) < walk.NEAR_WALL_M and not any(math.dist((x, y), k[1:]) < walk.LOCK_M for k in locks)}
    kind = "ordinal double, part string, ring array<struct<x: double, y: double>>, x double, y double"
    parts = spark.createDataFrame([(0.0, "area", [{"x": x, "y": y} for x, y in ring], None, None), *[(o, "lock", None, x, y) for o, x, y in locks]], kind)
    d = spark.createDataFrame(points, "i long, ordinal double, x double, y double")
    for cell in (0.7, 4.0, 50.0):
        assert {r.i for r in walk.near_walls(d, parts, ["i"], cell=cell).collect()} == want
    assert 20 < len(want) < 120

"""Routes, smoothing, graph building, nearest segments and histories against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from floorspan.functions import lookups
from floorspan.operators import building, changes, nearest, registration, routing, walk
from floorspan.session import cut


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_nearest_segments_by_growing_cells(spark):
    rng = random.Random(4)
    points = [(i, i % 2, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(60)]
    segments = [(k, k % 3, (x := rng.uniform(-400, 400)), (y := rng.uniform(-400, 400)), x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)) for k in range(90)]

    def closest(px, py, s):
        _, _, x1, y1, x2, y2 = s
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - x1 - dx * t, py - y1 - dy * t)

    p = spark.createDataFrame(points, "i long, g long, x double, y double")
    s = spark.createDataFrame(segments, "k long, g long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in nearest.nearest_segments(p, s, "g", "i", "k", 3.0, 3).collect():
        got.setdefault(r.i, {})[r.place] = r.k
    for i, g, x, y in points:
        want = sorted((closest(x, y, q), q[0]) for q in segments if q[1] == g)[:3]
        assert [got[i][j + 1] for j in range(3)] == [k for _, k in want]
    assert nearest.nearest_segments(p.withColumn("g", F.lit(7)), s, "g", "i", "k", 3.0).count() == 0
    assert nearest.nearest_segments(p.limit(0), s, "g", "i", "k", 3.0).count() == 0


def test_smoothing_keeps_to_the_floor():
    hall, hole = square(0, 0, 20, 10), square(8, 3, 4, 4)
    line = [(1.0, 5.0), (4.0, 2.0), (10.0, 1.0), (16.0, 2.0), (19.0, 5.0)]
    assert walk.smoothed(line, [hall], [], []) == [0, 4]
    kept = walk.smoothed(line, [hall], [hole], [])
    assert kept[0] == 0 and kept[-1] == 4 and len(kept) > 2
    assert all(walk.passes(line, a, b, [hall], [hole], []) or b == a + 1 for a, b in zip(kept, kept[1:]))
    assert 2 in walk.smoothed(line, [hall], [], [(10.1, 1.0)])  # a lock beside a point holds it
    assert walk.smoothed(line, [], [], []) == [0, 1, 2, 3, 4]
    assert walk.on_floor([hall], [], 20.2, 5) and not walk.on_floor([hall], [], 20.4, 5)
    assert not walk.on_floor([hall], [hole], 8.1, 3.1) and walk.on_floor([hall], [hole], 7.9, 3.1)


def test_smoothing_of_segments_on_floors(spark):
    point = "array<struct<x: double, y: double>>"
    routes = spark.createDataFrame([(1, 0, 0.0, [(1.0, 5.0), (4.0, 2.0), (19.0, 5.0)]), (1, 1, 5.0, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)])], f"route_id long, segment int, ordinal double, points {point}")
    parts = spark.createDataFrame([(0.0, "area", square(0.0, 0.0, 20.0, 10.0), None, None), (9.0, "lock", None, 1.0, 1.0)], f"ordinal double, part string, ring {point}, x double, y double")
    got = {r.segment: len(r.points) for r in walk.smooth_on_floors(routes, parts).collect()}
    assert got == {0: 2, 1: 3}  # a floor without parts leaves its segments as they are


@pytest.fixture(scope="module")
def line_graph(spark):
    """Two floors: 1 - 2 - 3 on floor 0 with a bend, 3 - 4 up to floor 1; 4 - 5 may be walked one way only."""
    nodes = spark.createDataFrame([("v", 1, 0.0, 0.0, 0.0), ("v", 2, 0.001, 0.0, 0.0), ("v", 3, 0.002, 0.0, 0.0), ("v", 4, 0.002, 0.0, 1.0), ("v", 5, 0.003, 0.0, 1.0)], "venue string, node_id long, lon double, lat double, ordinal double")
    edges = [("v", 0, 1, 2, 60_000.0, 0.0, [(0.0005, 0.0003)], 0), ("v", 1, 2, 3, 55_000.0, 0.0, None, 0), ("v", 2, 3, 4, 5_000.0, 0.0, None, 0), ("v", 3, 4, 5, 55_000.0, 1.0, None, 1)]
    return nodes, spark.createDataFrame(edges, "venue string, edge_id long, from_id long, to_id long, cost double, ordinal double, interior array<struct<lon: double, lat: double>>, direction int")


def test_routes_between_points(spark, line_graph):
    nodes, edges = line_graph
    asked = [(1, 0.0001, 0.0, 0.0, 0.0028, 0.0, 1.0), (2, 0.0028, 0.0, 1.0, 0.0001, 0.0, 0.0), (3, 0.0011, 0.00001, 0.0, 0.0018, 0.00001, 0.0), (4, 0.0022, 0.0, 1.0, 0.0028, 0.0, 1.0), (5, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0), (6, 0.0001, 0.0, 7.0, 0.0019, 0.0, 0.0)]
    requests = spark.createDataFrame([("v", *a) for a in asked], "venue string, request_id long, lon1 double, lat1 double, ordinal1 double, lon2 double, lat2 double, ordinal2 double")
    got = {r.request_id: r for r in cut(routing.route(requests, nodes, edges)).collect()}
    assert 5 not in got  # not finite
    assert 2 not in got  # against the one-way edge
    up = got[1]
    assert up.kind == "network" and list(up.nodes)[-2:] == [3, 4] and up.from_edge == 0 and up.to_edge == 3
    assert [s.ordinal for s in up.segments] == [0.0, 1.0]
    assert up.segments[0].line[-1] == up.segments[1].line[0]  # the junction is in both runs
    assert got[3].kind == "direct" and got[3].from_edge == got[3].to_edge == 1 and abs(got[3].cost - 55_000 * 0.7) < 100
    assert got[4].kind == "direct" and abs(got[4].cost - 55_000 * 0.6) < 100
    assert got[6].from_edge == 0  # a floor without edges: the nearest of all
    assert routing.route(requests.limit(0), nodes, edges).count() == 0


def test_route_geometry_helpers():
    line = [(0.0, 0.0), (0.001, 0.0), (0.002, 0.0)]
    assert routing.rest_of(line, 50.0, True) == [(0.0, 0.0)] and routing.rest_of(line, 50.0, False) == [(0.001, 0.0), (0.002, 0.0)]
    assert routing.between(line, 200.0, 20.0) == [(0.001, 0.0)]
    runs = routing.grouped([((0.0, 0.0), 0.0), ((0.0, 0.0), 0.0), ((1.0, 0.0), 0.0), ((1.0, 0.0), 1.0), ((2.0, 0.0), 1.0)])
    assert [len(r["line"]) for r in runs] == [2, 3]


def test_graph_of_layers(spark):
    junctions = spark.createDataFrame([(1, 1, "F1", 0.0, 0.0), (2, 2, "F1", 1.0, 0.0), (3, 2, "F2", 2.0, 0.0), (4, 3, "roof", 0.0, 0.0), (5, None, "F1", 0.0, 0.0)], "place long, node_id long, floor string, lon double, lat double")
    rows = [(1, 1, 2, 5.0, None, 10, 11, None, "{}"), (2, 2, 1, 6.0, None, 11, 10, None, "{}"), (3, 1, 2, 7.0, "B1", 10, 11, None, "{}"), (4, 1, 9, 1.0, None, None, None, None, "{}"), (5, 1, 2, -1.0, None, None, None, None, "{}"), (6, 1, 2, 8.0, None, None, None, None, '{"EDGE_KIND": "vertical"}')]
    paths = spark.createDataFrame(rows, "place long, from_id long, to_id long, cost double, floor string, path_id long, back_id long, line array<struct<x: double, y: double>>, properties string")
    levels = spark.createDataFrame([(0.0,)], "ordinal double")
    nodes, edges, warnings = building.build(junctions, paths, levels)
    assert {r.node_id: r.ordinal for r in nodes.collect()} == {1: 0.0, 2: 1.0}  # the last of equal ids
    assert sorted((r.cost, r.ordinal, r.kind) for r in edges.collect()) == [(5.0, 0.0, "imported"), (7.0, -1.0, "imported"), (8.0, 0.0, "imported")]
    assert sorted(r.code for r in warnings.collect()) == ["dangling_edge", "invalid_cost", "reciprocal_conflict", "unmapped_floor", "unmatched_level"]


def test_registration_of_nothing(spark):
    tri = spark.createDataFrame([], "object_id long, document string, link string, level_key string, level_name string, elevation double, category string, " + ", ".join(f"{k}{i} double" for i in (1, 2, 3) for k in "xyz"))
    tri = registration.with_level(tri, "v")
    levels = registration.tile_levels(tri)
    floors = spark.createDataFrame([("L", 0.0)], "level_id string, floor_plane double")
    none = spark.createDataFrame([], "tile_level string, label string")
    assert registration.match_floors(levels, floors, none, none.select(F.col("tile_level").alias("level_id"), "label"), registration.Bands()).count() == 0
    points = spark.createDataFrame([("L", 1, 0.5, 0.5)], "level_id string, sample_id long, x double, y double")
    outlines = spark.createDataFrame([], "level_id string, x1 double, y1 double, x2 double, y2 double")
    report = registration.floor_report(registration.residuals(points, outlines, registration.Bands())).first()
    assert report.sampled == report.carved_out == 1 and report.p90 is None and report.shift == 0


def test_editor_histories(spark):
    rng = random.Random(7)
    actions = [(e, i, rng.choice(["edit", "edit", "edit", "undo", "redo"]), rng.randrange(100)) for e in range(4) for i in range(120)]
    got = {(r.e, r.i): (r.present, r.past, r.future) for r in changes.histories(spark.createDataFrame(actions, "e long, i long, action string, v long"), "e", "i", "v").collect()}
    for e in range(4):
        states, at = [None], 0  # all states, and the one that is shown
        low = 0
        for _, i, action, v in sorted(a for a in actions if a[0] == e):
            if action == "edit":
                states, at = [*states[: at + 1], v], at + 1
            elif action == "undo" and at > low:
                at -= 1
            elif action == "redo" and at < len(states) - 1:
                at += 1
            low = max(low, at - changes.HISTORY)
            assert got[e, i] == (states[at], at - low, len(states) - 1 - at)


def test_matrices(spark):
    m = [2.0, 0.0, 1.0, 3.0, 0.0, 1.0, 0.0, -2.0, 1.0, 0.0, 3.0, 0.5, 0.0, 0.0, 0.0, 1.0]
    d = spark.createDataFrame([(m, [0.0] * 16)], "m array<double>, z array<double>")
    r = d.select(lookups.product(F.col("m"), lookups.inverse(F.col("m"))).alias("i"), lookups.inverse(F.col("z")).alias("n")).first()
    assert all(abs(v - (k % 5 == 0)) < 1e-12 for k, v in enumerate(r.i)) and r.n is None

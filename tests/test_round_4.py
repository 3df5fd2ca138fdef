"""Odd inputs and shapes of larger tables, on small ones."""

import heapq
import math
import random

import duckdb

from floorspan.operators import graph, nearest, routing, walk, walls
from floorspan.operators.skeleton import skeletons
from floorspan.plans import all_queries, compiling
from floorspan.plans.views import TABLES, frame
from floorspan.session import cut

SF = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL, with some tables given as SELECT statements."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY ({tables.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    q = all_queries()[name]
    df = q.build(spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({q.oracle})").fetchall()
    plain = lambda rows: sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)
    return plain(map(tuple, df.collect())), plain(want)


DOCUMENTS = f"SELECT doc_id, {{text}} AS text, lang, source, CAST({{size}} AS {{kind}}) AS n_chars FROM '{SF}/documents.parquet'"


def documents(text="text", size="n_chars"):
    kind = duckdb.sql(f"SELECT typeof(n_chars) FROM '{SF}/documents.parquet' LIMIT 1").fetchall()[0][0]
    return DOCUMENTS.format(text=text, size=size, kind=kind)


def test_byte_ranges_of_short_bodies(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "a22_byte_range", documents=documents(size="doc_id // 12 % 12"))
    assert got == want and any(r[0] % 12 == 11 and r[1] == "unsatisfiable" for r in got) and any(r[0] % 12 == 11 and r[1] == "whole" for r in got)


def test_summaries_of_bodies_without_lines(spark, tmp_path):
    text = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN E' \\n\\r\\n ' WHEN 2 THEN '![a](b)' ELSE text END"
    got, want = against_sql(spark, tmp_path, "f17_issue_summary", documents=documents(text=text))
    assert got == want and sum(r[1] is None for r in got) == 150


def test_distance_of_sets_looks_at_each_place_once(spark, monkeypatch):
    seen, real = [], nearest.nearest_segment
    monkeypatch.setattr(nearest, "nearest_segment", lambda p, s, *a: seen.append((p.count(), s.count())) or real(p, s, *a))
    p = spark.range(4000).selectExpr("CAST(id % 2 AS INT) AS o", "id % 7 * 1.0D AS x", "0.0D AS y", "id AS node_id")
    q = spark.range(4000).selectExpr("CAST(id % 2 AS INT) AS o", "id % 5 * 2.5D AS x", "1.0D AS y", "id AS node_id")
    got = {r.o: r.hausdorff for r in nearest.hausdorff(p, q, "o", 2.0).collect()}
    xs, ys = [i * 1.0 for i in range(7)], [i * 2.5 for i in range(5)]
    want = max(max(min(math.hypot(x - y, 1) for y in ys) for x in xs), max(min(math.hypot(x - y, 1) for x in xs) for y in ys))
    assert got == {0: want, 1: want} and seen == [(14, 10), (10, 14)]


def test_grid_search_keeps_to_the_way(monkeypatch):
    pops, real = [0], walk.heapq.heappop
    monkeypatch.setattr(walk.heapq, "heappop", lambda h: pops.__setitem__(0, pops[0] + 1) or real(h))
    assert walk.grid_path((0, 0), (40, 3000), [(10.0, 1.0, 12.0, 14.0)]) == 2960 * 1000 + 40 * 1414
    assert pops[0] < 30_000  # the grid has 243,000 points
    pops[0] = 0
    cell = [(36.5, 2996.5, 37.5, 3003.5), (42.5, 2996.5, 43.5, 3003.5), (36.5, 2996.5, 43.5, 2997.5), (36.5, 3002.5, 43.5, 3003.5)]
    assert walk.grid_path((0, 0), (40, 3000), cell) is None and pops[0] < 1000  # a goal that is shut in


def test_grid_search_is_exact():
    r = random.Random(4)

    def plain(a, b, obstacles, margin):
        lo, hi = [min(p) - margin for p in zip(a, b)], [max(p) + margin for p in zip(a, b)]
        best, heap = {a: 0}, [(0, a)]
        while heap:
            c, (x, y) = heapq.heappop(heap)
            for to in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]:
                d = c + (1414 if to[0] != x and to[1] != y else 1000)
                if all(lo[k] <= to[k] <= hi[k] for k in (0, 1)) and not any(o[0] < to[0] < o[2] and o[1] < to[1] < o[3] for o in obstacles) and d < best.get(to, math.inf):
                    best[to] = d
                    heapq.heappush(heap, (d, to))
        return best.get(b)

    for _ in range(100):
        obstacles = [(x := r.uniform(-3, 10), y := r.uniform(-3, 10), x + r.uniform(0, 9), y + r.uniform(0, 9)) for _ in range(5)]
        a, b = (r.randint(0, 9), r.randint(0, 9)), (r.randint(0, 9), r.randint(0, 9))
        assert walk.grid_path(a, b, obstacles, 3) == plain(a, b, obstacles, 3)


def test_smoothing_looks_at_the_parts_around_alone(spark, monkeypatch):
    calls, real = [0], walk.in_ring
    monkeypatch.setattr(walk, "in_ring", lambda *a: calls.__setitem__(0, calls[0] + 1) or real(*a))
    square = lambda x, y: [(x, y), (x + 9.0, y), (x + 9.0, y + 9.0), (x, y + 9.0)]
    line = [(1.0 + i * 2, 5.0 + i % 2) for i in range(12)]
    assert walk.smoothed(line, [square(9.0 * i, 0.0) for i in range(3000)], [square(9.0 * i, 100.0) for i in range(3000)], [(i * 10.0, 50.0) for i in range(3000)]) == [0, 11]
    assert calls[0] < 1000
    monkeypatch.undo()
    point = "array<struct<x: double, y: double>>"
    routes = spark.createDataFrame([(1, 0, 0.0, [(x, y + 200.0 * k) for x, y in line]) for k in range(3)], f"route_id long, segment int, ordinal double, points {point}")
    parts = [(0.0, "area", square(9.0 * i, 200.0 * k), None, None) for i in range(3) for k in (0, 2)] + [(0.0, "lock", None, 7.1, 406.0)]
    got = walk.smooth_on_floors(routes, spark.createDataFrame(parts, f"ordinal double, part string, ring {point}, x double, y double")).collect()
    assert sorted((r.points[0].y, [p.x for p in r.points]) for r in got) == [(5.0, [1.0, 23.0]), (205.0, [p[0] for p in line]), (405.0, [1.0, 7.0, 23.0])]


def test_joins_of_stored_walls_are_not_broadcast(spark):
    rooms = [frame(spark, SF, v) for v in ("v_room", "v_side", "v_door")]
    of_units, _, _, cuts = compiling._hosted(rooms[0], rooms[2])
    plan = walls.connected_units(cuts, of_units)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    near = walls.candidates(rooms[2], cut(walls.walls(of_units)))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in near and "BroadcastHashJoin" not in near


def test_middle_lines_by_tiles_are_those_of_the_whole(spark):
    r = random.Random(3)
    rows = [(k, r.uniform(0, 60), r.uniform(0, 60), r.uniform(1, 30), r.uniform(1, 30), r.random() < 0.7) for k in "ab" for _ in range(25)] + [("c", 0.0, 0.0, 5.0, 5.0, False)]
    d = spark.createDataFrame(rows, "level_id string, x double, y double, w double, h double, free boolean")
    whole = sorted(map(tuple, skeletons(d).collect()))
    assert whole and sorted(map(tuple, skeletons(d, tile=16, margin=3).collect())) == whole


def test_few_points_meet_the_same_segments_as_many(spark):
    r = random.Random(6)
    points = spark.createDataFrame([(i, i % 3, r.uniform(0, 50), r.uniform(0, 50)) for i in range(40)], "i long, g int, x double, y double")
    lines = [(k // 2, k % 2, g, r.uniform(0, 50), r.uniform(0, 50), r.uniform(0, 50), r.uniform(0, 50)) for k in range(600) for g in (0, 1)] + [(7000, 0, 2, 1.0, 1.0, 2.0, 2.0)]
    segments = spark.createDataFrame(lines, "k long, piece int, g int, x1 double, y1 double, x2 double, y2 double")
    few, many = (sorted((r.i, r.place, r.k, r.distance, r.piece) for r in nearest.nearest_segments(points, segments, "g", "i", "k", 4.0, 3, part="piece", few_points=n).collect()) for n in (256, 0))
    assert few == many and len(few) == 3 * 27 + 13
    spread = []
    real = nearest.cells_of
    nearest.cells_of = lambda *a: spread.append(1) or real(*a)
    try:
        nearest.nearest_segments(points, segments, "g", "i", "k", 4.0, 3).collect()
    finally:
        nearest.cells_of = real
    assert not spread  # no segment is sent to the cells of its bounds


def some_graph(n, seed):
    r = random.Random(seed)
    return sorted({(a, b): (float(r.choice((1, 1, 2, 3, 5)) * 1000), r.randrange(3)) for a in range(n) for b in r.sample(range(n), 4) if a != b and a % 9 and b % 9}.items())


def test_routes_of_large_venues_are_those_of_small_ones(spark, monkeypatch):
    edges = spark.createDataFrame([(v, a, b, c, d) for v in (1, 2) for (a, b), (c, d) in some_graph(60, v)], "venue int, from_id long, to_id long, cost double, direction int")
    there, back = edges.filter("direction in (0, 1)").selectExpr("venue", "from_id AS source", "to_id AS target", "cost"), edges.filter("direction in (0, 2)").selectExpr("venue", "to_id", "from_id", "cost")
    asked = spark.createDataFrame([(v, v * 1000 + i, s, i) for v in (1, 2, 3) for s in (4, 17) for i in range(s % 2, 60, 2)], "venue int, request_id long, source long, target long")
    small = sorted(map(tuple, graph.routes(asked, there.union(back)).collect()), key=repr)
    assert len(small) == 180 and sum(r[2] is None for r in small) > 60
    monkeypatch.setattr(graph, "search_all", None)  # not called
    large = graph.routes(asked.filter("venue < 3"), there.union(back), most=0)
    assert sorted(map(tuple, large.collect()), key=repr) == [r for r in small if r[0] < 3]


def test_ways_of_large_networks_are_those_of_small_ones(spark):
    r = random.Random(8)
    nodes = spark.createDataFrame([(1, i, 139.76 + r.random() * 1e-3, 35.68 + r.random() * 1e-3, float(i % 2)) for i in range(60)], "venue int, node_id long, lon double, lat double, ordinal double")
    at = dict(some_graph(60, 5))
    edges = spark.createDataFrame([(1, k, a, b, c, float(a % 2), None, d) for k, ((a, b), (c, d)) in enumerate(sorted(at.items()))], "venue int, edge_id long, from_id long, to_id long, cost double, ordinal double, interior array<struct<lon: double, lat: double>>, direction int")
    spot = lambda: (139.76 + r.random() * 1e-3, 35.68 + r.random() * 1e-3, float(r.randrange(2)))
    asked = spark.createDataFrame([(1, i, *spot(), *spot()) for i in range(25)], "venue int, request_id long, lon1 double, lat1 double, ordinal1 double, lon2 double, lat2 double, ordinal2 double")
    small, large = (sorted(map(tuple, routing.route(asked, nodes, edges, most=n).collect())) for n in (1000, 0))
    assert small == large and len(small) > 20

"""Queries answer for all rows of their tables; each is held against a plain version, not against its SQL."""

import heapq
import math

import duckdb
import pytest

from floorspan.plans import all_queries
from floorspan.plans.views import frame
from floorspan.sources import network

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def edges():
    """(from, to, cost, direction) of all edges between known nodes' ids, from the base table."""
    rows = duckdb.sql(f"SELECT l_suppkey, l_partkey % 102, min(l_quantity) * 1000, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").fetchall()
    return [(a, b, float(c), d) for a, b, c, d in rows if a % 11 and b % 11 and a != b]


@pytest.fixture(scope="module")
def nodes():
    return {n for (n,) in duckdb.sql(f"SELECT s_suppkey FROM '{SF}/supplier.parquet'").fetchall()}


def run(spark, name):
    return all_queries()[name].build(spark, SF).collect()


def costs(edges, nodes, source):
    around = {}
    for a, b, c, d in edges:
        if b in nodes:
            if d in (0, 1):
                around.setdefault(a, []).append((b, c))
            if d in (0, 2):
                around.setdefault(b, []).append((a, c))
    best, heap = {}, [(0.0, source)]
    while heap:
        c, at = heapq.heappop(heap)
        if at not in best:
            best[at] = c
            for t, x in around.get(at, ()):
                heapq.heappush(heap, (c + x, t))
    return best


def test_network_has_all_edges(spark, edges):
    assert frame(spark, SF, "v_net").count() == len(edges)
    assert sorted((r.from_id, r.to_id) for r in frame(spark, SF, "v_net").collect()) == sorted(e[:2] for e in edges)


def test_graph_queries_answer_for_all_edges(spark, edges, nodes):
    best = costs(edges, nodes, 8)
    assert {r.node_id: r.cost for r in run(spark, "g17_shortest_paths")} == best
    assert {r.node_id for r in run(spark, "g18_bounded_reachability")} == {n for n, c in best.items() if c <= 40000}
    routes = {r.request_id: r for r in run(spark, "g13_routes")}
    assert all(r.cost == best.get(n) for n, r in routes.items())
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b, *_ in edges:
            if b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    assert {r.node_id: r.component for r in run(spark, "g19_connected_components")} == label
    ends = [n for e in edges for n in e[:2]]
    assert {r.node_id: r.degree for r in run(spark, "d15_degree")} == {n: ends.count(n) for n in nodes}
    assert {r.node_id for r in run(spark, "g20_isolated_nodes")} == nodes - set(ends)


def haversine(x1, y1, x2, y2):
    x1, y1, x2, y2 = map(math.radians, (x1, y1, x2, y2))
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))


def test_nearest_nodes_of_every_unit(spark):
    units, nodes = frame(spark, SF, "v_unit").collect(), frame(spark, SF, "v_node").collect()
    want = {u.unit_id: sorted((haversine(u.x, u.y, n.lon, n.lat), n.node_id) for n in nodes if n.ordinal == u.building % 5 - 2)[:3] for u in units}
    assert any(want.values())
    known = {n.node_id: n for n in nodes}
    at = {u.unit_id: u for u in units}
    got = {}
    for r in run(spark, "c16_nearest_three"):
        got.setdefault(r.unit_id, {})[r.place] = r.node_id
    first = {r.unit_id: r.node_id for r in run(spark, "c17_nearest_node")}
    assert set(got) == set(first) == {u for u, w in want.items() if w}
    for unit, places in got.items():
        assert sorted(places) == list(range(1, len(want[unit]) + 1))
        for k, (d, _) in enumerate(want[unit], 1):  # equal distances may come in another order in Python's arithmetic
            assert math.isclose(haversine(at[unit].x, at[unit].y, known[places[k]].lon, known[places[k]].lat), d, rel_tol=1e-6, abs_tol=1e-6)
        assert first[unit] == places[1]


@pytest.mark.parametrize(("name", "key", "table", "column"), [
    ("c04_original_and_thumbnail", "id", "lineitem", "l_orderkey * 10 + l_linenumber"), ("e06_cumulative_length", "l_orderkey", "lineitem", "l_orderkey"), ("g03_walkable_and_chords", "unit_id", "part", "p_partkey"),
    ("g11_doorway_direction", "opening", "lineitem", "l_suppkey"), ("g13_routes", "request_id", "supplier", "s_suppkey"), ("g24_triangulate", "unit_id", "part", "p_partkey"), ("h02_optimistic_update", "id", "orders", "o_orderkey"),
    ("h05_quota_fold", "version_id", "lineitem", "l_orderkey % 40"), ("c27_tile_member_lookup", "member", "documents", "doc_id"),
])
def test_all_rows_are_answered(spark, name, key, table, column):
    where = {"c04_original_and_thumbnail": "WHERE l_partkey % 900 IN (SELECT p_partkey % 1000 FROM '{0}/part.parquet') AND l_suppkey % 700 IN (SELECT p_partkey % 1000 FROM '{0}/part.parquet')",
             "c27_tile_member_lookup": "WHERE doc_id % 30 IN (SELECT p_partkey FROM '{0}/part.parquet' WHERE p_partkey % 4 IN (1, 2))"}.get(name, "").format(SF)
    want = {r[0] for r in duckdb.sql(f"SELECT DISTINCT {column} FROM '{SF}/{table}.parquet' {where}").fetchall()}
    assert {r[key] for r in run(spark, name)} == want


def test_sums_and_bounds_cover_all_rows(spark):
    units = frame(spark, SF, "v_unit").collect()
    for r in run(spark, "d01_bounds_per_level"):
        own = [u for u in units if u.level_id == r.level_id]
        assert (r.west, r.north) == (min(u.x for u in own) - 1e-6 * (len({u.x for u in own}) == 1), max(u.y for u in own) + 1e-6 * (len({u.y for u in own}) == 1))
    documents = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert sum(r.sections for r in run(spark, "h19_bundle_sections")) == documents
    assert frame(spark, SF, "v_reply").count() == frame(spark, SF, "lineitem").count()


def test_every_node_takes_part_in_the_matching(spark):
    matched = run(spark, "c21_minimum_cost_matching")
    assert {r.lower for r in matched} == {r.node_id for r in frame(spark, SF, "v_node").collect()}
    assert len({r.upper for r in matched}) == len(matched)


def test_thresholds_are_the_reference_s(spark):
    rooms = frame(spark, SF, "v_room").collect()
    hubs = {r.unit_id: {(r.level_id, (r.x + dx) // 10, (r.y + dy) // 10) for dx in (0, 4000) for dy in (0, 3000)} for r in rooms}
    shared = {(a, b): len(hubs[a] & hubs[b]) for a in hubs for b in hubs if a < b}
    assert {(r.a, r.b): r.n for r in run(spark, "c20_shared_vertices")} == {p: n for p, n in shared.items() if n >= 2}
    at = {k: float(z) / 1000 + k % 100 * 15 for k, z in duckdb.sql(f"SELECT s_suppkey, s_acctbal FROM '{SF}/supplier.parquet'").fetchall()}
    near = {a: sum(abs(at[a] - (at[b] + 0.4)) <= 1.5 for b in at) for a in at}
    assert {r.node_id: r.n for r in run(spark, "c22_altitude_band")} == {a: n for a, n in near.items() if n}


def test_lists_are_whole_and_in_order(spark, edges):
    assert [(r.from_id, r.to_id, r.cost) for r in run(spark, "e08_multi_key_sort")] == sorted(e[:3] for e in edges)
    users = duckdb.sql(f"SELECT c_name, c_custkey FROM '{SF}/customer.parquet' WHERE c_custkey % 10 <> 1").fetchall()
    assert [(r.username, r.id) for r in run(spark, "e12_list_reviewers")] == sorted(users)


def test_package_walk_goes_to_the_end(spark):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(11)] + [("t11", "t0"), ("other", "lost")], "parent string, child string")
    found = network.reachable(edges, spark.createDataFrame([("t0",)], "path string")).collect()
    assert {r.path: r.depth for r in found} == {f"t{i}": i for i in range(12)}
    claimed = {r for q in all_queries().values() for r in q.rows}
    assert not claimed & {"A20", "H19"}  # not built; walls and openings have queries now

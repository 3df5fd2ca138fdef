"""Queries do their whole job: units stacked on 40 x 40 places and planes of one range of heights, held against plain versions."""

import math

import duckdb
import pytest

from floorspan.operators import relational
from floorspan.plans import all_queries
from floorspan.plans.views import frame

SF = "/root/testdata/sf0.01"
WALK = {"walkway", "ramp", "platform", "lobby", "footbridge"}


def run(spark, name):
    return all_queries()[name].build(spark, SF).collect()


@pytest.fixture(scope="module")
def units(spark):
    """Units with the row of places that the modulo stacks them on, from the base table."""
    at = {k: 35.68 + (k // 40 % 40) * 1e-4 for (k,) in duckdb.sql(f"SELECT p_partkey FROM '{SF}/part.parquet'").fetchall()}
    rows = frame(spark, SF, "v_unit").collect()
    assert len(rows) == len(at) > 1600  # so that some places have two units
    return [{**r.asDict(), "y": at[r.unit_id]} for r in rows]


@pytest.fixture(scope="module")
def nodes(spark):
    return frame(spark, SF, "v_node").collect()


def test_stacked_units_around_nodes(spark, units, nodes):
    pad = 2e-5
    want = {n.node_id: sum(u["x"] - pad < n.lon < u["x"] + u["w"] + pad and u["y"] - pad < n.lat < u["y"] + u["h"] + pad and u["building"] % 5 - 2 == n.ordinal for u in units) for n in nodes}
    assert {r.node_id: r.n_units for r in run(spark, "c13_point_in_buffered_polygon")} == {k: c for k, c in want.items() if c}


def test_plane_of_each_node_among_all(spark):
    at = dict(duckdb.sql(f"SELECT s_suppkey, s_acctbal / 1000 FROM '{SF}/supplier.parquet'").fetchall())
    want = {}
    for a, z in at.items():
        near = [(abs(z - (at[b] + 0.4)), b) for b in at if abs(z - (at[b] + 0.4)) <= 1.5]
        if near:
            want[a] = (min(near)[1], len(near))
    assert {r.node_id: (r.plane, r.n) for r in run(spark, "c22_altitude_band")} == want


def test_band_at_its_edges_and_ties(spark):
    left = [(1, 0.0), (2, 1.5), (3, 100.0), (4, None), (5, float("nan")), (6, -0.01), (7, float("inf"))]
    right = [(9, 1.5), (8, 1.5), (7, -1.5), (6, 1.5000001), (5, None), (4, float("nan")), (3, 0.0), (2, 3.0), (1, float("inf"))]
    a, b = spark.createDataFrame(left, "k long, a double"), spark.createDataFrame(right, "o long, b double")
    want = {}
    for k, x in left:
        near = [(abs(x - y), o) for o, y in right if x is not None and y is not None and abs(x - y) <= 1.5]
        if near:
            want[k] = (min(near)[1], len(near))
    assert {r.k: (r.o, r.n) for r in relational.nearest_in_band(a, b, "k", "o", "a", "b", 1.5).collect()} == want


def test_conveyances_of_stacked_units(spark, units, nodes):
    at, floor = {n.node_id: n for n in nodes}, {r.level_id: r.ordinal for r in frame(spark, SF, "v_level").collect()}
    ends = []
    for e in frame(spark, SF, "v_net").filter("(from_id + to_id) % 5 = 0").collect():
        a, b = at.get(e.from_id), at.get(e.to_id)
        if a and b and a.ordinal != b.ordinal:
            ends += [(e.from_id * 100000 + e.to_id, p.ordinal, q.ordinal, p.lon + 2e-5, p.lat + 2e-5) for p, q in ((a, b), (b, a))]
    want = {}
    for u in units:
        if u["category"] in ("elevator", "stairs", "escalator"):
            o = floor[u["level_id"]]
            found = [(abs(far - o), far, path) for path, near, far, x, y in ends if near == o and u["x"] < x < u["x"] + u["w"] and u["y"] < y < u["y"] + u["h"]]
            if found:
                want[u["unit_id"]] = min(found)[1:]
    assert {r.id: (r.far, r.path_id) for r in run(spark, "c25_conveyance_links")} == want


def test_openings_near_stacked_hubs(spark, units, nodes):
    floor = {r.level_id: r.ordinal for r in frame(spark, SF, "v_level").collect()}
    want = {}
    for u in units:
        if u["category"] not in WALK:
            continue
        west, south = (u["x"] - 139.76) * 9e4, (u["y"] - 35.68) * 1.1e5
        east, north = west + u["w"] * 9e4, south + u["h"] * 1.1e5
        for n in nodes:
            if n.ordinal == floor[u["level_id"]]:
                x, y = (n.lon - 139.76) * 9e4, (n.lat - 35.68) * 1.1e5
                out = math.hypot(max(west - x, 0, x - east), max(south - y, 0, y - north))
                d = out or min(x - west, east - x, y - south, north - y)  # inside: to the nearest side
                if d <= 3:
                    want[n.node_id, u["unit_id"]] = d
    got = {(r.opening_id, r.hub_id): r.distance for r in run(spark, "c15_openings_near_hubs")}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)

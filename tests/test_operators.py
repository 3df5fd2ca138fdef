"""Graph, change and source operators against plain Python."""

import itertools
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from floorspan.operators import changes, gates, graph, relational, scene, walk
from floorspan.sources import archive, bundle, glb, network
from floorspan.streaming import revisions


def small_graph(spark, seed=1, n=30, m=35):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    edges = [(a, b, float(1 + (a * 7 + b) % 5), 0) for a, b in sorted(edges) if a != b]
    nodes = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "node_id long, ordinal double")
    return nodes, spark.createDataFrame(edges, "from_id long, to_id long, cost double, direction int"), edges, n


def test_components_and_paths(spark):
    nodes, edges, plain, n = small_graph(spark)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in plain:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r.node_id: r.component for r in graph.connected_components(nodes, edges).collect()} == {i: find(i) for i in range(n)}
    best = {plain[0][0]: 0.0}
    for _ in range(n):
        for a, b, c, _ in plain:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + c < best.get(y, 1e9):
                    best[y] = best[x] + c
    got = {r.node_id: r.cost for r in graph.shortest_costs(graph.adjacency(edges), plain[0][0]).collect()}
    assert got == best
    requests = spark.createDataFrame([(1, i, plain[0][0], i) for i in range(n)], "venue int, request_id long, source long, target long")
    routed = graph.routes(requests, graph.adjacency(edges).withColumn("venue", F.lit(1))).collect()
    assert {r.request_id: r.cost for r in routed if r.cost is not None} == best
    for r in routed:
        if r.path:
            assert r.path[0] == plain[0][0] and r.path[-1] == r.request_id


def test_matching_is_best():
    rng = random.Random(3)
    for _ in range(20):
        cost = {(a, b): rng.randrange(1, 20) + 0.0 for a in range(4) for b in range(10, 14) if rng.random() < 0.6}
        options = [()]
        for k in range(1, 5):
            options += [s for s in itertools.combinations(cost, k) if len({a for a, _ in s}) == len({b for _, b in s}) == k]
        best = min(options, key=lambda s: (-len(s), sum(cost[e] for e in s)))
        got = graph.best_matching(cost)
        assert len(got) == len(best) and sum(cost[e] for e in got) == sum(cost[e] for e in best)


def test_reciprocal_pairs_of_duplicates(spark):
    p = spark.createDataFrame([(1, 5, 6), (2, 6, 5), (3, 5, 6), (4, 6, 5), (5, 5, 6)], "path_id long, from_id long, to_id long")
    assert {tuple(r) for r in graph.reciprocal_pairs(p).collect()} == {(1, 2), (3, 4)}


def test_edges_with_unknown_clearance_are_allowed(spark):
    rows = [(None, None, False, False, True), (None, 0.7, False, False, True), ("stairs", 1.0, False, False, True), ("elevator", 1.0, True, False, True)]
    d = spark.createDataFrame(rows, "vertical string, clearance_m double, barrier boolean, accessible_only boolean, wheelchair boolean")
    assert [r[0] for r in d.select(graph.edge_allowed(graph.WHEELCHAIR)).collect()] == [True, False, False, False]


def test_empty_inputs(spark):
    nodes = spark.createDataFrame([], "node_id long, ordinal double")
    edges = spark.createDataFrame([], "from_id long, to_id long, cost double, direction int")
    assert graph.connected_components(nodes, edges).count() == 0
    assert graph.degree(nodes, edges).count() == 0
    assert graph.dense_index(nodes.select("node_id")).count() == 0


def test_upsert_and_difference(spark):
    old = spark.createDataFrame([(1, "draft"), (2, "live")], "id long, status string")
    new = spark.createDataFrame([(1, "new"), (2, "new"), (3, "new")], "id long, status string")
    assert {tuple(r) for r in relational.upsert(old, new, "id", F.col("status") == "draft").collect()} == {(1, "new"), (2, "live"), (3, "new")}
    assert tuple(relational.difference(old, new, "id", F.col("b.status") != F.col("a.status")).first()) == (1, 0, 2)


def test_mode_is_the_first_to_reach(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (1, "a", 4)], "g int, v string, i int")
    assert relational.mode_first_to_reach(d, "g", "v", "i").first().v == "b"


def test_quota_lets_small_ones_through(spark):
    d = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (2, 1, 200)], "version_id long, id long, bytes long")
    got = {(r.version_id, r.id): r.accepted for r in changes.under_quota(d, "version_id", "id", "bytes", 100).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): False}
    assert changes.undo(["a", "b", "c"], 1) == "b" and changes.undo(["a"], 5) == "a"


def test_triangles_cover_the_ring():
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
    for r in (ring, ring[::-1]):
        t = scene.ears(r)
        assert len(t) == 3 and sum(scene._turn(*(r[i] for i in x)) for x in t) == abs(area)


def test_smoothing_goes_around(spark):
    points = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 3.0), (4.0, 3.0)]
    assert walk.smooth(points, []) == [0, 4]
    assert walk.smooth(points, [(0.5, 0.5, 2.5, 2.0)]) != [0, 4]
    assert walk.grid_path((0, 0), (3, 0), []) == 3000
    assert walk.grid_path((0, 0), (4, 0), [(1.5, -50.0, 2.5, 50.0)]) is None


def test_network_edits(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "from_id long, to_id long, cost double")
    out = gates.edit_network(e, [("delete_node", 1), ("add_edge", (3, 4, 2.0)), ("move_cost", (F.col("from_id") == 2, 5))])
    assert {tuple(r) for r in out.collect()} == {(2, 3, 5.0), (3, 4, 2.0)}
    with pytest.raises(ValueError):
        gates.edit_network(e, [("paint", None)])


def collection(kind, n, **extra):
    return {"type": "FeatureCollection", "features": [{"id": f"{kind}{i}", "type": "Feature", "feature_type": kind, "geometry": None, "properties": {"b": -0.0, "a": 1} | extra} for i in range(n)]}


def write_zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for k, v in files.items():
            z.writestr(k, v if isinstance(v, (str, bytes)) else json.dumps(v))


def test_archives(spark, tmp_path):
    good = {"manifest.json": {"version": "1.0.0"}} | {f"{k}.geojson": collection(k, n) for k, n in (("address", 1), ("building", 1), ("footprint", 1), ("level", 2), ("unit", 3), ("venue", 1))}
    (tmp_path / "in").mkdir()
    write_zip(tmp_path / "in/good.zip", good)
    write_zip(tmp_path / "in/short.zip", {k: v for k, v in good.items() if k != "unit.geojson"})
    write_zip(tmp_path / "in/evil.zip", good | {"../x": "y"})
    (tmp_path / "in/none.zip").write_bytes(b"nothing")
    d = archive.read_archives(spark, str(tmp_path / "in"))
    by = {}
    for r in d.collect():
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert {k: {r.problem for r in v} for k, v in by.items()} == {"good.zip": {None}, "short.zip": {"missing_file"}, "evil.zip": {"unsafe_path"}, "none.zip": {"not_a_zip"}}
    assert len(by["good.zip"]) == 9 and by["good.zip"][0].properties == '{"a": 1, "b": 0.0}'
    ok = d.filter("problem is null")
    assert archive.problems(ok).count() == 0
    packed = archive.archives(ok.withColumn("venue", F.lit(1)))
    assert list(archive.entries(bytes(packed.first().content)))[0] == "address.geojson"
    with pytest.raises(archive.ArchiveError):
        archive.canonical([float("nan")])


def test_bundle_round_trip(spark, tmp_path):
    s = {k: spark.range(n).withColumnRenamed("id", "x") for k, n in (("manifest", 1), ("levels", 3), ("features", 9), ("graph", 4))}
    folder = str(tmp_path / "b")
    bundle.write_bundle(s, folder)
    got, states = bundle.read_bundle(spark, folder)
    assert {k: v.count() for k, v in got.items()} == {"manifest": 1, "levels": 3, "features": 9, "graph": 4}
    spark.range(5).withColumnRenamed("id", "x").write.mode("overwrite").parquet(f"{folder}/section=graph")
    got, states = bundle.read_bundle(spark, folder)
    assert "graph" not in got and {tuple(r) for r in states.collect()} >= {("graph", "changed")}
    spark.range(5).withColumnRenamed("id", "x").write.mode("overwrite").parquet(f"{folder}/section=levels")
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, folder)


def test_glb(spark, tmp_path):
    points = struct.pack("<9f", 0, 0, 0, 1, 2, 3, -1, 5, 0) + struct.pack("<3H", 0, 1, 2) + b"\0\0"
    doc = {
        "bufferViews": [{"byteOffset": 0}, {"byteOffset": 36}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 3}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
    }
    j = json.dumps(doc).encode()
    j += b" " * (-len(j) % 4)
    body = struct.pack("<II", len(j), glb.JSON_CHUNK) + j + struct.pack("<II", len(points), glb.BIN_CHUNK) + points
    (tmp_path / "a.glb").write_bytes(struct.pack("<III", glb.MAGIC, 2, 12 + len(body)) + body)
    r = glb.read_glb(spark, str(tmp_path)).first()
    assert (r.vertices, r.triangles, r.least, r.greatest) == (3, 1, [-1.0, 0.0, 0.0], [1.0, 5.0, 3.0])
    with pytest.raises(ValueError):
        glb.chunks(b"x" * 20)


def test_network_sink(spark, tmp_path):
    n = spark.createDataFrame([(1, "F1")], "NODEID long, FLOOR string")
    network.write_network(n, n, str(tmp_path / "net"))
    assert json.loads(spark.read.text(str(tmp_path / "net/net_junction")).first().value) == {"NODEID": 1, "FLOOR": "F1"}


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i % 3, i, f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    d = spark.createDataFrame(rows, "version_id long, revision long, at string").withColumn("at", F.to_timestamp("at"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = revisions.run_once(revisions.latest(read()), "t_latest", "complete", str(tmp_path / "c1"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in revisions.latest(d).collect()}
    revisions.run_to_parquet(revisions.created_once(read().select("version_id"), "version_id"), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    win = revisions.run_once(revisions.windowed(read(), "at", "5 minutes", "1 hour"), "t_win", "update", str(tmp_path / "c3"))
    assert win.count() >= 4


def test_skeleton_keeps_its_distance(spark):
    from floorspan.operators.skeleton import skeletons

    rows = [("a", 0.0, 0.0, 20.0, 4.0, True), ("a", 8.0, 0.0, 4.0, 10.0, True), ("a", 3.0, 1.0, 1.0, 1.0, False), ("b", 0.0, 0.0, 1.0, 1.0, False)]
    d = skeletons(spark.createDataFrame(rows, "level_id string, x double, y double, w double, h double, free boolean")).collect()
    assert {r.level_id for r in d} == {"a"} and len(d) > 20
    ids = {r.node for r in d}
    for r in d:
        inside = (0 <= r.x <= 20 and 0 <= r.y <= 4) or (8 <= r.x <= 12 and 0 <= r.y <= 10)
        assert inside and not (3 < r.x < 4 and 1 < r.y < 2) and r.clearance >= 0.4
        assert r.right is None or r.right in ids
        assert r.up is None or r.up in ids
    assert any(abs(r.y - 2) <= 0.5 and r.x > 14 for r in d) and any(abs(r.x - 10) <= 0.5 and r.y > 6 for r in d)

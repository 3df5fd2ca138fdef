"""Queries over spatial and graph operators (inventory group G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.operators import gates, graph, nearest, scene, walk
from floorspan.plans.aggregates import _REACH
from floorspan.plans.registry import query

@query("G1 G2", "v_unit", "SELECT unit_id, true AS inside, false AS outside, round(least(w * 0.25e0, h * 0.25e0) * 1e5, 6) AS edge_distance FROM v_unit")
def g01_even_odd_and_distance(d: DataFrame) -> DataFrame:
    ring = geo.rectangle(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"))
    return d.select(
        "unit_id",
        geo.in_ring(F.col("w") * 0.75, F.col("h") * 0.25, ring).alias("inside"),
        geo.in_ring(F.col("w") * -0.5, F.col("h") * 0.25, ring).alias("outside"),
        F.round(geo.ring_distance(F.col("w") * 0.75, F.col("h") * 0.25, ring) * 1e5, 6).alias("edge_distance"),
    )


@query("G4", "v_unit", "SELECT unit_id, unit_id % 10 > 0 OR false AS walkable, unit_id % 10 >= 2 AS chord_legal FROM v_unit")
def g03_walkable_and_chords(d: DataFrame) -> DataFrame:
    """A 10 m square with a 2 m hole in the middle; points at the hole's centre, at its corner and beside the square."""
    outer, hole = geo.rectangle(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), geo.rectangle(*map(F.lit, (4.0, 4.0, 6.0, 6.0)))
    k = F.col("unit_id") % 10
    px, py = F.when(k == 0, 5.0).when(k == 1, 3.0).otherwise(10.2), F.lit(5.0)
    ok = lambda x, y: walk.walkable(x, y, outer, F.array(hole), 0.3)
    legal = walk.chord_legal(px, py, F.when(k == 2, 9.0).otherwise(7.0), F.when(k == 2, 1.0).otherwise(5.0), ok, 0.5)
    return d.select("unit_id", ok(px, py).alias("walkable"), legal.alias("chord_legal"))


@query("", "v_unit", "SELECT level_id, CAST(count(*) FILTER (WHERE category IN ('walkway', 'ramp', 'platform', 'lobby', 'footbridge')) AS BIGINT) AS polygons, CAST(count(*) FILTER (WHERE category IN ('room', 'unenclosedarea')) AS BIGINT) AS obstacles FROM v_unit GROUP BY 1")
def g06_walkable_floors(d: DataFrame) -> DataFrame:
    from floorspan.functions.text import is_walkway

    return d.groupBy("level_id").agg(F.count_if(is_walkway(F.col("category"))).alias("polygons"), F.count_if(F.col("category").isin("room", "unenclosedarea")).alias("obstacles"))


@query("C9", "v_edge v_node", """SELECT 'dangling_edge' AS code, count(*) AS n FROM v_edge WHERE from_id NOT IN (SELECT node_id FROM v_node) OR to_id NOT IN (SELECT node_id FROM v_node)
  UNION ALL SELECT 'edge', count(*) FROM v_edge WHERE from_id IN (SELECT node_id FROM v_node) AND to_id IN (SELECT node_id FROM v_node)""")
def g07_graph_build(e: DataFrame, n: DataFrame) -> DataFrame:
    lost, kept = graph.dangling(e, n), graph.attach_nodes(e, n)
    return lost.agg(F.count("*").alias("n")).select(F.lit("dangling_edge").alias("code"), "n").union(kept.agg(F.count("*").alias("n")).select(F.lit("edge").alias("code"), "n"))


@query("G10", "v_unit", "SELECT unit_id, round(x + w / 2, 9) AS mid_x, round(y + h / 2, 9) AS mid_y, round(degrees(atan2(h, w)), 6) AS bearing, w * 1e5 > 10 AS review FROM v_unit")
def g10_opening_axis(d: DataFrame) -> DataFrame:
    return d.select("unit_id", F.round(F.col("x") + F.col("w") / 2, 9).alias("mid_x"), F.round(F.col("y") + F.col("h") / 2, 9).alias("mid_y"), F.round(F.degrees(F.atan2("h", "w")), 6).alias("bearing"), (F.col("w") * 1e5 > 10).alias("review"))


@query("G11", "v_edge", "SELECT from_id AS opening, CASE WHEN min(direction) = max(direction) THEN CASE min(direction) WHEN 1 THEN 'forward' WHEN 2 THEN 'reverse' ELSE 'both' END END AS direction FROM v_edge GROUP BY 1")
def g11_doorway_direction(d: DataFrame) -> DataFrame:
    """The direction that all of an opening's relationships agree on, else none."""
    lo, hi = F.min("direction"), F.max("direction")
    name = F.when(lo == hi, F.when(lo == 1, "forward").when(lo == 2, "reverse").otherwise("both"))
    return d.groupBy(F.col("from_id").alias("opening")).agg(name.alias("direction"))


@query("", "v_net v_unit", "SELECT from_id, to_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM v_unit u WHERE u.unit_id = from_id + to_id AND u.category = 'room') THEN 2 ELSE 1 END AS INT) AS rank, cost * CASE WHEN EXISTS (SELECT 1 FROM v_unit u WHERE u.unit_id = from_id + to_id AND u.category = 'room') THEN 3 ELSE 1 END AS cost FROM v_net")
def g12_secondary_rank(e: DataFrame, u: DataFrame) -> DataFrame:
    rooms = u.filter("category = 'room'").select(F.col("unit_id").alias("room"))
    d = e.join(rooms, F.col("from_id") + F.col("to_id") == F.col("room"), "left")
    inside = F.col("room").isNotNull()
    return d.select("from_id", "to_id", F.when(inside, 2).otherwise(1).alias("rank"), (F.col("cost") * F.when(inside, 3).otherwise(1)).alias("cost"))


_PATHS = """r AS (SELECT from_id AS a, to_id AS b, cost AS c FROM v_net WHERE direction IN (0, 1) AND to_id IN (SELECT node_id FROM v_node) UNION ALL SELECT to_id, from_id, cost FROM v_net WHERE direction IN (0, 2) AND to_id IN (SELECT node_id FROM v_node)),
  w(n, c, k) AS (SELECT CAST({start} AS BIGINT), 0e0, 0 UNION ALL SELECT r.b, min(w.c + r.c), max(w.k) + 1 FROM w JOIN r ON w.n = r.a WHERE w.k < {depth} GROUP BY r.b)"""


@query("G17 G16", "v_net v_node", "+" + _PATHS.format(start=8, depth=40) + " SELECT n AS node_id, min(c) AS cost FROM w GROUP BY 1", recursive=True)
def g17_shortest_paths(e: DataFrame, n: DataFrame) -> DataFrame:
    _, e = graph.clip(n, e, n)
    return graph.shortest_costs(graph.adjacency(e), 8)


@query("G18", "v_net v_node", "+" + _PATHS.format(start=8, depth=40) + " SELECT n AS node_id FROM w GROUP BY 1 HAVING min(c) <= 40000", recursive=True)
def g18_bounded_reachability(e: DataFrame, n: DataFrame) -> DataFrame:
    _, e = graph.clip(n, e, n)
    return graph.shortest_costs(graph.adjacency(e), 8, 40000.0).select("node_id")


@query("G19", "v_node v_net", "+" + _REACH + " SELECT node_id, component FROM comp", recursive=True)
def g19_connected_components(n: DataFrame, e: DataFrame) -> DataFrame:
    _, e = graph.clip(n, e, n)
    return graph.connected_components(n, e)


@query("G20", "v_node v_net", "SELECT node_id FROM v_node WHERE node_id NOT IN (SELECT from_id FROM v_net UNION SELECT to_id FROM v_net)")
def g20_isolated_nodes(n: DataFrame, e: DataFrame) -> DataFrame:
    return graph.isolated(n, e).select("node_id")


@query("G21", "v_node v_net", "+" + _REACH + """, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), top AS (SELECT component FROM s ORDER BY size DESC, component LIMIT 1)
  SELECT 'disconnected_component' AS code, component AS node_id, size AS detail FROM s WHERE size > 1 AND component NOT IN (SELECT component FROM top)
  UNION ALL SELECT 'isolated_node', node_id, 1 FROM v_node WHERE node_id NOT IN (SELECT from_id FROM v_net UNION SELECT to_id FROM v_net)""", recursive=True)
def g21_network_findings(n: DataFrame, e: DataFrame) -> DataFrame:
    _, inner = graph.clip(n, e, n)
    found = graph.findings(n, inner)
    ends = e.select(F.col("from_id").alias("node_id")).union(e.select("to_id"))
    return found.filter("code <> 'isolated_node'").union(found.filter("code = 'isolated_node'").join(ends, "node_id", "left_anti").select("code", "node_id", "detail"))


@query("G17", "v_net v_node")
def g13_routes(e: DataFrame, n: DataFrame) -> DataFrame:
    """Cheapest routes with their paths, searched per venue on the workers."""
    _, e = graph.clip(n, e, n)
    a = graph.adjacency(e).withColumn("venue", F.lit(1))
    ids = n.select("node_id")
    requests = ids.select(F.lit(1).alias("venue"), F.col("node_id").alias("request_id"), F.lit(8).cast("long").alias("source"), F.col("node_id").alias("target"))
    return graph.routes(requests, a)


@query("", "v_node")
def g05_route_smoothing(n: DataFrame) -> DataFrame:
    """Routes of each floor with the points left out that a legal chord passes by."""
    return walk.smooth_routes(n.select(F.col("ordinal").alias("route"), F.col("node_id").alias("i"), ((F.col("lon") - 139.76) * 9e4).alias("x"), ((F.col("lat") - 35.68) * 1.1e5).alias("y")), [(20.0, 3.0, 30.0, 12.0)])


@query("G22", "v_node")
def g22_path_proposals(n: DataFrame) -> DataFrame:
    """Shortest ways over a 1 m grid around obstacles, between each floor's first and last node."""
    ends = n.groupBy("ordinal").agg(F.min_by(F.struct("lon", "lat"), "node_id").alias("a"), F.max_by(F.struct("lon", "lat"), "node_id").alias("b"))
    m = lambda c, o, k: ((F.col(c) - o) * k).alias(c.replace(".", "_"))
    return walk.grid_paths(ends.select("ordinal", m("a.lon", 139.76, 9e4), m("a.lat", 35.68, 1.1e5), m("b.lon", 139.76, 9e4), m("b.lat", 35.68, 1.1e5)), [(10.0, 1.0, 12.0, 14.0)])


@query("G23", "v_node", """+a AS (SELECT ordinal, node_id AS i, lon * 1e5 AS x FROM v_node WHERE node_id % 2 = 0), b AS (SELECT ordinal, node_id AS j, lon * 1e5 AS x FROM v_node WHERE node_id % 2 = 1), d AS (SELECT ordinal, i, j, abs(a.x - b.x) AS d FROM a JOIN b USING (ordinal))
  SELECT ordinal, round(max(m), 6) AS hausdorff FROM (SELECT ordinal, min(d) AS m FROM d GROUP BY ordinal, i UNION ALL SELECT ordinal, min(d) FROM d GROUP BY ordinal, j) GROUP BY 1""")
def g23_hausdorff(d: DataFrame) -> DataFrame:
    p = d.select("ordinal", "node_id", (F.col("lon") * 1e5).alias("x"), F.lit(0.0).alias("y"))
    return nearest.hausdorff(p.filter("node_id % 2 = 0"), p.filter("node_id % 2 = 1"), "ordinal", 20.0).select("ordinal", F.round("hausdorff", 6).alias("hausdorff"))


@query("G24", "v_unit", "SELECT unit_id, CAST(4 AS BIGINT) AS n_triangles, CAST((w * 1e8)::BIGINT * (h * 1e8)::BIGINT * 3 AS BIGINT) AS doubled_area FROM v_unit")
def g24_triangulate(d: DataFrame) -> DataFrame:
    """L-shaped rings in integer millimetres, cut into triangles."""
    w, h = (F.col("w") * 1e8).cast("decimal(20,0)").cast("long"), (F.col("h") * 1e8).cast("decimal(20,0)").cast("long")
    p = lambda x, y: F.array(x, y)
    zero = F.lit(0).cast("long")
    ring = F.array(p(zero, zero), p(2 * w, zero), p(2 * w, h), p(w, h), p(w, 2 * h), p(zero, 2 * h))
    done = scene.triangulate(d.select("unit_id", ring.alias("ring")), "unit_id")
    area = F.aggregate("triangles", F.lit(0).cast("long"), lambda acc, t: acc + t["doubled_area"])
    return done.select("unit_id", F.size("triangles").cast("long").alias("n_triangles"), (area / 2).cast("long").alias("doubled_area"))


@query("", "v_unit", """+e AS (SELECT level_id, unnest([CAST(unit_id % 40 AS VARCHAR) || ':' || CAST(floor(unit_id / 40) AS VARCHAR), CAST(unit_id % 40 + 1 AS VARCHAR) || ':' || CAST(floor(unit_id / 40) AS VARCHAR)]) AS k, unnest([1, 2]) AS side FROM v_unit)
  SELECT level_id, k AS wall, count(*) AS uses, count(*) = 1 AS outer_wall FROM e GROUP BY 1, 2""")
def g25_wall_groups(d: DataFrame) -> DataFrame:
    row = F.floor(F.col("unit_id") / 40).cast("double").cast("string")
    key = lambda i: F.concat((F.col("unit_id") % 40 + i).cast("string"), F.lit(":"), row)
    return scene.walls(d.select("level_id", F.explode(F.array(key(0), key(1))).alias("wall")), "level_id", "wall")


@query("", "v_unit", "SELECT level_id || '|' || CAST(building AS VARCHAR) AS tile_level, count(*) AS n, min(h) AS plane FROM v_unit GROUP BY 1")
def g27_tile_levels(d: DataFrame) -> DataFrame:
    return d.groupBy(F.concat_ws("|", "level_id", "building").alias("tile_level")).agg(F.count("*").alias("n"), F.min("h").alias("plane"))


@query("", "v_version", """+g AS (SELECT id, 1 AS rank, 'no_published_version' AS code FROM v_version WHERE status <> 'published' UNION ALL SELECT id, 2, 'missing_bundle' FROM v_version WHERE bundle_hash IS NULL UNION ALL SELECT id, 3, 'stale_sequence' FROM v_version WHERE seq < 5)
  SELECT id, list(code ORDER BY rank) AS codes FROM g GROUP BY 1""")
def g29_activation_gates(d: DataFrame) -> DataFrame:
    return gates.failing(d, "id", [("no_published_version", F.col("status") != "published"), ("missing_bundle", F.col("bundle_hash").isNull()), ("stale_sequence", F.col("seq") < 5)])


@query("", "v_unit v_node", "SELECT unit_id, CASE WHEN CAST(building % 9 - 4 AS DOUBLE) IN (SELECT ordinal FROM v_node) THEN level_id END AS anchor FROM v_unit WHERE category = 'restroom.female'")
def g30_facility_anchors(u: DataFrame, n: DataFrame) -> DataFrame:
    floors = n.select("ordinal").distinct().withColumn("known", F.lit(True))
    d = u.filter("category = 'restroom.female'").withColumn("ordinal", (F.col("building") % 9 - 4).cast("double"))
    return d.join(floors, "ordinal", "left").select("unit_id", F.when(F.col("known"), F.col("level_id")).alias("anchor"))


@query("G31", "v_layer", """+b AS (SELECT DISTINCT layer FROM v_layer WHERE p_size >= 49 AND p_brand = 'Brand#1') SELECT layer, count(*) AS n FROM v_layer WHERE layer NOT IN (SELECT layer FROM b) GROUP BY 1""")
def g31_exclude_failing_layers(d: DataFrame) -> DataFrame:
    bad = d.filter("p_size >= 49 and p_brand = 'Brand#1'").select("layer").distinct()
    return d.join(bad, "layer", "left_anti").groupBy("layer").agg(F.count("*").alias("n"))


@query("G32", "v_net", """SELECT from_id, to_id, cost FROM v_net WHERE from_id <> 8 AND to_id <> 8 AND NOT (from_id = 9 AND to_id % 2 = 0) UNION ALL SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT), CAST(5 AS DOUBLE)""")
def g32_network_edits(e: DataFrame) -> DataFrame:
    edits = [("delete_node", 8), ("delete_edges", F.expr("from_id = 9 and to_id % 2 = 0")), ("add_edge", (1, 2, 5.0))]
    return gates.edit_network(e.select("from_id", "to_id", "cost"), edits)

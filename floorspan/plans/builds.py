"""Queries over graph building, export, walkable floors, smoothing and the review state (inventory groups A, B, C, D, F, G and H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo, lookups, text
from floorspan.operators import building, changes, graph, nearest, walk
from floorspan.operators.spatial import range_join
from floorspan.plans.registry import query


_BUILD = """+j AS (SELECT s_suppkey AS place, s_suppkey % 90 AS node_id, CASE s_suppkey % 7 WHEN 0 THEN 'F1' WHEN 1 THEN 'B2' WHEN 2 THEN 'F3' WHEN 3 THEN 'M9' WHEN 4 THEN 'hall' WHEN 5 THEN 'F2' END AS floor, s_acctbal AS lon, 35e0 AS lat FROM supplier),
  o AS (SELECT *, CASE floor WHEN 'F1' THEN 0e0 WHEN 'B2' THEN -2e0 WHEN 'F3' THEN 2e0 WHEN 'M9' THEN 9e0 WHEN 'F2' THEN 1e0 END AS ordinal FROM j WHERE floor IS NOT NULL),
  n AS (SELECT node_id, arg_max(ordinal, place) AS ordinal FROM o WHERE ordinal IS NOT NULL GROUP BY 1),
  e AS (SELECT from_id * 100000 + to_id AS place, from_id, to_id, CASE WHEN cost > 48000 THEN -1e0 ELSE cost END AS cost, CASE WHEN to_id % 3 = 0 THEN 'F5' END AS floor, CASE WHEN (from_id + to_id) % 17 = 0 THEN 7 ELSE from_id * 100000 + to_id END AS path_id,
    CASE WHEN (from_id + to_id) % 17 = 0 THEN 8 WHEN (from_id + to_id) % 19 = 0 THEN NULL ELSE to_id * 100000 + from_id END AS back_id, 1 + (from_id + to_id) % 4 AS inner_points, (from_id * to_id) % 5 AS kind FROM v_net),
  known AS (SELECT e.*, a.ordinal AS from_ordinal FROM e JOIN n a ON from_id = a.node_id JOIN n b ON to_id = b.node_id),
  good AS (SELECT *, CASE WHEN floor = 'F5' THEN 4e0 ELSE from_ordinal END AS ordinal FROM known WHERE cost >= 0),
  kept AS (SELECT a.* FROM good a LEFT JOIN good b ON a.path_id = b.back_id AND a.back_id = b.path_id AND a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.back_id IS NULL OR b.place IS NULL OR a.path_id < a.back_id)"""


def _layers(supplier: DataFrame, net: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    floor = F.when(k % 7 == 0, "F1").when(k % 7 == 1, "B2").when(k % 7 == 2, "F3").when(k % 7 == 3, "M9").when(k % 7 == 4, "hall").when(k % 7 == 5, "F2")
    junctions = supplier.select(k.alias("place"), (k % 90).alias("node_id"), floor.alias("floor"), F.col("s_acctbal").cast("double").alias("lon"), F.lit(35.0).alias("lat"))
    a, b = F.col("from_id"), F.col("to_id")
    point = lambda i: F.struct(i.cast("double").alias("x"), F.lit(35.0).alias("y"))
    line = F.transform(F.sequence(F.lit(0), (a + b) % 4 + 2), point)
    props = F.to_json(
        F.struct(
            F.when(a * b % 5 == 0, "vertical").when(a * b % 5 == 1, "bridge").when(a * b % 5 == 2, "vertical").when(a * b % 5 == 3, "unheard").alias("EDGE_KIND"), F.when(a * b % 5 == 0, "stairs").when(a * b % 5 == 4, "stairs").alias("TRANSITION_CATEGORY"),
            F.when(a % 2 == 0, 2).alias("PATHWAY_RANK"), F.lit(0.75).alias("CLEARANCE_M"), F.col("direction"), (a % 6 == 0).cast("int").alias("BARRIER"), F.when(b % 2 == 0, 480).alias("STARTTIME"),
        )
    )
    return junctions, net.select(
        (a * 100000 + b).alias("place"), "from_id", "to_id", F.when(F.col("cost") > 48000, -1.0).otherwise(F.col("cost")).alias("cost"), F.when(b % 3 == 0, "F5").alias("floor"), F.when((a + b) % 17 == 0, 7).otherwise(a * 100000 + b).alias("path_id"),
        F.when((a + b) % 17 == 0, 8).when((a + b) % 19 != 0, b * 100000 + a).alias("back_id"), line.alias("line"), props.alias("properties"),
    )


@query("G7 F43 F47", "supplier v_net v_level", _BUILD + """ SELECT from_id, to_id, cost, ordinal, inner_points, CASE kind WHEN 0 THEN 'vertical' WHEN 1 THEN 'bridge' ELSE 'imported' END AS kind, CASE WHEN kind = 0 THEN 'stairs' END AS vertical, CAST(CASE WHEN kind IN (0, 1, 3) AND from_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS rank,
  CASE WHEN kind IN (0, 1, 3) THEN 0.75e0 END AS clearance, from_id % 6 = 0 AS barrier, CAST(CASE WHEN to_id % 2 = 0 THEN 480 ELSE -1 END AS INT) AS start_minute FROM kept""")
def g07_graph_edges(supplier: DataFrame, net: DataFrame, level: DataFrame) -> DataFrame:
    """Edges of a graph from its layers, with bends and attributes; a pair of paths that name each other is one edge."""
    _, edges, _ = building.build(*_layers(supplier, net), level)
    return edges.select("from_id", "to_id", "cost", "ordinal", F.size("interior").cast("long").alias("inner_points"), "kind", "vertical", "rank", "clearance", "barrier", "start_minute")


@query("G7 G21", "supplier v_net v_level", _BUILD + """ SELECT code, n FROM (SELECT 'unmapped_floor' AS code, count(*) AS n FROM o WHERE ordinal IS NULL UNION ALL SELECT 'dangling_edge', count(*) FROM e WHERE from_id NOT IN (SELECT node_id FROM n) OR to_id NOT IN (SELECT node_id FROM n)
  UNION ALL SELECT 'invalid_cost', count(*) FROM known WHERE cost < 0 UNION ALL SELECT 'unmatched_level', count(*) FROM n WHERE ordinal NOT IN (SELECT ordinal FROM v_level)
  UNION ALL SELECT 'reciprocal_conflict', CAST(sum(m - 1) AS BIGINT) FROM (SELECT count(*) AS m FROM kept WHERE back_id IS NOT NULL GROUP BY least(path_id, back_id), greatest(path_id, back_id) HAVING count(*) > 1)) WHERE n > 0""")
def g07_graph_warnings(supplier: DataFrame, net: DataFrame, level: DataFrame) -> DataFrame:
    _, _, warnings = building.build(*_layers(supplier, net), level)
    return warnings.groupBy("code").agg(F.count("*").alias("n"))


@query("A25", "v_node v_net", """SELECT node_id, count(e) AS path_count, CASE WHEN ordinal >= 0 THEN 'F' || CAST(CAST(ordinal AS INT) + 1 AS VARCHAR) ELSE 'B' || CAST(CAST(-ordinal AS INT) AS VARCHAR) END AS floor, ordinal * 4 AS altitude
  FROM v_node LEFT JOIN (SELECT from_id AS e FROM v_net UNION ALL SELECT to_id FROM v_net) ON node_id = e GROUP BY node_id, ordinal""")
def a25_export_junctions(node: DataFrame, net: DataFrame) -> DataFrame:
    """Junctions with the number of their paths, floor labels and nominal altitudes."""
    return building.export_junctions(node, net)


@query("A25", "v_node v_net", """+k AS (SELECT row_number() OVER (ORDER BY e.from_id, e.to_id) - 1 AS i, e.*, a.ordinal AS fo, b.ordinal AS t_o, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM v_net e JOIN v_node a ON e.from_id = a.node_id JOIN v_node b ON e.to_id = b.node_id),
  s AS (SELECT *, CAST(round(2 * 6371000e0 * asin(least(1e0, sqrt(power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))) / 1.4) AS BIGINT) AS seconds,
    CASE WHEN fo >= 0 THEN 'F' || CAST(CAST(fo AS INT) + 1 AS VARCHAR) ELSE 'B' || CAST(CAST(-fo AS INT) AS VARCHAR) END AS fl, CASE WHEN t_o >= 0 THEN 'F' || CAST(CAST(t_o AS INT) + 1 AS VARCHAR) ELSE 'B' || CAST(CAST(-t_o AS INT) AS VARCHAR) END AS tl FROM k)
  SELECT 2 * i + 1 AS path_id, 2 * i + 2 AS back_id, from_id, to_id, CASE WHEN fo <> t_o THEN fl END AS from_floor, CASE WHEN fo <> t_o THEN tl END AS to_floor, cost, seconds, fl AS floor, fo <> t_o AS vertical, CASE WHEN direction > 0 THEN direction END AS direction, barrier = 1 AS barrier FROM s
  UNION ALL SELECT 2 * i + 2, 2 * i + 1, to_id, from_id, CASE WHEN fo <> t_o THEN tl END, CASE WHEN fo <> t_o THEN fl END, cost, seconds, fl, fo <> t_o, CASE WHEN direction > 0 THEN direction END, barrier = 1 FROM s""")
def a25_export_paths(node: DataFrame, net: DataFrame) -> DataFrame:
    """Paths there and back with ids, seconds of walking, floors and flags."""
    end = lambda k: node.select(F.col("node_id").alias(f"{k}_id"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias(f"_{k}"), F.col("ordinal").alias(f"_o{k}"))
    d = net.join(end("from"), "from_id").join(end("to"), "to_id")
    d = graph.dense_index(d.withColumn("_key", F.struct("from_id", "to_id")), "_key")
    d = d.select(F.col("node_index").alias("edge_index"), "from_id", "to_id", "cost", F.col("_ofrom").alias("ordinal"), F.array("_from", "_to").alias("line"), "direction", (F.col("barrier") == 1).alias("barrier"))
    return building.export_paths(d, node)


_METRES = "(lon - 139.76) * 9e4 AS px, (lat - 35.68) * 1.1e5 AS py"


def _boxes(unit: DataFrame, level: DataFrame) -> DataFrame:
    """Units in metres with their floor's ordinal."""
    d = unit.join(level.select("level_id", "ordinal"), "level_id")
    west, south = (F.col("x") - 139.76) * 9e4, (F.col("y") - 35.68) * 1.1e5
    return d.select("unit_id", "ordinal", "category", west.alias("west"), south.alias("south"), (west + F.col("w") * 9e4).alias("east"), (south + F.col("h") * 1.1e5).alias("north"))


_BOXES = "b AS (SELECT unit_id, ordinal, category, (x - 139.76) * 9e4 AS west, (y - 35.68) * 1.1e5 AS south, (x - 139.76) * 9e4 + w * 9e4 AS east, (y - 35.68) * 1.1e5 + h * 1.1e5 AS north FROM v_unit JOIN v_level USING (level_id))"
_OUTLINES = "s AS (SELECT unit_id, ordinal, category, west AS x1, south AS y1, east AS x2, south AS y2 FROM b UNION ALL SELECT unit_id, ordinal, category, east, south, east, north FROM b UNION ALL SELECT unit_id, ordinal, category, east, north, west, north FROM b UNION ALL SELECT unit_id, ordinal, category, west, north, west, south FROM b)"
_WALK = "'walkway', 'ramp', 'platform', 'lobby', 'footbridge'"


def _outlines(boxes: DataFrame) -> DataFrame:
    side = lambda a, b, c, d: F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2"))
    sides = F.array(side("west", "south", "east", "south"), side("east", "south", "east", "north"), side("east", "north", "west", "north"), side("west", "north", "west", "south"))
    return boxes.select("unit_id", "ordinal", "category", F.explode(sides).alias("s")).select("unit_id", "ordinal", "category", "s.*")


@query("C15", "v_node v_unit_stack v_level", f"""+{_BOXES.replace('v_unit', 'v_unit_stack')}, {_OUTLINES}, p AS (SELECT node_id, ordinal, {_METRES} FROM v_node),
  d AS (SELECT node_id, unit_id, px - (x1 + (x2 - x1) * t) AS dx, py - (y1 + (y2 - y1) * t) AS dy FROM (SELECT *, greatest(0e0, least(1e0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM p JOIN s ON p.ordinal = s.ordinal WHERE category IN ({_WALK})))
  SELECT node_id AS opening_id, unit_id AS hub_id, round(min(sqrt(dx * dx + dy * dy)), 6) AS distance FROM d GROUP BY 1, 2 HAVING min(sqrt(dx * dx + dy * dy)) <= 3""")
def c15_openings_near_hubs(node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """Hubs whose outline is within 3 m of an opening of their floor; units are stacked on 40 x 40 places."""
    hubs = _outlines(_boxes(unit, level).filter(text.is_walkway(F.col("category")))).select(F.col("unit_id").alias("hub_id"), "ordinal", "x1", "y1", "x2", "y2")
    points = node.select(F.col("node_id").alias("opening_id"), "ordinal", ((F.col("lon") - 139.76) * 9e4).alias("x"), ((F.col("lat") - 35.68) * 1.1e5).alias("y"))
    found, _ = building.openings_near_hubs(points, hubs, 4.0)
    return found.select("opening_id", "hub_id", F.round("distance", 6).alias("distance"))


@query("G12", "v_net v_node v_unit v_level", f"""+{_BOXES}, e AS (SELECT from_id, to_id, a.ordinal, cost, (a.lon + c.lon) / 2 AS lon, (a.lat + c.lat) / 2 AS lat, CASE (from_id + to_id) % 4 WHEN 0 THEN 'doorway' WHEN 1 THEN 'bridge' ELSE 'skeleton' END AS kind FROM v_net JOIN v_node a ON from_id = a.node_id JOIN v_node c ON to_id = c.node_id),
  m AS (SELECT *, {_METRES} FROM e), i AS (SELECT *, kind <> 'doorway' AND EXISTS (SELECT 1 FROM b WHERE b.ordinal = m.ordinal AND category = 'room' AND px > west AND px < east AND py > south AND py < north) AS inside FROM m)
  SELECT from_id * 100000 + to_id AS edge_id, CAST(CASE WHEN inside THEN 2 ELSE 1 END AS INT) AS rank, cost * CASE WHEN inside THEN 3e0 ELSE 1e0 END AS cost FROM i""")
def g12_room_crossings(net: DataFrame, node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """Edges whose middle lies in a room of their floor cost three times as much."""
    end = lambda k: node.select(F.col("node_id").alias(f"{k}_id"), F.col("lon").alias(f"x_{k}"), F.col("lat").alias(f"y_{k}"), F.col("ordinal").alias(f"o_{k}"))
    e = net.join(end("from"), "from_id").join(end("to"), "to_id")
    k = (F.col("from_id") + F.col("to_id")) % 4
    middle = lambda c: (F.col(f"{c}_from") + F.col(f"{c}_to")) / 2
    e = e.select((F.col("from_id") * 100000 + F.col("to_id")).alias("edge_id"), F.when(k == 0, "doorway").when(k == 1, "bridge").otherwise("skeleton").alias("kind"), F.col("o_from").alias("ordinal"), ((middle("x") - 139.76) * 9e4).alias("x"), ((middle("y") - 35.68) * 1.1e5).alias("y"), "cost")
    rooms = _boxes(unit, level).filter("category = 'room'").select("ordinal", "west", "south", "east", "north")
    return building.rank_room_crossings(e, rooms, 10.0)


_PARTS = f"""+f AS (SELECT ordinal, CASE WHEN unit_id % 15 = 2 THEN 'opening' WHEN unit_id % 15 = 7 THEN 'kiosk' WHEN unit_id % 15 = 8 THEN 'anchor' ELSE 'unit' END AS feature_type, category, unit_id FROM v_unit JOIN v_level USING (level_id)),
  p AS (SELECT ordinal, unit_id, CASE WHEN feature_type = 'unit' AND category IN ({_WALK}) THEN 'area' WHEN feature_type = 'unit' AND category IN ('elevator', 'escalator', 'stairs') THEN 'lock' WHEN feature_type IN ('unit', 'kiosk') THEN 'obstacle' WHEN feature_type = 'opening' THEN 'lock' END AS part FROM f)"""


def _parts(unit: DataFrame, level: DataFrame) -> DataFrame:
    k = F.col("unit_id") % 15
    d = _boxes(unit, level).withColumn("feature_type", F.when(k == 2, "opening").when(k == 7, "kiosk").when(k == 8, "anchor").otherwise("unit"))
    d = d.withColumns({"ring": geo.rectangle(*map(F.col, ("west", "south", "east", "north"))), "x": (F.col("west") + F.col("east")) / 2, "y": (F.col("south") + F.col("north")) / 2})
    return walk.floor_parts(d, text.is_walkway(F.col("category")), text.is_transit(F.col("category")))


@query("G6", "v_unit v_level", _PARTS + " SELECT ordinal, part, count(*) AS n FROM p WHERE part IS NOT NULL AND ordinal IN (SELECT ordinal FROM p WHERE part IN ('area', 'lock')) GROUP BY 1, 2")
def g06_walkable_parts(unit: DataFrame, level: DataFrame) -> DataFrame:
    """Areas, obstacles and locks of each floor."""
    return _parts(unit, level).groupBy("ordinal", "part").agg(F.count("*").alias("n"))


@query("G1 G3", "v_node v_unit v_level", f"""+{_BOXES}, p AS (SELECT node_id, ordinal, (lon - 139.76) * 9e4 + 1e0 AS px, (lat - 35.68) * 1.1e5 - 0.2e0 AS py FROM v_node)
  SELECT node_id, EXISTS (SELECT 1 FROM b WHERE b.ordinal = p.ordinal AND category IN ({_WALK}) AND px > west - 0.3 AND px < east + 0.3 AND py > south - 0.3 AND py < north + 0.3 AND power(greatest(west - px, 0, px - east), 2) + power(greatest(south - py, 0, py - north), 2) <= 0.09)
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.ordinal = p.ordinal AND category = 'room' AND px > west AND px < east AND py > south AND py < north) AS walkable FROM p""")
def g03_walkable_points(node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """Points inside an area of their floor or up to 0.3 m beside it, and in no obstacle; both meet in grid cells."""
    points = node.select("node_id", "ordinal", ((F.col("lon") - 139.76) * 9e4 + 1.0).alias("px"), ((F.col("lat") - 35.68) * 1.1e5 - 0.2).alias("py"))
    boxes = _boxes(unit, level)
    wide = boxes.filter(text.is_walkway(F.col("category"))).withColumn("ring", geo.rectangle(*map(F.col, ("west", "south", "east", "north")))).select("ordinal", "ring", *[(F.col(c) + d * 0.3).alias(c) for c, d in (("west", -1), ("south", -1), ("east", 1), ("north", 1))])
    box = [F.col(c) for c in ("west", "south", "east", "north")]
    near = range_join(points, wide, F.col("px"), F.col("py"), box, 10.0, "ordinal")
    near = near.filter(geo.in_ring(F.col("px"), F.col("py"), F.col("ring")) | (geo.ring_distance(F.col("px"), F.col("py"), F.col("ring")) <= walk.OUTSIDE_M)).select("node_id").distinct()
    blocked = range_join(points, boxes.filter("category = 'room'").select("ordinal", *box), F.col("px"), F.col("py"), box, 10.0, "ordinal").select("node_id").distinct()
    d = points.join(near.withColumn("near", F.lit(True)), "node_id", "left").join(blocked.withColumn("blocked", F.lit(True)), "node_id", "left")
    return d.select("node_id", (F.coalesce("near", F.lit(False)) & F.col("blocked").isNull()).alias("walkable"))


def _segments(node: DataFrame) -> DataFrame:
    """A route along each floor's rows of nodes, in metres."""
    point = F.struct(F.col("node_id").alias("i"), ((F.col("lon") - 139.76) * 9e4 + 1.0).alias("x"), ((F.col("lat") - 35.68) * 1.1e5 + 1.0).alias("y"))
    d = node.groupBy("ordinal", F.floor(F.col("node_id") / 40).alias("route_id")).agg(F.array_sort(F.collect_list(point)).alias("p")).filter(F.size("p") > 1)  # 40 nodes at most
    return d.select("route_id", F.lit(0).alias("segment"), "ordinal", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))


@query("G4 G5", "v_node v_unit v_level")
def g05_smoothed_segments(node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """Route segments without the points that a legal chord over their floor passes by."""
    return walk.smooth_on_floors(_segments(node), _parts(unit, level)).select("route_id", "ordinal", "n_points", "points")


@query("D20", "v_node v_unit v_level")
def d20_smoothing_quality(node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """How many points and how much of the length smoothing leaves; null without a segment."""
    raw = _segments(node)
    done = walk.smooth_on_floors(raw, _parts(unit, level))
    step = lambda p: F.aggregate(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.sqrt(F.pow(F.get(p, i)["x"] - F.get(p, i - 1)["x"], 2) + F.pow(F.get(p, i)["y"] - F.get(p, i - 1)["y"], 2))), F.lit(0.0), lambda a, x: a + x)
    before = raw.agg(F.count("*").alias("segments"), F.sum(F.size("points")).alias("raw_points"), F.sum(step(F.col("points"))).alias("raw_m"))
    after = done.agg(F.sum(F.size("points")).alias("left_points"), F.sum(step(F.col("points"))).alias("m"))
    d = before.withColumn("one", F.lit(1)).join(after.withColumn("one", F.lit(1)), "one")  # one row each
    return d.select("segments", F.round(F.col("left_points") / F.col("raw_points"), 6).alias("vertex_retention"), F.round(F.col("m") / F.col("raw_m"), 6).alias("length_ratio"))


@query("D20", "v_node v_unit v_level", f"""+{_BOXES}, k AS (SELECT *, CASE WHEN unit_id % 15 = 2 THEN 'lock' WHEN unit_id % 15 IN (7, 8) THEN 'none' WHEN category IN ({_WALK}) THEN 'area' WHEN category IN ('elevator', 'escalator', 'stairs') THEN 'lock' ELSE 'none' END AS part FROM b),
  p AS (SELECT node_id, ordinal, floor(node_id / 40) AS route, (lon - 139.76) * 9e4 + 1 AS px, (lat - 35.68) * 1.1e5 + 1 AS py, count(*) OVER (PARTITION BY ordinal, floor(node_id / 40)) AS n FROM v_node),
  d AS (SELECT p.*, EXISTS (SELECT 1 FROM k WHERE k.ordinal = p.ordinal AND part = 'area' AND CASE WHEN px > west AND px < east AND py > south AND py < north THEN least(px - west, east - px, py - south, north - py)
      ELSE sqrt(power(greatest(west - px, 0, px - east), 2) + power(greatest(south - py, 0, py - north), 2)) END < 0.6) AND NOT EXISTS (SELECT 1 FROM k WHERE k.ordinal = p.ordinal AND part = 'lock' AND sqrt(power(px - (west + east) / 2, 2) + power(py - (south + north) / 2, 2)) < 0.4) AS near FROM p WHERE n > 1),
  r AS (SELECT ordinal, route, count(*) AS n, count(*) FILTER (WHERE near) AS near FROM d GROUP BY 1, 2) SELECT count(*) AS routed, CAST(sum(n) AS BIGINT) AS vertices, max(near) AS near_wall_max, round(avg(near), 6) AS near_wall_mean FROM r""")
def d20_near_walls(node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """How many vertices of a route hug the boundary of an area, at most and on average, doors and transit units left out."""
    raw = _segments(node)
    points = raw.select("route_id", "ordinal", F.posexplode("points").alias("at", "p")).select("route_id", "ordinal", "at", "p.x", "p.y")
    near = walk.near_walls(points, _parts(unit, level), ["route_id", "ordinal", "at"]).groupBy("route_id", "ordinal").agg(F.count("*").alias("near"))
    d = raw.select("route_id", "ordinal", F.size("points").alias("n")).join(near, ["route_id", "ordinal"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    return d.agg(F.count("*").alias("routed"), F.sum("n").cast("long").alias("vertices"), F.max("near").alias("near_wall_max"), F.round(F.avg("near"), 6).alias("near_wall_mean"))


@query("G23", "v_node", """+p AS (SELECT ordinal, node_id, (lon - 139.76) * 9e4 AS x, (lat - 35.68) * 1.1e5 AS y FROM v_node), d AS (SELECT a.ordinal, a.node_id AS i, b.node_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.ordinal = b.ordinal AND a.node_id % 2 = 0 AND b.node_id % 2 = 1)
  SELECT ordinal, round(max(m), 6) AS hausdorff FROM (SELECT ordinal, min(d) AS m FROM d GROUP BY ordinal, i UNION ALL SELECT ordinal, min(d) FROM d GROUP BY ordinal, j) GROUP BY 1""")
def g23_hausdorff_of_lines(node: DataFrame) -> DataFrame:
    """The symmetric distance of two sampled lines of each floor, nearest points found by growing grid cells."""
    p = node.select("ordinal", "node_id", ((F.col("lon") - 139.76) * 9e4).alias("x"), ((F.col("lat") - 35.68) * 1.1e5).alias("y"))
    return nearest.hausdorff(p.filter("node_id % 2 = 0"), p.filter("node_id % 2 = 1"), "ordinal", 20.0).select("ordinal", F.round("hausdorff", 6).alias("hausdorff"))


@query("B15", "v_unit", "SELECT unit_id, CASE unit_id % 4 WHEN 0 THEN NULL WHEN 1 THEN x ELSE round(x + w / 2, 9) END AS center_x FROM v_unit")
def b15_centres(d: DataFrame) -> DataFrame:
    """The centre of a geometry's points where they are finite: a geometry without such points isn't usable."""
    k = F.col("unit_id") % 4
    point = lambda x: F.struct(x.alias("x"), F.col("y").alias("y"))
    none = F.array().cast("array<struct<x: double, y: double>>")
    line = F.when(k == 0, none).when(k == 1, F.array(point(F.col("x")), point(F.lit(float("nan"))))).when(k == 2, F.array(point(F.col("x")), point(F.col("x") + F.col("w")))).otherwise(geo.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    finite = F.filter(line, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    low, high = F.array_min(F.transform(finite, lambda p: p["x"])), F.array_max(F.transform(finite, lambda p: p["x"]))
    return d.select("unit_id", F.when(k == 1, low).otherwise(F.round((low + high) / 2, 9)).alias("center_x"))


@query("F37", "embeddings", """+e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT vec_id, true AS near, true AS unit_length FROM e""")
def f37_normals_there_and_back(d: DataFrame) -> DataFrame:
    """Directions that were encoded and decoded are within a thousandth of what they were."""
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    size = F.sqrt(x * x + y * y + z * z)
    d = d.select("vec_id", *[(c / size).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))], lookups.direction(lookups.octahedral(x, y, z)).alias("v"))
    v = F.col("v")
    near = (F.abs(v["x"] - F.col("x")) < 1e-3) & (F.abs(v["y"] - F.col("y")) < 1e-3) & (F.abs(v["z"] - F.col("z")) < 1e-3)
    return d.select("vec_id", near.alias("near"), (F.abs(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"] - 1) < 1e-6).alias("unit_length"))


@query("F38", "embeddings", "SELECT vec_id, [1e0, 0e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 0e0, 1e0] AS identity FROM embeddings")
def f38_matrix_inverse(d: DataFrame) -> DataFrame:
    """A matrix times its inverse."""
    m = F.transform(F.slice("embedding", 1, 16), lambda v, i: v.cast("double") + F.when(i % 5 == 0, 9.0).otherwise(0.0))
    return d.select("vec_id", F.transform(lookups.product(m, lookups.inverse(m)), lambda v: F.abs(F.round(v, 6))).alias("identity"))


@query("H13", "v_version v_job", """+p AS (SELECT id AS job_id, version_id, 'h' || CAST(id % 5 AS VARCHAR) AS bundle, id % 3 <> 0 AS same, created_at FROM v_job WHERE status = 'done'),
  w AS (SELECT version_id, arg_max(bundle, (created_at, job_id)) AS bundle FROM p WHERE same GROUP BY 1)
  SELECT v.id, CASE WHEN w.version_id IS NOT NULL AND status = 'draft' THEN 'published' ELSE status END AS status, CASE WHEN w.version_id IS NOT NULL AND status = 'draft' THEN w.bundle ELSE bundle_hash END AS bundle_hash FROM v_version v LEFT JOIN w ON v.id = w.version_id""")
def h13_publish(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Compiled drafts are published where their identity is still the one that the job had read, and the last job wins."""
    done = jobs.filter("status = 'done'").withColumns({"bundle": F.concat(F.lit("h"), (F.col("id") % 5).cast("string")), "read_seq": F.when(F.col("id") % 3 == 0, -1)})
    read = done.join(versions.select(F.col("id").alias("version_id"), F.col("seq").alias("now"), "public_id"), "version_id").withColumn("seq", F.coalesce("read_seq", "now"))
    return changes.publish(versions, read.select("version_id", F.col("id").alias("job_id"), "created_at", "bundle", "seq", "public_id"), ["seq", "public_id"])


@query("H14", "v_version", """SELECT id, CASE WHEN status = 'published' AND bundle_hash = 'b' || CAST(id % 90 AS VARCHAR) THEN 'new-' || bundle_hash ELSE bundle_hash END AS bundle_hash FROM v_version""")
def h14_recompile_legacy(versions: DataFrame) -> DataFrame:
    """Published versions whose bundle is their source itself are compiled again; all others stay."""
    d = versions.withColumn("source_hash", F.concat(F.lit("b"), (F.col("id") % 90).cast("string")))
    return changes.recompiled(d, F.concat(F.lit("new-"), "source_hash")).select("id", "bundle_hash")


@query("H17", "v_issue", """+e AS (SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY id) AS revision FROM v_issue), s AS (SELECT DISTINCT version_id, version_id * 7 % 50 AS last_id, CASE WHEN version_id % 3 = 0 THEN 40 ELSE 5 END AS current FROM e)
  SELECT s.version_id, greatest(current, coalesce(max(revision), 0)) AS first_event, count(revision) FILTER (WHERE revision > last_id AND revision < greatest(current, (SELECT coalesce(max(revision), 0) FROM e x WHERE x.version_id = s.version_id))) AS superseded FROM s LEFT JOIN e ON s.version_id = e.version_id GROUP BY s.version_id, current, last_id""")
def h17_first_events(issues: DataFrame) -> DataFrame:
    """What a subscriber gets first: the higher of the current revision and those that were buffered, which supersedes all between."""
    n = graph_numbers(issues)
    subscribers = n.select("version_id").distinct().withColumns({"last_id": F.col("version_id") * 7 % 50, "current": F.when(F.col("version_id") % 3 == 0, 40).otherwise(5)})
    return changes.first_events(subscribers, n)


def graph_numbers(issues: DataFrame) -> DataFrame:
    """Issues of each version numbered from 1 as its revisions."""
    return changes.number_within(issues.select("version_id", "id"), "version_id", ["id"], F.lit(0)).select("version_id", F.col("number").alias("revision"))


_REDUCER = """+a AS (SELECT l_orderkey AS version_id, l_linenumber AS i, CASE WHEN l_partkey % 2 = 0 THEN 'observed' ELSE 'fetched' END AS action, l_suppkey % 9 AS revision FROM lineitem),
  b AS (SELECT *, max(revision) OVER (PARTITION BY version_id ORDER BY i) AS observed, max(CASE WHEN action = 'fetched' THEN revision END) OVER (PARTITION BY version_id ORDER BY i) AS applied FROM a)
  SELECT version_id, i, CAST(observed AS BIGINT) AS observed, CAST(coalesce(applied, 0) AS BIGINT) AS applied, applied IS NOT NULL AND observed > applied AS stale, CASE WHEN action = 'fetched' THEN revision >= applied END AS accepted FROM b"""


@query("H18", "lineitem", _REDUCER)
def h18_revision_reducer(d: DataFrame) -> DataFrame:
    """Applied and observed revisions after each action; an older collection isn't accepted, and one behind what was observed is stale."""
    a = d.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("i"), F.when(F.col("l_partkey") % 2 == 0, "observed").otherwise("fetched").alias("action"), (F.col("l_suppkey") % 9).alias("revision"))
    return changes.reduced(a, "version_id", "i")


@query("H20", "lineitem")
def h20_editor_histories(d: DataFrame) -> DataFrame:
    """What an editor shows after each of its edits, undos and redos."""
    k = F.col("l_partkey") % 5
    actions = d.select(F.col("l_orderkey").alias("editor"), F.col("l_linenumber").alias("i"), F.when(k < 3, "edit").when(k == 3, "undo").otherwise("redo").alias("action"), F.col("l_suppkey").alias("value"))
    return changes.histories(actions, "editor", "i", "value")


@query("B19", "part v_node", """+f AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 6 WHEN 0 THEN 0e0 WHEN 1 THEN -2e0 WHEN 2 THEN 1e0 ELSE 8e0 END AS ordinal FROM part) SELECT id, name, 0e0 IN (SELECT ordinal FROM v_node) AS has_anchor FROM f WHERE ordinal = 0""")
def b19_facilities_of_a_floor(d: DataFrame, node: DataFrame) -> DataFrame:
    """A floor's facilities, and whether a route can lead to them."""
    k = F.col("p_partkey") % 6
    rows = d.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(k == 0, 0.0).when(k == 1, -2.0).when(k == 2, 1.0).otherwise(8.0).alias("ordinal")).filter("ordinal = 0")
    floor = node.select("ordinal").distinct().withColumn("has_anchor", F.lit(True))
    return rows.join(floor, "ordinal", "left").select("id", "name", F.coalesce("has_anchor", F.lit(False)).alias("has_anchor"))


@query("B22", "v_level v_unit", """+s AS (SELECT unit_id AS scene, level_id, ordinal FROM v_unit JOIN v_level USING (level_id)), a AS (SELECT ordinal AS o FROM v_level WHERE level_id = 'L3')
  SELECT scene, CASE WHEN level_id = 'L3' THEN 'active' ELSE 'context' END AS state FROM s, a WHERE level_id = 'L3' OR (ordinal IN (1, -1) AND ordinal <> o)""")
def b22_floor_state(level: DataFrame, unit: DataFrame) -> DataFrame:
    """Scene levels of the active level, and those of the route's next floor and of a link's far floor as context."""
    scenes = unit.select(F.col("unit_id").alias("scene"), "level_id").join(level.select("level_id", "ordinal"), "level_id")
    active = level.filter("level_id = 'L3'").select(F.col("ordinal").alias("o"))
    context = scenes.filter(F.col("ordinal").isin(1.0, -1.0)).join(active, F.col("ordinal") == F.col("o"), "left_anti").filter("level_id <> 'L3'")
    return scenes.filter("level_id = 'L3'").select("scene", F.lit("active").alias("state")).union(context.select("scene", F.lit("context")))



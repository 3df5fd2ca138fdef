"""Queries over joins and predicates (inventory groups B and C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.operators import building, graph, relational
from floorspan.plans.registry import query
from floorspan.plans.scalars import _HAV


@query("B9 F13 E10", "v_entry", """+s AS (SELECT feature_id, label, CASE WHEN label = 'gear' THEN 500 WHEN alt_label = 'gear' THEN 450 WHEN starts_with(label, 'gear') THEN 400 WHEN starts_with(alt_label, 'gear') THEN 350 WHEN contains(label, 'gear') THEN 300
    WHEN contains(alt_label, 'gear') THEN 250 WHEN contains(coalesce(category, ''), 'gear') OR contains(feature_type, 'gear') THEN 200 ELSE 0 END AS score, level_id FROM v_entry WHERE feature_type IN ('amenity', 'kiosk'))
  SELECT feature_id, label, CAST(score + CASE WHEN level_id = 'L7' THEN 20 ELSE 0 END AS INT) AS score FROM s WHERE score > 0 ORDER BY score + CASE WHEN level_id = 'L7' THEN 20 ELSE 0 END DESC, label, feature_id LIMIT 50""")
def e10_search_top50(d: DataFrame) -> DataFrame:
    return relational.search(d, "gear", "facilities", "L7")


@query("E11", "v_entry", "SELECT feature_id, label, CAST(0 AS INT) AS score FROM v_entry WHERE feature_type = 'opening' AND starts_with(coalesce(category, ''), 'pedestrian') ORDER BY CASE WHEN level_id = 'L3' THEN 0 ELSE 1 END, label, feature_id LIMIT 50")
def e11_empty_query_listing(d: DataFrame) -> DataFrame:
    return relational.search(d, "", "gates", "L3")


@query("B11", "v_issue", """SELECT CAST(count(*) FILTER (WHERE NOT deleted AND status <> 'closed') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE NOT deleted AND status <> 'closed' AND assignee_id = 7) AS BIGINT) AS mine,
  CAST(count(*) FILTER (WHERE NOT deleted AND status <> 'closed' AND assignee_id IS NULL) AS BIGINT) AS unassigned, CAST(count(*) FILTER (WHERE deleted OR status = 'closed') AS BIGINT) AS closed FROM v_issue""")
def b11_issue_queue_filters(d: DataFrame) -> DataFrame:
    live = ~F.col("deleted") & (F.col("status") != "closed")
    return d.agg(F.count_if(live).alias("active"), F.count_if(live & (F.col("assignee_id") == 7)).alias("mine"), F.count_if(live & F.col("assignee_id").isNull()).alias("unassigned"), F.count_if(~live).alias("closed"))


@query("B12 B13", "v_version", "SELECT id, venue_id, bundle_hash FROM v_version WHERE status = 'published' AND bundle_hash IS NOT NULL AND (NULL IS NULL OR venue_id = NULL) AND (3 IS NULL OR venue_id <= 3)")
def b12_published_versions(d: DataFrame) -> DataFrame:
    either = lambda p, test: F.lit(True) if p is None else test  # noqa: E731  a parameter that isn't given holds for all
    return d.filter((F.col("status") == "published") & F.col("bundle_hash").isNotNull()).filter(either(None, F.col("venue_id") == 0) & either(3, F.col("venue_id") <= 3)).select("id", "venue_id", "bundle_hash")


@query("C1", "v_issue v_user", "SELECT i.id, u.username, i.status FROM v_issue i JOIN v_user u ON i.author_id = u.id")
def c01_issue_author(i: DataFrame, u: DataFrame) -> DataFrame:
    return i.join(u.select(F.col("id").alias("author_id"), "username"), "author_id").select("id", "username", "status")


@query("C2", "v_issue v_user", "SELECT i.id, u.username AS assignee FROM v_issue i LEFT JOIN v_user u ON i.assignee_id = u.id")
def c02_issue_assignee(i: DataFrame, u: DataFrame) -> DataFrame:
    return i.join(u.select(F.col("id").alias("assignee_id"), F.col("username").alias("assignee")), "assignee_id", "left").select("id", "assignee")


@query("C3", "v_reply v_issue", "SELECT r.id, p.status AS parent_status, r.created_at >= p.created_at AS after FROM v_reply r JOIN v_issue p ON r.parent_id = p.id AND r.version_id = p.version_id")
def c03_reply_parent(r: DataFrame, p: DataFrame) -> DataFrame:
    a, b = r.alias("r"), p.alias("p")
    return a.join(b, (F.col("r.parent_id") == F.col("p.id")) & (F.col("r.version_id") == F.col("p.version_id"))).select("r.id", F.col("p.status").alias("parent_status"), (F.col("r.created_at") >= F.col("p.created_at")).alias("after"))


@query("C4", "v_media v_stored", "SELECT m.id, o.size AS original_size, t.size AS thumbnail_size FROM v_media m JOIN v_stored o ON m.original = o.blob_id JOIN v_stored t ON m.thumbnail = t.blob_id")
def c04_original_and_thumbnail(m: DataFrame, s: DataFrame) -> DataFrame:
    o, t = (s.select(F.col("blob_id").alias(k), F.col("size").alias(f"{k}_size")) for k in ("original", "thumbnail"))
    return m.join(o, "original").join(t, "thumbnail").select("id", "original_size", "thumbnail_size")


@query("C5", "v_issue v_version", "SELECT i.id, i.row_version FROM v_issue i WHERE EXISTS (SELECT 1 FROM v_version v WHERE v.id = i.version_id AND v.status = 'published')")
def c05_semi_join_published(i: DataFrame, v: DataFrame) -> DataFrame:
    live = v.filter("status = 'published'").select(F.col("id").alias("version_id"))
    return i.join(live, "version_id", "left_semi").select("id", "row_version")


@query("C6 H7 E20", "v_stored v_media", "SELECT blob_id FROM v_stored s WHERE NOT EXISTS (SELECT 1 FROM v_media m WHERE m.original = s.blob_id) AND NOT EXISTS (SELECT 1 FROM v_media m WHERE m.thumbnail = s.blob_id)")
def c06_unreferenced_blobs(s: DataFrame, m: DataFrame) -> DataFrame:
    return s.join(m, s["blob_id"] == m["original"], "left_anti").join(m, s["blob_id"] == m["thumbnail"], "left_anti").select("blob_id")


@query("C7 H8", "v_venue v_version", "SELECT n.id, (SELECT v.id FROM v_version v WHERE v.venue_id = n.id AND v.status = 'published' ORDER BY seq DESC LIMIT 1) AS latest FROM v_venue n")
def c07_latest_published_version(n: DataFrame, v: DataFrame) -> DataFrame:
    best = v.filter("status = 'published'").groupBy("venue_id").agg(F.max_by("id", "seq").alias("latest"))
    return n.join(best, n["id"] == best["venue_id"], "left").select("id", "latest")


@query("C8 E2", "v_version", "SELECT venue_id, id, status, bundle_hash FROM v_version QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY seq DESC) = 1")
def c08_latest_per_venue(v: DataFrame) -> DataFrame:
    return relational.latest_per(v, "venue_id", "seq", "id", "status", "bundle_hash")


@query("C9", "v_edge v_node", "SELECT from_id, to_id FROM v_edge WHERE from_id NOT IN (SELECT node_id FROM v_node) OR to_id NOT IN (SELECT node_id FROM v_node)")
def c09_dangling_edges(e: DataFrame, n: DataFrame) -> DataFrame:
    return graph.dangling(e, n).select("from_id", "to_id")


_CHAIN = """+chain AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'L' || CAST(p_partkey % 30 AS VARCHAR) END AS own, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 900 END AS unit, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 END AS anchor FROM part)"""


def _chain(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return p.select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("L"), (k % 30).cast("string"))).alias("own"), F.when(k % 3 == 0, k % 900).alias("unit"), F.when(k % 2 == 0, k % 40).alias("anchor"))


@query("C10", "part v_level v_unit v_node", _CHAIN + """ SELECT c.id, coalesce(l.level_id, u.level_id, a.level_id) AS level_id FROM chain c LEFT JOIN v_level l ON c.own = l.level_id LEFT JOIN v_unit u ON c.unit = u.unit_id
  LEFT JOIN (SELECT node_id, 'L' || CAST(node_id % 25 AS VARCHAR) AS level_id FROM v_node) a ON c.anchor = a.node_id""")
def c10_level_reference_chain(p: DataFrame, level: DataFrame, unit: DataFrame, node: DataFrame) -> DataFrame:
    anchors = node.select("node_id", F.concat(F.lit("L"), (F.col("node_id") % 25).cast("string")).alias("level_id"))
    done = relational.first_of_chain(_chain(p), "id", (level.select(F.col("level_id").alias("k"), "level_id"), "own", "level_id"), (unit.select("unit_id", "level_id"), "unit", "level_id"), (anchors, "anchor", "level_id"))
    return done.select("id", F.col("resolved").alias("level_id"))


@query("C11", "part v_unit v_node", _CHAIN + " SELECT c.id, round(coalesce(u.x + u.w / 2, a.lon), 9) AS lon FROM chain c LEFT JOIN v_unit u ON c.unit = u.unit_id LEFT JOIN v_node a ON c.anchor = a.node_id")
def c11_centre_resolution(p: DataFrame, unit: DataFrame, node: DataFrame) -> DataFrame:
    centres = unit.select("unit_id", (F.col("x") + F.col("w") / 2).alias("lon"))
    done = relational.first_of_chain(_chain(p), "id", (centres, "unit", "lon"), (node.select("node_id", "lon"), "anchor", "lon"))
    return done.select("id", F.round("resolved", 9).alias("lon"))


@query("C12", "v_layer v_level", """+t AS (SELECT id, layer, CASE WHEN id % 4 = 0 THEN 'L' || CAST(id % 30 AS VARCHAR) END AS ref, CASE regexp_extract(layer, '^Station_[0-9]_([^_]+)_', 1) WHEN 'B1' THEN -1 WHEN '2' THEN 1 WHEN '0' THEN 0 WHEN 'M2' THEN 2 WHEN 'F3' THEN 2 END AS o FROM v_layer
    WHERE regexp_matches(layer, '^(.*)_(B[0-9]+|M[0-9]+|F?[0-9]+|R|RF|0)_(Drawing|Fixture|Floor|Space|Opening|Facility|Occupant|detail|level|unit|amenity)$', 'i')),
  f AS (SELECT ordinal, min(level_id) AS level_id FROM v_level GROUP BY ordinal) SELECT t.id, coalesce(l.level_id, f.level_id) AS level_id FROM t LEFT JOIN v_level l ON t.ref = l.level_id LEFT JOIN f ON t.o = f.ordinal""")
def c12_source_reference_fallbacks(d: DataFrame, level: DataFrame) -> DataFrame:
    from floorspan.functions.floors import STRUCTURED, layer_floor

    d = d.filter(F.col("layer").rlike(STRUCTURED)).select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("L"), (F.col("id") % 30).cast("string"))).alias("ref"), layer_floor(F.col("layer")).alias("o"))
    first = level.groupBy("ordinal").agg(F.min("level_id").alias("level_id"))
    done = relational.first_of_chain(d, "id", (level.select(F.col("level_id").alias("k"), "level_id"), "ref", "level_id"), (first, "o", "level_id"))
    return done.select("id", F.col("resolved").alias("level_id"))


@query("C13 G1", "v_node v_unit_stack", "SELECT n.node_id, count(*) AS n_units FROM v_node n JOIN v_unit_stack u ON n.lon > u.x - 2e-5 AND n.lon < u.x + u.w + 2e-5 AND n.lat > u.y - 2e-5 AND n.lat < u.y + u.h + 2e-5 AND u.building % 5 - 2 = n.ordinal GROUP BY 1")
def c13_point_in_buffered_polygon(n: DataFrame, u: DataFrame) -> DataFrame:
    """How many units of its floor each node lies in; units are stacked on 40 x 40 places."""
    from floorspan.operators.spatial import range_join

    u = u.withColumn("ordinal", (F.col("building") % 5 - 2).cast("double"))
    box = [F.col("x") - 2e-5, F.col("y") - 2e-5, F.col("x") + F.col("w") + 2e-5, F.col("y") + F.col("h") + 2e-5]
    found = range_join(n, u, F.col("lon"), F.col("lat"), box, 1e-4, "ordinal")
    inside = geo.in_ring(F.col("lon"), F.col("lat"), geo.rectangle(*box))
    return found.filter(inside).groupBy("node_id").agg(F.count("*").alias("n_units"))


@query("C14", "v_node v_net", """+i AS (SELECT * FROM v_node WHERE lon < 139.762e0), e AS (SELECT * FROM v_net WHERE from_id IN (SELECT node_id FROM i) AND to_id IN (SELECT node_id FROM i)), x AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM i)
  SELECT a.k AS from_index, b.k AS to_index, cost FROM e JOIN x a ON e.from_id = a.node_id JOIN x b ON e.to_id = b.node_id""")
def c14_clip_and_reindex(n: DataFrame, e: DataFrame) -> DataFrame:
    kept, e = graph.clip(n, e, n.filter("lon < 139.762"))
    index = graph.dense_index(kept.select("node_id"))
    f, t = (index.select(F.col("node_id").alias(f"{k}_id"), F.col("node_index").alias(f"{k}_index")) for k in ("from", "to"))
    return e.join(f, "from_id").join(t, "to_id").select("from_index", "to_index", "cost")


_NEAR = _HAV.format(lon1="a.lon", lat1="a.lat", lon2="b.lon", lat2="b.lat")


@query("C19", "v_node", f"SELECT a.node_id AS a, b.node_id AS b FROM v_node a JOIN v_node b ON a.node_id < b.node_id AND a.ordinal = b.ordinal AND {_NEAR} > 10 AND {_NEAR} <= 22")
def c19_grid_bucket_pairs(n: DataFrame) -> DataFrame:
    metres = geo.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    return relational.grid_pairs(n, "node_id", "lon", "lat", 4e-4, (metres > 10) & (metres <= 22), "ordinal")


_NEAREST = _HAV.format(lon1="q.x", lat1="q.y", lon2="t.lon", lat2="t.lat")


@query("C16", "v_unit v_node", f"""+q AS (SELECT unit_id, x, y, CAST(building % 5 - 2 AS DOUBLE) AS ordinal FROM v_unit), d AS (SELECT q.unit_id, t.node_id, {_NEAREST} AS d FROM q JOIN v_node t USING (ordinal))
  SELECT unit_id, node_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY d, node_id) AS INT) AS place FROM d QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY d, node_id) <= 3""")
def c16_nearest_three(u: DataFrame, n: DataFrame) -> DataFrame:
    q = u.select("unit_id", "x", "y", (F.col("building") % 5 - 2).cast("double").alias("ordinal"))
    return relational.nearest_on_grid(q, n, "ordinal", "unit_id", "node_id", 2e-4, 3).select("unit_id", "node_id", "place")


@query("C17", "v_unit v_node", f"SELECT q.unit_id, arg_min(t.node_id, struct_pack(d := {_NEAREST}, n := t.node_id)) AS node_id FROM (SELECT unit_id, x, y, CAST(building % 5 - 2 AS DOUBLE) AS ordinal FROM v_unit) q JOIN v_node t USING (ordinal) GROUP BY 1")
def c17_nearest_node(u: DataFrame, n: DataFrame) -> DataFrame:
    q = u.select("unit_id", "x", "y", (F.col("building") % 5 - 2).cast("double").alias("ordinal"))
    return relational.nearest_on_grid(q, n, "ordinal", "unit_id", "node_id", 2e-4).select("unit_id", "node_id")


@query("C20", "v_room", """+c AS (SELECT DISTINCT unit_id AS hub, level_id, (x + dx) // 10 AS vx, (y + dy) // 10 AS vy FROM v_room, (VALUES (0, 0), (4000, 0), (4000, 3000), (0, 3000)) AS t(dx, dy))
  SELECT a.hub AS a, b.hub AS b, count(*) AS n FROM c a JOIN c b ON a.level_id = b.level_id AND a.vx = b.vx AND a.vy = b.vy AND a.hub < b.hub GROUP BY 1, 2 HAVING count(*) >= 2""")
def c20_shared_vertices(room: DataFrame) -> DataFrame:
    """Hubs of a level that share two corners or more, corners quantized to a centimetre; a corner belongs to the few hubs around it."""
    corner = lambda dx, dy: F.struct(F.floor((F.col("x") + dx) / 10).alias("x"), F.floor((F.col("y") + dy) / 10).alias("y"))
    v = room.select(F.col("unit_id").alias("hub"), "level_id", F.explode(F.array(corner(0, 0), corner(4000, 0), corner(4000, 3000), corner(0, 3000))).alias("vertex")).distinct()
    a, b = v.alias("a"), v.alias("b")
    same = (F.col("a.level_id") == F.col("b.level_id")) & (F.col("a.vertex") == F.col("b.vertex")) & (F.col("a.hub") < F.col("b.hub"))
    return a.join(b, same).groupBy(F.col("a.hub").alias("a"), F.col("b.hub").alias("b")).agg(F.count("*").alias("n")).filter("n >= 2")


@query("C22", "v_node supplier", """SELECT a.node_id, b.s_suppkey AS plane, CAST(count(*) OVER (PARTITION BY a.node_id) AS BIGINT) AS n FROM v_node a JOIN (SELECT s_suppkey, s_acctbal / 1000e0 + 0.4e0 AS altitude FROM supplier) b ON abs(a.altitude - b.altitude) <= 1.5e0
  QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY abs(a.altitude - b.altitude), b.s_suppkey) = 1""")
def c22_altitude_band(n: DataFrame, s: DataFrame) -> DataFrame:
    """The nearest plane of each node within 1.5 m, and how many there are."""
    planes = s.select(F.col("s_suppkey").alias("plane"), (F.col("s_acctbal") / 1000 + 0.4).alias("plane_altitude"))
    return relational.nearest_in_band(n.select("node_id", "altitude"), planes, "node_id", "plane", "altitude", "plane_altitude", 1.5)


@query("C24", "v_level v_unit", "SELECT l.level_id, count(*) AS n FROM v_level l JOIN (SELECT level_id FROM v_unit UNION ALL SELECT level_id FROM v_level) u USING (level_id) GROUP BY 1")
def c24_floor_membership(level: DataFrame, u: DataFrame) -> DataFrame:
    return level.join(u.select("level_id").union(level.select("level_id")), "level_id").groupBy("level_id").agg(F.count("*").alias("n"))


@query("C26", "v_edge v_node", """+l AS (SELECT least(a.ordinal, b.ordinal) AS lo, greatest(a.ordinal, b.ordinal) AS hi, least(e.from_id, e.to_id) AS a, greatest(e.from_id, e.to_id) AS b FROM v_edge e JOIN v_node a ON e.from_id = a.node_id JOIN v_node b ON e.to_id = b.node_id WHERE a.ordinal <> b.ordinal)
  SELECT DISTINCT lo, hi, a, b FROM l""")
def c26_vertical_links(e: DataFrame, n: DataFrame) -> DataFrame:
    d = graph.attach_nodes(e, n).filter("from_ordinal <> to_ordinal")
    both = lambda f, x, y: f(F.col(x), F.col(y))
    return d.select(both(F.least, "from_ordinal", "to_ordinal").alias("lo"), both(F.greatest, "from_ordinal", "to_ordinal").alias("hi"), both(F.least, "from_id", "to_id").alias("a"), both(F.greatest, "from_id", "to_id").alias("b")).distinct()


@query("C27", "v_version v_blob", "SELECT v.id AS version_id, b.id AS member, b.byte_size FROM v_version v JOIN v_blob b ON b.version_id = v.id WHERE v.status = 'published'")
def c27_tile_member_lookup(v: DataFrame, b: DataFrame) -> DataFrame:
    live = v.filter("status = 'published'").select(F.col("id").alias("version_id"))
    return live.join(b, "version_id").select("version_id", F.col("id").alias("member"), "byte_size")


@query("C28 E22", "v_node", "SELECT CAST(count(*) FILTER (WHERE node_id % 11 = 5) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE node_id % 7 = 3 OR node_id % 11 = 5) AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE node_id % 7 <> 3 AND node_id % 11 <> 5 AND node_id % 2 = 0) AS BIGINT) AS changed FROM v_node")
def c28_network_diff(n: DataFrame) -> DataFrame:
    """All nodes of two versions: some are gone in the new one, some have a new id, some lie elsewhere."""
    k = F.col("node_id")
    after = n.filter((k % 7 != 3) | (k % 11 == 5)).withColumns({"lon": F.col("lon") + F.when(k % 2 == 0, 1e-3).otherwise(0.0), "node_id": F.when(k % 11 == 5, k + 1_000_000).otherwise(k)})
    return relational.difference(n, after, "node_id", F.col("b.lon") != F.col("a.lon"))


@query("C29", "events", """+p AS (SELECT event_id AS place, user_id % 5 AS path_id, event_id * 7 % 11 % 5 AS back_id, user_id % 3 AS from_id, event_id % 2 AS to_id FROM events),
  g AS (SELECT *, least(struct_pack(a := path_id, b := back_id, c := from_id, d := to_id), struct_pack(a := back_id, b := path_id, c := to_id, d := from_id)) AS g, path_id = back_id AND from_id = to_id AS own FROM p),
  q AS (SELECT *, g = struct_pack(a := path_id, b := back_id, c := from_id, d := to_id) AS there, row_number() OVER (PARTITION BY g ORDER BY place) AS k FROM g),
  w(g, k, stack, side, slot, other) AS (SELECT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), true, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT g FROM q) UNION ALL
    SELECT q.g, q.k, CASE WHEN len(stack) > 0 AND (own OR side <> there) THEN stack[:-2] ELSE list_append(stack, place) END, CASE WHEN len(stack) > 0 AND (own OR side <> there) THEN side ELSE there END,
      CASE WHEN len(stack) > 0 AND (own OR side <> there) THEN stack[-1] END, CASE WHEN len(stack) > 0 AND (own OR side <> there) THEN place END FROM w JOIN q ON q.g = w.g AND q.k = w.k + 1),
  m AS (SELECT slot, other FROM w WHERE slot IS NOT NULL),
  s AS (SELECT p.place AS slot, m.other, path_id, back_id FROM p LEFT JOIN m ON p.place = m.slot WHERE p.place NOT IN (SELECT other FROM m))
  SELECT CASE WHEN other IS NOT NULL AND back_id < path_id THEN other ELSE slot END AS place, slot, CASE WHEN other IS NULL THEN NULL WHEN back_id < path_id THEN slot ELSE other END AS partner, row_number() OVER (PARTITION BY least(path_id, back_id), greatest(path_id, back_id) ORDER BY slot) > 1 AS clash FROM s""", recursive=True)
def c29_reciprocal_pairs(d: DataFrame) -> DataFrame:
    """Paths there and back that name each other, the last waiting one first, with unequal numbers of both; the smaller path_id stays."""
    k = F.col("event_id")
    return building.pair_paths(d.select(k.alias("place"), (F.col("user_id") % 5).alias("path_id"), (k * 7 % 11 % 5).alias("back_id"), (F.col("user_id") % 3).alias("from_id"), (k % 2).alias("to_id")))


@query("C21", "v_node v_unit")
def c21_minimum_cost_matching(n: DataFrame, u: DataFrame) -> DataFrame:
    """Lower nodes to upper units of a kind: most pairs, then least total distance."""
    a = n.select(F.col("node_id").alias("lower"), "lon", "lat", (F.col("node_id") % 3).alias("kind"))
    b = u.select(F.col("unit_id").alias("upper"), "x", "y", (F.col("unit_id") % 3).alias("kind"))
    # cells of a quarter of a hundredth of a degree are over 200 m wide
    cell = lambda x, y, i=0, j=0: F.struct((F.floor(F.col(x) / 0.0025) + i).alias("x"), (F.floor(F.col(y) / 0.0025) + j).alias("y"))
    a = a.withColumn("cell", cell("lon", "lat"))
    b = b.withColumn("cell", F.explode(F.array(*[cell("x", "y", i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    near = a.join(b, ["kind", "cell"]).withColumn("cost", geo.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).filter("cost < 200")
    return graph.match_pairs(near.select("kind", "lower", "upper", "cost"), ["kind"])

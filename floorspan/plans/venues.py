"""Queries over a decoded venue, its overlays, layers and plans, and the review server's jobs (inventory groups A, B, C, F and H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import floors, text
from floorspan.operators import venues
from floorspan.plans.registry import query


@query("A23", "v_feature v_level", """SELECT 'duplicate_feature' AS code, id FROM v_feature GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'venue_count', CAST(count(*) AS VARCHAR) FROM v_feature WHERE feature_type = 'venue' HAVING count(*) <> 1
  UNION ALL SELECT 'venue_id', 'v9' WHERE NOT EXISTS (SELECT 1 FROM v_feature WHERE feature_type = 'venue' AND id = 'v9')
  UNION ALL SELECT 'duplicate_level', level_id FROM v_level WHERE building = 4
  UNION ALL SELECT 'level_without_feature', level_id FROM v_level WHERE level_id NOT IN (SELECT id FROM v_feature WHERE feature_type = 'level')
  UNION ALL SELECT 'feature_without_level', id FROM v_feature WHERE feature_type = 'level' AND id NOT IN (SELECT level_id FROM v_level)
  UNION ALL SELECT 'unknown_level', id FROM v_feature WHERE level_id IS NOT NULL AND level_id NOT IN (SELECT level_id FROM v_level)
  UNION ALL SELECT 'bounds_unknown_level', 'L88'""")
def a23_hydrate_checks(f: DataFrame, level: DataFrame) -> DataFrame:
    """What keeps a decoded venue from being used: ids, the venue feature, levels and references both ways."""
    ids = level.select("level_id")
    extra = level.filter("building = 4").select("level_id")
    bounds = ids.union(level.filter("building = 0").select(F.lit("L88").alias("level_id")))
    return venues.hydrate_problems(f, ids.union(extra), bounds, "v9")


@query("A23 B17", "v_feature v_level", """SELECT l.level_id, f.id, f.feature_type, CASE WHEN feature_type = 'occupant' AND NOT has_geometry THEN 'center' ELSE 'geometry' END AS kind FROM v_feature f JOIN v_level l ON f.id = l.level_id OR f.level_id = l.level_id
  WHERE feature_type <> 'anchor' AND (has_geometry OR (feature_type = 'occupant' AND x IS NOT NULL))""")
def a23_render_collections(f: DataFrame, level: DataFrame) -> DataFrame:
    """What each level shows."""
    return venues.render_rows(f).join(level.select("level_id"), "level_id").select("level_id", "id", "feature_type", "kind")


@query("B16", "v_feature v_level", """+g AS (SELECT level_id FROM v_level WHERE ordinal = (SELECT ordinal FROM v_level WHERE level_id = 'L3')),
  s AS (SELECT id, feature_type FROM v_feature WHERE feature_type IN ('venue', 'building', 'footprint') AND has_geometry UNION ALL
    SELECT id, feature_type FROM v_feature WHERE feature_type <> 'anchor' AND (has_geometry OR (feature_type = 'occupant' AND x IS NOT NULL)) AND (level_id IN (FROM g) OR (feature_type = 'level' AND id IN (FROM g))))
  SELECT id, count(*) > 0 AS shown FROM s GROUP BY 1""")
def b16_floor_features(f: DataFrame, level: DataFrame) -> DataFrame:
    """Context features and those of all levels of a floor, once each."""
    return venues.floor_features(venues.render_rows(f), f, level, "L3").select("id", F.lit(True).alias("shown"))


_PATHS = """+p AS (SELECT from_id * 100000 + to_id AS path_id, to_id * 100000 + from_id AS reverse_id, from_id, to_id, a.ordinal, (from_id + to_id) % 5 = 0 AS vertical FROM v_net JOIN v_node a ON from_id = a.node_id),
  u AS (SELECT p.path_id, reverse_id, from_id, to_id, a.ordinal AS f, b.ordinal AS t, least(path_id, reverse_id) AS lo, greatest(path_id, reverse_id) AS hi, a.lon AS fx, a.lat AS fy, b.lon AS tx, b.lat AS ty FROM p JOIN v_node a ON from_id = a.node_id JOIN v_node b ON to_id = b.node_id WHERE vertical AND a.ordinal <> b.ordinal)"""


def _paths(net: DataFrame, node: DataFrame) -> DataFrame:
    d = net.join(node.select(F.col("node_id").alias("from_id"), "ordinal"), "from_id")
    key = lambda a, b: F.col(a) * 100000 + F.col(b)
    return d.select(key("from_id", "to_id").alias("path_id"), key("to_id", "from_id").alias("reverse_id"), "from_id", "to_id", "ordinal", ((F.col("from_id") + F.col("to_id")) % 5 == 0).alias("vertical"))


@query("B21", "v_net v_node", _PATHS + """, k AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY path_id) AS k FROM u WHERE f = 0 OR t = 0)
  SELECT 'path' AS kind, path_id AS id, reverse_id, CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS DOUBLE) AS target_floor, CAST(NULL AS VARCHAR) AS direction FROM p WHERE NOT vertical AND ordinal = 0
  UNION ALL SELECT 'vertical-link', lo, hi, CASE WHEN f = 0 THEN from_id ELSE to_id END, CASE WHEN f = 0 THEN t ELSE f END, CASE WHEN CASE WHEN f = 0 THEN t ELSE f END > 0 THEN 'up' ELSE 'down' END FROM k WHERE k = 1
  UNION ALL SELECT 'junction', NULL, NULL, node_id, NULL, NULL FROM v_node WHERE ordinal = 0""")
def b21_floor_overlay(net: DataFrame, node: DataFrame) -> DataFrame:
    """A floor's paths, its vertical links once each, and its junctions."""
    return venues.network_overlay(_paths(net, node), node, 0.0)


@query("C25 C26", "v_net v_node v_unit_stack v_level", _PATHS + """, e AS (SELECT path_id, f AS near, t AS far, fx + 2e-5 AS x, fy + 2e-5 AS y FROM u UNION ALL SELECT path_id, t, f, tx + 2e-5, ty + 2e-5 FROM u),
  c AS (SELECT unit_id, l.ordinal, x, y, w, h FROM v_unit_stack JOIN v_level l USING (level_id) WHERE category IN ('elevator', 'stairs', 'escalator'))
  SELECT id, path_id, far FROM (SELECT unit_id AS id, path_id, far, row_number() OVER (PARTITION BY unit_id ORDER BY abs(far - ordinal), far, path_id) AS k FROM c JOIN e ON near = ordinal AND e.x > c.x AND e.x < c.x + w AND e.y > c.y AND e.y < c.y + h) WHERE k = 1""")
def c25_conveyance_links(net: DataFrame, node: DataFrame, unit: DataFrame, level: DataFrame) -> DataFrame:
    """The link behind each conveyance: an end inside its outline, the nearest other floor; units are stacked on 40 x 40 places."""
    end = lambda k: node.select(F.col("node_id").alias(f"{k}_id"), F.col("ordinal").alias(f"{k}_o"), (F.col("lon") + 2e-5).alias(f"{k}_x"), (F.col("lat") + 2e-5).alias(f"{k}_y"))
    u = _paths(net, node).filter("vertical").join(end("from"), "from_id").join(end("to"), "to_id").filter("from_o <> to_o")
    side = lambda a, b: u.select("path_id", F.col(f"{a}_o").alias("near"), F.col(f"{b}_o").alias("far"), F.col(f"{a}_x").alias("x"), F.col(f"{a}_y").alias("y"))
    boxes = unit.filter(text.is_transit(F.col("category"))).join(level.select("level_id", "ordinal"), "level_id")
    boxes = boxes.select(F.col("unit_id").alias("id"), "ordinal", F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + F.col("w")).alias("east"), (F.col("y") + F.col("h")).alias("north"))
    return venues.conveyance_links(boxes, side("from", "to").union(side("to", "from")), 2e-4)


@query("B23", "v_issue", """SELECT id, id % 1000 AS pin_number, 'L' || CAST(id % 25 AS VARCHAR) AS level_id, status FROM v_issue WHERE status IN ('open', 'in_review') AND NOT deleted AND id % 25 IN (3, 8)""")
def b23_floor_pins(d: DataFrame) -> DataFrame:
    """The pins of one floor's levels that the filter shows."""
    issues = d.select("id", (F.col("id") % 1000).alias("pin_number"), F.concat(F.lit("L"), (F.col("id") % 25).cast("string")).alias("level_id"), "status", "deleted")
    floor = d.sparkSession.createDataFrame([("L3",), ("L8",)], "level_id string")
    return venues.floor_pins(issues, floor, ["open", "in_review"])


_FACILITY = """+f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 8 THEN NULL ELSE ' ' || p_name || ' ' END AS name, CASE p_partkey % 6 WHEN 0 THEN 'F1' WHEN 1 THEN 'B2' WHEN 2 THEN 'M1' WHEN 3 THEN 'f9' WHEN 4 THEN 'roof' END AS floor,
    CASE WHEN p_partkey % 4 <> 3 THEN 'icons/' || p_brand || '.v2.png' END AS image, CASE WHEN p_partkey % 11 <> 0 THEN 139.7 + p_partkey % 100 / 1000e0 END AS lon, 35.6e0 AS lat FROM part),
  o AS (SELECT *, trim(coalesce(name, '')) AS n, CASE floor WHEN 'F1' THEN 0e0 WHEN 'B2' THEN -2e0 WHEN 'M1' THEN 1e0 WHEN 'f9' THEN 8e0 END AS ordinal FROM f WHERE lon IS NOT NULL)"""


def _facilities(d: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    rows = d.select(
        F.when(k % 9 != 8, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"), F.when(k % 6 == 0, "F1").when(k % 6 == 1, "B2").when(k % 6 == 2, "M1").when(k % 6 == 3, "f9").when(k % 6 == 4, "roof").alias("floor"),
        F.when(k % 4 != 3, F.concat(F.lit("icons/"), "p_brand", F.lit(".v2.png"))).alias("image"), F.when(k % 11 != 0, k % 100 / 1000 + 139.7).alias("lon"), F.lit(35.6).alias("lat"),
    )
    return venues.facilities(rows, node, floors.label_to_ordinal(F.col("floor")), F.coalesce(text.stem(F.col("image")), F.lit("")))


@query("G30", "part v_node", _FACILITY + " SELECT ordinal, lon, lat, n AS name, CASE WHEN image IS NULL THEN '' ELSE regexp_replace(replace(image, 'icons/', ''), '.png$', '') END AS icon, ordinal IN (SELECT ordinal FROM v_node) AS routable FROM o WHERE ordinal IS NOT NULL")
def g30_facilities(d: DataFrame, node: DataFrame) -> DataFrame:
    """Facilities with their floors and icons; routable where the floor has a node."""
    return _facilities(d, node)[0]


@query("G30", "part v_node", _FACILITY + " SELECT 'unmapped_floor' AS code, 'facility ' || n || ' floor ' || coalesce(floor, '') AS detail FROM o WHERE ordinal IS NULL")
def g30_facility_warnings(d: DataFrame, node: DataFrame) -> DataFrame:
    return _facilities(d, node)[1]


@query("A11 A10", "v_node part", """SELECT 'net_junction' AS layer, count(*) AS n, list_sort(list(DISTINCT CAST(ordinal AS VARCHAR))) AS floors FROM v_node UNION ALL SELECT 'Facility_Merge', count(*), list_sort(list(DISTINCT 'F' || CAST(p_size AS VARCHAR))) FROM part UNION ALL SELECT 'net_path', NULL, NULL""")
def a11_facility_extract(node: DataFrame, part: DataFrame) -> DataFrame:
    """Needed layers with their rows and sorted floors; one that is missing has none."""
    layers = node.select(F.lit("net_junction").alias("layer"), F.col("ordinal").cast("string").alias("floor")).union(part.select(F.lit("Facility_Merge"), F.concat(F.lit("F"), F.col("p_size").cast("string")))).union(part.limit(0).select(F.lit("x"), F.lit("y")))
    return venues.extracted(layers, ("net_junction", "net_path", "Facility_Merge"), F.col("floor"))


@query("F48", "lineitem", """+m AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE WHEN l_partkey % 23 = 0 THEN 'Point' WHEN l_partkey % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS type, l_suppkey % 4 <> 0 AS finite, CASE WHEN l_partkey % 3 = 0 THEN 1 + l_partkey % 5 ELSE 1 END AS parts FROM lineitem),
  g AS (SELECT id, count(*) AS n, min(type) AS one, sum(parts) AS parts, first(type ORDER BY place) FILTER (WHERE type = 'Point') AS bad FROM m WHERE finite GROUP BY 1)
  SELECT a.id, CASE WHEN bad IS NULL THEN CASE WHEN n = 1 THEN one WHEN n > 1 THEN 'MultiPolygon' END END AS type, CASE WHEN bad IS NULL THEN CAST(parts AS BIGINT) END AS n_parts, bad AS problem FROM (SELECT DISTINCT id FROM m) a LEFT JOIN g ON a.id = g.id""")
def f48_flatten_collections(d: DataFrame) -> DataFrame:
    """Collections of polygons: finite members merged, members of another family a problem."""
    k = F.col("l_partkey")
    kind = F.when(k % 23 == 0, "Point").when(k % 3 == 0, "MultiPolygon").otherwise("Polygon")
    m = d.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), kind.alias("type"), (F.col("l_suppkey") % 4 != 0).alias("finite"), F.when(k % 3 == 0, 1 + k % 5).otherwise(1).alias("n_parts"))
    return venues.of_family(m, "id", "polygon")


_PLAN = """+p AS (SELECT p_partkey AS k, 'db' || CAST(p_partkey % 3 AS VARCHAR) || ' / ' || p_name AS label, CASE p_partkey % 4 WHEN 0 THEN 'level' WHEN 1 THEN 'unit' WHEN 2 THEN 'opening' END AS target, p_size % 7 <> 0 AS compatible, p_size % 5 <> 0 AS building_known,
    CASE p_size % 6 WHEN 0 THEN 'fixed' WHEN 1 THEN 'property' WHEN 2 THEN 'source-reference' WHEN 3 THEN 'layer-name' END AS rule, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE 'L' END AS rule_label, CASE WHEN p_size % 8 <> 2 THEN 1e0 END AS rule_ordinal, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'f' END AS rule_field,
    p_size % 9 = 0 AS has_field, p_size % 13 <> 0 AS fields_known, CASE WHEN p_partkey % 10 < 3 THEN 2e0 END AS o FROM part WHERE p_partkey % 20 <> 19),
  q AS (SELECT *, coalesce(rule = 'fixed', false) AND trim(rule_label) <> '' AND rule_ordinal IS NOT NULL AS fixed, coalesce(rule = 'property', false) AND rule_field <> '' AS prop FROM p),
  good AS (SELECT * FROM q WHERE target IS NOT NULL AND compatible)
  SELECT label, 'incompatible_type' AS issue FROM q WHERE target IS NULL OR NOT compatible
  UNION ALL SELECT label, 'level_no_building' FROM good WHERE target = 'level' AND NOT building_known
  UNION ALL SELECT label, 'level_no_ordinal' FROM good WHERE target = 'level' AND (coalesce(rule = 'source-reference', false) OR NOT (fixed OR prop OR o IS NOT NULL OR has_field))
  UNION ALL SELECT label, 'no_level_rule' FROM good WHERE target <> 'level' AND rule IS NULL
  UNION ALL SELECT label, 'need_building' FROM good WHERE target <> 'level' AND rule <> 'source-reference' AND NOT building_known
  UNION ALL SELECT label, 'level_no_ordinal' FROM good WHERE target <> 'level' AND rule = 'layer-name' AND o IS NULL
  UNION ALL SELECT label, 'fixed' FROM good WHERE rule = 'fixed' AND NOT fixed
  UNION ALL SELECT label, 'field' FROM good WHERE NOT fields_known"""


@query("B18", "part", _PLAN)
def b18_plan_issues(d: DataFrame) -> DataFrame:
    """All issues of every included layer of a mapping plan."""
    k, s = F.col("p_partkey"), F.col("p_size")
    plan = d.select(
        F.concat(F.lit("db"), (k % 3).cast("string")).alias("database"), F.col("p_name").alias("layer"), (k % 20 != 19).alias("included"), F.when(k % 4 == 0, "level").when(k % 4 == 1, "unit").when(k % 4 == 2, "opening").alias("target"),
        (s % 7 != 0).alias("compatible"), (s % 5 != 0).alias("building_known"), F.when(s % 6 == 0, "fixed").when(s % 6 == 1, "property").when(s % 6 == 2, "source-reference").when(s % 6 == 3, "layer-name").alias("rule"),
        F.when(s % 4 == 0, " ").otherwise("L").alias("rule_label"), F.when(s % 8 != 2, 1.0).alias("rule_ordinal"), F.when(s % 3 == 0, "").otherwise("f").alias("rule_field"), (s % 9 == 0).alias("has_field"), (s % 13 != 0).alias("fields_known"), F.when(k % 10 < 3, 2.0).alias("token"),
    )
    return venues.blocking_issues(plan, F.col("token"))


@query("H8 B12 B13", "v_version", """SELECT venue_id, id AS version_id, seq, bundle_hash FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY seq DESC, id DESC) AS k FROM v_version WHERE status = 'published' AND bundle_hash IS NOT NULL) WHERE k = 1
  UNION ALL SELECT -venue_id, id, seq, bundle_hash FROM (SELECT *, row_number() OVER (ORDER BY seq DESC, id DESC) AS k FROM v_version WHERE status = 'published' AND bundle_hash IS NOT NULL AND venue_id = 6) WHERE k = 1""")
def h08_evaluation_targets(d: DataFrame) -> DataFrame:
    """The version that an activation would start from, of all venues and of one that is asked for."""
    one = venues.latest_published(d, F.lit(6))
    return venues.latest_published(d, F.lit(None).cast("int")).union(one.withColumn("venue_id", -F.col("venue_id")))


_JOBS = """+j AS (SELECT id, version_id, status, CASE WHEN id % 3 <> 0 THEN value END AS lease FROM v_job), v AS (SELECT id, status, bundle_hash FROM v_version),
  l AS (SELECT *, status = 'running' AND (lease IS NULL OR lease < 100) AS lost FROM j)"""


def _recovered(jobs: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string").alias("error")
    own = jobs.select("id", "version_id", "status", F.when(F.col("id") % 3 != 0, F.col("value")).alias("lease_expires_at"), none)
    return venues.recovered(own, versions.select("id", "status", "bundle_hash", none), F.lit(100.0))


@query("H11 H12", "v_job v_version", _JOBS + " SELECT id, CASE WHEN lost THEN 'error' ELSE status END AS status, CASE WHEN NOT lost THEN lease END AS lease, CASE WHEN lost THEN 'interrupted_by_restart' END AS error FROM l")
def h11_recovered_jobs(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Jobs after a restart: those that ran without a live lease are in error."""
    return _recovered(jobs, versions)[0].select("id", "status", F.col("lease_expires_at").alias("lease"), "error")


@query("H11", "v_job v_version", _JOBS + """, p AS (SELECT version_id, bool_or(lost) AS lost, bool_or(NOT lost AND status IN ('queued', 'running')) AS live FROM l GROUP BY 1),
  c AS (SELECT v.*, CASE WHEN status = 'draft' AND coalesce(lost, false) THEN 'interrupted_by_restart' WHEN status = 'draft' AND NOT coalesce(live, false) THEN 'orphaned_job' END AS error FROM v LEFT JOIN p ON v.id = p.version_id)
  SELECT id, CASE WHEN error IS NOT NULL THEN 'failed' ELSE status END AS status, CASE WHEN error IS NULL THEN bundle_hash END AS bundle_hash, error FROM c""")
def h11_failed_versions(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Draft versions fail with their interrupted job, or where no live job is theirs."""
    return _recovered(jobs, versions)[1]


@query("H15", "orders", """+r AS (SELECT o_orderkey AS request_id, o_custkey % 50 AS evaluation_id, o_orderdate AS asked_at FROM orders), e AS (SELECT DISTINCT evaluation_id FROM r WHERE evaluation_id % 4 <> 0 AND evaluation_id % 6 <> 1)
  SELECT request_id, r.evaluation_id, e.evaluation_id IS NOT NULL AND row_number() OVER (PARTITION BY r.evaluation_id ORDER BY asked_at, request_id) = 1 AS won FROM r LEFT JOIN e ON r.evaluation_id = e.evaluation_id""")
def h15_reservations(d: DataFrame) -> DataFrame:
    """The first request wins an evaluation that is open."""
    r = d.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 50).alias("evaluation_id"), F.col("o_orderdate").alias("at"))
    e = r.select("evaluation_id").distinct().select("evaluation_id", F.when(F.col("evaluation_id") % 4 == 0, "activated").otherwise("evaluated").alias("state"), F.when(F.col("evaluation_id") % 6 == 1, 5).alias("activating_version_id"))
    return venues.reserved(r, e)

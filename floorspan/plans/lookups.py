"""Queries over category tables, encodings and floor projections (rest of groups A, B, F and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import floors, lookups
from floorspan.plans.registry import query


@query("F6", "v_layer", """+s AS (SELECT layer, any_value(p_size) AS k, count(*) AS n, regexp_matches(layer, '^(.*)_(B[0-9]+|M[0-9]+|F?[0-9]+|R|RF|0)_(Drawing|Fixture|Floor|Space|Opening|Facility|Occupant|detail|level|unit|amenity)$', 'i') AS structured,
    CASE WHEN contains(lower(layer), '_to_') THEN 'detail' WHEN regexp_matches(lower(layer), '_floor$') THEN 'level' WHEN regexp_matches(lower(layer), '_(space|unit)$') THEN 'unit' WHEN regexp_matches(lower(layer), '_opening$') THEN 'opening'
      WHEN regexp_matches(lower(layer), '_drawing$') THEN 'detail' WHEN regexp_matches(lower(layer), '_fixture$') THEN 'fixture' WHEN regexp_matches(lower(layer), '_facility$') THEN 'amenity' END AS target FROM v_layer GROUP BY layer)
  SELECT layer, target, CASE WHEN target IS NULL THEN NULL WHEN target = 'level' THEN CASE WHEN structured AND NOT contains(layer, '_R_') THEN 'layer-name' END WHEN length(layer) % 2 = 0 THEN 'source-reference' WHEN structured AND NOT contains(layer, '_R_') THEN 'layer-name' END AS level_rule,
    coalesce(target IS NOT NULL AND NOT contains(lower(layer), '_to_') AND (target = 'level' OR structured OR length(layer) % 2 = 0), false) AS included FROM s""")
def f06_mapping_suggestion(d: DataFrame) -> DataFrame:
    """What a layer's name and fields suggest: target, level rule by precedence, and whether it goes in."""
    layer = F.col("layer")
    d = d.groupBy("layer").agg(F.count("*").alias("n")).withColumns({"target": floors.layer_target(layer), "token": floors.layer_floor(layer).isNotNull() & layer.rlike(floors.STRUCTURED), "has_reference": F.length("layer") % 2 == 0})
    by_name = F.when(F.col("token"), "layer-name")
    rule = F.when(F.col("target") == "level", by_name).when(F.col("target").isNotNull(), F.when(F.col("has_reference"), "source-reference").otherwise(by_name))
    inside = F.col("target").isNotNull() & ~F.lower(layer).contains("_to_") & ((F.col("target") == "level") | layer.rlike(floors.STRUCTURED) | F.col("has_reference"))
    return d.select("layer", "target", rule.alias("level_rule"), F.coalesce(inside, F.lit(False)).alias("included"))


@query("F9", "part", """+r AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'A' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 1 THEN ' B02' || CAST(p_size % 10 AS VARCHAR) WHEN 2 THEN 'C10' || CAST(p_size % 6 AS VARCHAR) WHEN 3 THEN p_type ELSE 'B' || p_name END AS raw FROM part)
  SELECT id, CASE WHEN regexp_full_match(trim(raw), 'A[0-9]+') THEN coalesce(MAP {a}[trim(raw)], 'other') WHEN regexp_full_match(trim(raw), '[BC][0-9]+') THEN coalesce(MAP {b}[trim(raw)], 'unspecified') ELSE raw END AS category FROM r""".replace("{a}", str(lookups.VENUE_CODES)).replace("{b}", str(lookups.UNIT_CODES | lookups.FIXTURE_CODES)))
def f09_category_codes(d: DataFrame) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    raw = F.when(k == 0, F.concat(F.lit("A"), F.lpad(s.cast("string"), 3, "0"))).when(k == 1, F.concat(F.lit(" B02"), (s % 10).cast("string"))).when(k == 2, F.concat(F.lit("C10"), (s % 6).cast("string"))).when(k == 3, F.col("p_type")).otherwise(F.concat(F.lit("B"), "p_name"))
    return d.select(F.col("p_partkey").alias("id"), lookups.category_of_code(raw).alias("category"))


_ROLE = "CASE " + " ".join(f"WHEN contains(lower(c), '{part}') THEN '{role}'" for part, role in lookups.ROLES) + " ELSE 'context' END"


@query("F10", "v_unit", f"+r AS (SELECT unit_id, coalesce(category, 'Stair Rail Wall') AS c FROM v_unit), s AS (SELECT unit_id, {_ROLE} AS role FROM r) SELECT unit_id, role, CASE WHEN role = 'ceiling' THEN 'protected_corridor' WHEN role IN ('structure', 'context') THEN 'context' ELSE 'never' END AS occlusion FROM s")
def f10_role_of_category(d: DataFrame) -> DataFrame:
    d = d.select("unit_id", lookups.role_of_category(F.coalesce("category", F.lit("Stair Rail Wall"))).alias("role"))
    return d.withColumn("occlusion", lookups.occlusion(F.col("role")))


@query("F21", "v_unit", "SELECT unit_id, CASE WHEN category IN ('elevator', 'escalator', 'stairs', 'ramp') THEN category WHEN category IN ('walkway', 'platform', 'lobby', 'footbridge') THEN 'walkable' WHEN category = 'unenclosedarea' THEN 'restricted' ELSE 'public' END AS surface, CASE WHEN unit_id % 3 = 0 THEN 'automatic_gate' ELSE 'absent' END AS form FROM v_unit")
def f21_surface_roles_and_forms(d: DataFrame) -> DataFrame:
    return d.select("unit_id", lookups.surface_role(F.col("category")).alias("surface"), lookups.fixture_form(F.when(F.col("unit_id") % 3 == 0, "ticketgate").otherwise("bench")).alias("form"))


@query("F22", "part", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#abc' WHEN 2 THEN '#808080' WHEN 3 THEN NULL ELSE '#808080' END AS fill FROM part")
def f22_colour_fill(d: DataFrame) -> DataFrame:
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "red").when(k == 1, "#abc").when(k == 2, "#abcd").when(k == 3, "").otherwise("mauve")
    return d.select(F.col("p_partkey").alias("id"), lookups.fill(raw, {"red": "#ff0000"}).alias("fill"))


@query("F37", "embeddings", """+e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
  n AS (SELECT vec_id, x, z, x / greatest(abs(x) + abs(y) + abs(z), 1e-7) AS u, y / greatest(abs(x) + abs(y) + abs(z), 1e-7) AS v FROM e)
  SELECT vec_id, CAST(least(65535, greatest(0, round((x - lo) / ((hi - lo) / 65535)))) AS INT) AS q, CAST(round(CASE WHEN z < 0 THEN (1 - abs(v)) * CASE WHEN u >= 0 THEN 1 ELSE -1 END ELSE u END * 32767) AS INT) AS oct_u FROM n, b""")
def f37_quantized_positions(d: DataFrame) -> DataFrame:
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    lo, hi = d.agg(F.min(x)).scalar(), d.agg(F.max(x)).scalar()
    return d.select("vec_id", lookups.quantize(x, lo, hi).alias("q"), lookups.octahedral(x, y, z)[0].alias("oct_u"))


@query("F38", "embeddings", "+e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1] * e[17] + e[2] * e[21] + e[3] * e[25] + e[4] * e[29], 9) AS m00, round(e[13] * e[20] + e[14] * e[24] + e[15] * e[28] + e[16] * e[32], 9) AS m33 FROM e")
def f38_matrix_product(d: DataFrame) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    m = lookups.product(F.slice(e, 1, 16), F.slice(e, 17, 16))
    return d.select("vec_id", F.round(m[0], 9).alias("m00"), F.round(m[15], 9).alias("m33"))


@query("", "v_unit", "SELECT unit_id, unit_id % 4 <> 0 AS usable FROM v_unit")
def b15_usable_geometry(d: DataFrame) -> DataFrame:
    centre = F.when(F.col("unit_id") % 4 != 0, F.col("x") + F.col("w") / 2)
    return d.select("unit_id", centre.isNotNull().alias("usable"))


@query("", "v_unit v_level", "SELECT CAST(unit_id AS VARCHAR) AS id, 'unit' AS kind FROM v_unit WHERE level_id IN (SELECT level_id FROM v_level WHERE ordinal = 1) UNION SELECT level_id, 'level' FROM v_level WHERE ordinal BETWEEN 0 AND 2")
def b16_context_features(u: DataFrame, level: DataFrame) -> DataFrame:
    here = u.join(level.filter("ordinal = 1"), "level_id", "left_semi").select(F.col("unit_id").cast("string").alias("id"), F.lit("unit").alias("kind"))
    around = level.filter("ordinal between 0 and 2").select(F.col("level_id").alias("id"), F.lit("level").alias("kind"))
    return here.unionByName(around).dropDuplicates(["id"])


@query("B17", "v_entry", "SELECT feature_id FROM v_entry WHERE level_id IN ('L1', 'L2', 'L3') AND NOT (feature_type = 'amenity' AND feature_id + 1 IN (SELECT feature_id FROM v_entry WHERE feature_type = 'kiosk' AND level_id IN ('L1', 'L2', 'L3'))) ORDER BY feature_id <> 7, CASE feature_type WHEN 'kiosk' THEN 0 WHEN 'occupant' THEN 1 ELSE 2 END, feature_id LIMIT 200")
def b17_marker_selection(d: DataFrame) -> DataFrame:
    on = d.filter(F.col("level_id").isin("L1", "L2", "L3"))
    bubbles = on.filter("feature_type = 'kiosk'").select((F.col("feature_id") - 1).alias("linked"))
    kept = on.join(bubbles, (on["feature_type"] == "amenity") & (on["feature_id"] == bubbles["linked"]), "left_anti")
    rank = F.when(F.col("feature_type") == "kiosk", 0).when(F.col("feature_type") == "occupant", 1).otherwise(2)
    return kept.orderBy(F.col("feature_id") != 7, rank, "feature_id").limit(200).select("feature_id")


@query("", "v_layer", """SELECT layer, 'no_target' AS code FROM v_layer WHERE layer LIKE '%misc' GROUP BY 1 UNION ALL SELECT layer, 'no_ordinal' FROM v_layer WHERE layer LIKE '%\\_R\\_%' ESCAPE '\\' GROUP BY 1 UNION ALL SELECT NULL, 'no_level' WHERE NOT EXISTS (SELECT 1 FROM v_layer WHERE layer LIKE '%Floor')""")
def b18_blocking_issues(d: DataFrame) -> DataFrame:
    layers = d.select("layer").distinct()
    a = layers.filter(floors.layer_target(F.col("layer")).isNull()).select("layer", F.lit("no_target").alias("code"))
    b = layers.filter(F.col("layer").contains("_R_")).select("layer", F.lit("no_ordinal").alias("code"))
    none = layers.agg(F.count_if(F.col("layer").endswith("Floor")).alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("layer"), F.lit("no_level").alias("code"))
    return a.union(b).union(none)


@query("", "v_issue", "SELECT id, version_id FROM v_issue WHERE id % 25 = 4 AND NOT deleted AND status <> 'closed'")
def b19_floor_projection(d: DataFrame) -> DataFrame:
    return d.filter((F.col("id") % 25 == 4) & ~F.col("deleted") & (F.col("status") != "closed")).select("id", "version_id")


@query("B20", "v_net v_node", """+e AS (SELECT e.from_id, e.to_id, a.ordinal AS o1, b.ordinal AS o2 FROM v_net e JOIN v_node a ON e.from_id = a.node_id JOIN v_node b ON e.to_id = b.node_id)
  SELECT 'segment' AS part, from_id, to_id FROM e WHERE o1 = 1 AND o2 = 1 UNION ALL SELECT 'connector', from_id, to_id FROM e WHERE (o1 = 1) <> (o2 = 1)""")
def b20_route_overlay(e: DataFrame, n: DataFrame) -> DataFrame:
    from floorspan.operators.graph import attach_nodes

    here, there = F.col("from_ordinal") == 1, F.col("to_ordinal") == 1
    part = F.when(here & there, "segment").when(here != there, "connector")
    return attach_nodes(e, n).select(part.alias("part"), "from_id", "to_id").filter("part is not null")


@query("", "v_edge v_node", """SELECT DISTINCT least(from_id, to_id) || '-' || greatest(from_id, to_id) AS pair FROM v_edge JOIN v_node a ON from_id = a.node_id JOIN v_node b ON to_id = b.node_id WHERE a.ordinal <> b.ordinal AND (a.ordinal = 0 OR b.ordinal = 0)""")
def b21_network_overlay(e: DataFrame, n: DataFrame) -> DataFrame:
    from floorspan.operators.graph import attach_nodes

    d = attach_nodes(e, n).filter("from_ordinal <> to_ordinal and (from_ordinal = 0 or to_ordinal = 0)")
    return d.select(F.concat_ws("-", F.least("from_id", "to_id").cast("string"), F.greatest("from_id", "to_id").cast("string")).alias("pair")).dropDuplicates(["pair"])


@query("B24", "v_unit", "SELECT unit_id, CASE WHEN building = 3 THEN 1e0 WHEN abs(building - 3) = 1 THEN 0.3e0 ELSE 0e0 END AS opacity, building = 3 AS pickable FROM v_unit")
def b24_visibility(d: DataFrame) -> DataFrame:
    far = F.abs(F.col("building") - 3)
    return d.select("unit_id", F.when(far == 0, 1.0).when(far == 1, 0.3).otherwise(0.0).alias("opacity"), (far == 0).alias("pickable"))


@query("A1 A14", "v_unit", "SELECT CAST(building AS INT) AS venue, count(*) AS features, CAST(sum(unit_id) AS BIGINT) AS ids FROM v_unit GROUP BY 1")
def a01_archive_round_trip(d: DataFrame) -> DataFrame:
    """Features packed into one archive for each venue and read back from the archives."""
    from floorspan.sources import archive
    from floorspan.session import cut

    rows = d.select(F.col("building").alias("venue"), F.lit("unit").alias("feature_type"), F.col("unit_id").cast("string").alias("id"), F.lit(None).cast("string").alias("geometry"), F.to_json(F.struct("category")).alias("properties"))
    packed = cut(archive.archives(rows))
    return archive.unpack(packed).groupBy("venue").agg(F.count("*").alias("features"), F.sum(F.col("id").cast("long")).alias("ids"))


@query("G8", "v_unit v_level", """+h AS (SELECT unit_id, category, ordinal FROM v_unit u JOIN v_level l USING (level_id) WHERE category IN ('elevator', 'stairs', 'escalator')), p AS (SELECT a.category, a.ordinal, a.unit_id AS lower, b.unit_id AS upper FROM h a JOIN h b ON a.category = b.category AND b.ordinal = a.ordinal + 1 AND abs(a.unit_id - b.unit_id) <= 30)
  SELECT category, ordinal, count(*) AS candidates, count(DISTINCT lower) AS lowers FROM p GROUP BY 1, 2""")
def g08_vertical_candidates(u: DataFrame, level: DataFrame) -> DataFrame:
    h = u.join(level.select("level_id", "ordinal"), "level_id").filter(F.col("category").isin("elevator", "stairs", "escalator")).select("unit_id", "category", "ordinal")
    upper = h.select(F.col("unit_id").alias("upper"), "category", (F.col("ordinal") - 1).alias("ordinal"), F.col("unit_id").alias("at"))
    lower = h.withColumnRenamed("unit_id", "lower").withColumn("bucket", F.explode(F.array(*[F.floor(F.col("lower") / 30) + i for i in (-1, 0, 1)])))
    near = lower.join(upper.withColumn("bucket", F.floor(F.col("at") / 30)), ["category", "ordinal", "bucket"]).filter("abs(lower - upper) <= 30")
    return near.groupBy("category", "ordinal").agg(F.count("*").alias("candidates"), F.count_distinct("lower").alias("lowers"))


@query("G9", "v_unit")
def g09_skeleton(u: DataFrame) -> DataFrame:
    """Middle lines of each level's walkways around its rooms, on a half-metre raster."""
    from floorspan.functions.text import is_walkway
    from floorspan.operators.skeleton import skeletons

    m = lambda c, o: ((F.col(c) - o) * 1e5).alias(c)
    areas = u.filter(is_walkway(F.col("category")) | (F.col("category") == "room"))
    return skeletons(areas.select("level_id", m("x", 139.76), m("y", 35.68), m("w", 0), m("h", 0), is_walkway(F.col("category")).alias("free")))

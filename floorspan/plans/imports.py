"""Queries over sources and sinks (inventory group A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.operators import graph, relational
from floorspan.plans.registry import query
from floorspan.sources import bundle, network


@query("A3", "v_layer", "SELECT name FROM (SELECT unnest(['Station_0_B1_Floor', 'Station_1_2_Space', 'level.geojson', 'unit.geojson']) AS name) WHERE name NOT IN (SELECT layer FROM v_layer)")
def a03_required_files(d: DataFrame) -> DataFrame:
    needed = d.sparkSession.createDataFrame([(x,) for x in ("Station_0_B1_Floor", "Station_1_2_Space", "level.geojson", "unit.geojson")], "name string")
    return relational.missing(needed, d.select(F.col("layer").alias("name")), "name")


@query("A4 A5", "v_label", """SELECT 'duplicate_id' AS code, label AS detail FROM v_label GROUP BY label HAVING count(*) > 1 UNION ALL SELECT 'not_one_venue', CAST(count(*) AS VARCHAR) FROM v_label WHERE label = 'RF' HAVING count(*) <> 1""")
def a04_collection_shapes(d: DataFrame) -> DataFrame:
    twice = relational.duplicates(d, "label").select(F.lit("duplicate_id").alias("code"), F.col("label").alias("detail"))
    venues = d.filter("label = 'RF'").agg(F.count("*").alias("n")).filter("n <> 1").select(F.lit("not_one_venue").alias("code"), F.col("n").cast("string").alias("detail"))
    return twice.union(venues)


@query("B1 A24", "v_unit", """SELECT unit_id, level_id, nullif(category, 'room') AS category, CASE WHEN unit_id % 5 = 0 THEN 'no_id' WHEN unit_id % 7 = 0 THEN 'wrong_feature_type' END AS problem FROM v_unit""")
def a05_feature_projection(d: DataFrame) -> DataFrame:
    """Features as JSON text, read back field by field."""
    k = F.col("unit_id")
    raw = F.to_json(
        F.struct(
            F.when(k % 5 != 0, k.cast("string")).alias("id"),
            F.when(k % 7 == 0, "level").otherwise("unit").alias("feature_type"),
            F.struct(F.col("level_id"), F.when(F.col("category") == "room", "").otherwise(F.col("category")).alias("category")).alias("properties"),
        )
    )
    d = d.select("unit_id", F.from_json(raw, "id string, feature_type string, properties struct<level_id: string, category: string>").alias("f"))
    problem = F.when(F.col("f.id").isNull(), "no_id").when(F.col("f.feature_type") != "unit", "wrong_feature_type")
    return d.select("unit_id", "f.properties.level_id", F.nullif("f.properties.category", F.lit("")).alias("category"), problem.alias("problem"))


@query("A8", "v_layer", "SELECT layer, count(*) AS n, list_sort(list(DISTINCT CASE p_size % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'point' ELSE 'line' END)) AS families FROM v_layer GROUP BY 1")
def a08_layer_catalog(d: DataFrame) -> DataFrame:
    family = F.when(F.col("p_size") % 3 == 0, "polygon").when(F.col("p_size") % 3 == 1, "point").otherwise("line")
    return network.catalog(d.withColumn("family", family))


@query("A9", "v_layer", """SELECT layer, round(max(degrees(x / 6378137e0)), 6) AS lon, round(max(degrees(atan(sinh(y / 6378137e0)))), 6) AS lat, CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS skipped
  FROM (SELECT layer, CASE WHEN id % 6 <> 1 THEN 15550000e0 + id END AS x, CASE WHEN id % 6 <> 1 THEN 4250000e0 + id END AS y FROM v_layer) GROUP BY 1""")
def a09_reproject(d: DataFrame) -> DataFrame:
    ok = F.col("id") % 6 != 1
    d = d.select("layer", F.when(ok, F.col("id") + 15550000.0).alias("x"), F.when(ok, F.col("id") + 4250000.0).alias("y"))
    far = network.to_degrees(d).groupBy("layer").agg(F.round(F.max("lon"), 6).alias("lon"), F.round(F.max("lat"), 6).alias("lat"))
    return network.skipped(d).join(far, "layer", "left").select("layer", "lon", "lat", "skipped")


@query("A10", "v_node v_edge", "SELECT 'net_junction' AS layer, count(*) AS n, list_sort(list(DISTINCT ordinal)) AS floors FROM v_node UNION ALL SELECT 'net_path', count(*), list_sort(list(DISTINCT CAST(line AS DOUBLE))) FROM v_edge")
def a10_network_extract(n: DataFrame, e: DataFrame) -> DataFrame:
    a, b = network.floors_of(n, "ordinal"), network.floors_of(e.withColumn("line", F.col("line").cast("double")), "line")
    return a.select(F.lit("net_junction").alias("layer"), "n", "floors").union(b.select(F.lit("net_path").alias("layer"), "n", "floors"))


@query("A17", "v_level v_unit", """+f AS (SELECT CAST(unit_id AS VARCHAR) AS id, CASE WHEN unit_id % 200 = 0 THEN 'L99' ELSE level_id END AS level_id, 'unit' AS t FROM v_unit UNION ALL SELECT level_id, NULL, 'level' FROM v_level WHERE building % 6 <> 0 UNION ALL SELECT 'L77', NULL, 'level')
  SELECT 'level_without_feature' AS code, level_id AS id FROM v_level WHERE building % 6 = 0 UNION ALL SELECT 'feature_without_level', 'L77' UNION ALL SELECT 'unknown_level', id FROM f WHERE level_id = 'L99'""")
def a17_bundle_integrity(level: DataFrame, u: DataFrame) -> DataFrame:
    units = u.select(F.col("unit_id").cast("string").alias("id"), F.when(F.col("unit_id") % 200 == 0, "L99").otherwise(F.col("level_id")).alias("level_id"), F.lit("unit").alias("feature_type"))
    none = F.lit(None).cast("string").alias("level_id")
    shown = level.filter("building % 6 <> 0").select(F.col("level_id").alias("id"), none, F.lit("level").alias("feature_type"))
    extra = level.limit(1).select(F.lit("L77").alias("id"), none, F.lit("level").alias("feature_type"))
    return bundle.integrity(level, units.union(shown).union(extra))


@query("A18", "part", """+e AS (SELECT 't' || CAST(floor(p_partkey / 3) AS INT) AS parent, 't' || p_partkey AS child FROM part WHERE p_partkey % 11 <> 0), w(path, depth) AS (SELECT 't1', 0 UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON w.path = e.parent)
  SELECT path, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1""", recursive=True)
def a18_tile_package_walk(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    e = p.filter(k % 11 != 0).select(F.concat(F.lit("t"), F.floor(k / 3).cast("string")).alias("parent"), F.concat(F.lit("t"), k.cast("string")).alias("child"))
    return network.reachable(e, p.sparkSession.createDataFrame([("t1",)], "path string"))


@query("A21", "v_blob", "SELECT sha256(body) AS hash, count(*) AS puts, any_value(byte_size) AS byte_size FROM v_blob GROUP BY 1")
def a21_content_addressed_put(d: DataFrame) -> DataFrame:
    return d.groupBy(F.sha2("body", 256).alias("hash")).agg(F.count("*").alias("puts"), F.first("byte_size").alias("byte_size"))


@query("A25", "v_net", """+i AS (SELECT row_number() OVER (ORDER BY from_id * 100000 + to_id) - 1 AS k, * FROM v_net) SELECT CAST(2 * k + 1 AS BIGINT) AS path_id, CAST(2 * k + 2 AS BIGINT) AS back_id, from_id, to_id, cost FROM i UNION ALL SELECT CAST(2 * k + 2 AS BIGINT), CAST(2 * k + 1 AS BIGINT), to_id, from_id, cost FROM i""")
def a25_network_export(e: DataFrame) -> DataFrame:
    keyed = e.select((F.col("from_id") * 100000 + F.col("to_id")).alias("node_id"), "from_id", "to_id", "cost")
    index = graph.dense_index(keyed)
    return network.export_paths(index.withColumnRenamed("node_index", "edge_index"))

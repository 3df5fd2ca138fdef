"""Queries that write and read sources: archives, bundles, network layers, tile packages and meshes (inventory groups A, D and F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.functions.lookups import role_of_category
from floorspan.operators import registration, scene
from floorspan.plans.registry import query
from floorspan.plans.views import frame
from floorspan.session import cut, scratch
from floorspan.sources import archive, bundle, glb, network

_ENTRIES = """+e AS (SELECT p_partkey % 7 AS archive, CASE p_partkey % 10 WHEN 0 THEN '/' || p_partkey WHEN 1 THEN 'a/../' || p_partkey WHEN 2 THEN 'Dir\\' || p_partkey WHEN 3 THEN 'same.JSON' WHEN 4 THEN 'Same.json' ELSE 'f' || p_partkey END AS name,
    p_partkey % 50 = 5 AS is_dir, p_partkey % 30 = 6 AS encrypted, CASE WHEN p_partkey % 40 = 7 THEN 300 << 20 ELSE p_partkey END AS size FROM part), f AS (SELECT * FROM e WHERE NOT is_dir)
  SELECT archive, name, 'unsafe_path' AS code FROM f WHERE name LIKE '/%' OR name LIKE 'a/../%' OR name LIKE 'Dir%' UNION ALL SELECT archive, name, 'encrypted' FROM f WHERE encrypted UNION ALL SELECT archive, name, 'too_large' FROM f WHERE size > 256 << 20
  UNION ALL SELECT archive, max(name), 'duplicate_entry' FROM f GROUP BY archive, lower(name) HAVING count(*) > 1 UNION ALL SELECT archive, NULL, 'too_large' FROM f GROUP BY archive HAVING sum(size) > 1 << 30 UNION ALL SELECT archive, NULL, 'too_many_entries' FROM f GROUP BY archive HAVING count(*) > 10000"""


@query("A2 A12", "part", _ENTRIES)
def a02_archive_entries(d: DataFrame) -> DataFrame:
    """Entries that keep an archive from being read."""
    k = F.col("p_partkey")
    text = k.cast("string")
    name = F.when(k % 10 == 0, F.concat(F.lit("/"), text)).when(k % 10 == 1, F.concat(F.lit("a/../"), text)).when(k % 10 == 2, F.concat(F.lit("Dir\\"), text)).when(k % 10 == 3, "same.JSON").when(k % 10 == 4, "Same.json").otherwise(F.concat(F.lit("f"), text))
    return archive.entry_problems(d.select((k % 7).alias("archive"), name.alias("name"), (k % 50 == 5).alias("is_dir"), (k % 30 == 6).alias("encrypted"), F.when(k % 40 == 7, 300 << 20).otherwise(k).alias("size")))


@query("A5", "part", """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'no_id' WHEN p_partkey % 7 = 0 THEN 'not_a_feature' WHEN p_partkey % 11 = 0 THEN 'wrong_feature_type' END AS problem FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0""")
def a05_rejected_features(d: DataFrame) -> DataFrame:
    """GeoJSON features without a text id, that are none, or that declare another type than their file's."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit('{"id": '), F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit('"u'), k.cast("string"), F.lit('"'))), F.lit(', "type": "'), F.when(k % 7 == 0, "Point").otherwise("Feature"), F.lit('"'), F.when(k % 3 > 0, F.concat(F.lit(', "feature_type": "'), F.when(k % 11 == 0, "level").otherwise("unit"), F.lit('"'))).when(k % 11 == 0, ', "feature_type": "x"').otherwise(""), F.lit("}"))
    v = F.parse_json(raw)
    own = F.try_variant_get(v, "$.id", "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.id", "variant")) == "STRING"
    problem = F.when(own.isNull() | ~is_text, "no_id").when(F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")) != "Feature", "not_a_feature").when(F.coalesce(F.try_variant_get(v, "$.feature_type", "string"), F.lit("unit")) != "unit", "wrong_feature_type")
    return d.select(k.alias("k"), problem.alias("problem")).filter("problem is not null")


@query("A7", "part", """SELECT p_partkey AS k, CASE WHEN p_partkey % 6 NOT IN (1, 2) THEN '{"a": "' || p_name || '", "b": 0.0, "c": [1, {"y": 0.0, "z": ' || p_partkey || '}]}' END AS text, CASE p_partkey % 6 WHEN 1 THEN 'non_finite_number' WHEN 2 THEN 'bad_json' END AS problem FROM part""")
def a07_canonical_json(d: DataFrame) -> DataFrame:
    """JSON with sorted keys and no negative zeros; texts with numbers that aren't finite are refused."""
    k = F.col("p_partkey")
    tail = F.when(k % 6 == 1, "NaN}").when(k % 6 == 2, "").otherwise("-0.0}")
    raw = F.concat(F.lit('{"c": [1, {"z": '), k.cast("string"), F.lit(', "y": -0.0}], "a": "'), "p_name", F.lit('", "b": '), tail)
    return archive.canonical_texts(d.select(k.alias("k"), raw.alias("raw")), "k", "raw")


@query("A8", "v_layer", """SELECT layer, count(*) AS n, list_sort(list(DISTINCT CASE p_size % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'point' ELSE 'line' END)) AS families,
  list_sort(list_distinct(flatten(list(CASE WHEN p_size % 2 = 0 THEN ['brand', 'size'] ELSE ['size', 'storey'] END)))) AS fields FROM v_layer GROUP BY 1""")
def a08_layer_fields(d: DataFrame) -> DataFrame:
    """Layers with their rows, geometry families and the names of their fields."""
    s = F.col("p_size")
    family = F.when(s % 3 == 0, "polygon").when(s % 3 == 1, "point").otherwise("line")
    fields = F.when(s % 2 == 0, F.create_map(F.lit("size"), s.cast("string"), F.lit("brand"), "p_brand")).otherwise(F.create_map(F.lit("storey"), F.lit("x"), F.lit("size"), s.cast("string")))
    return network.catalog(d.select("layer", family.alias("family"), fields.alias("properties")))


@query("A13", "v_node v_net", """SELECT 'net_junction' AS layer, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS ids, round(sum(lon), 6) AS total FROM v_node UNION ALL SELECT 'net_path', count(*), CAST(sum(from_id * 3 + to_id) AS BIGINT), round(sum(cost), 6) FROM v_net""")
def a13_network_layers(node: DataFrame, net: DataFrame) -> DataFrame:
    """Both layers written as GeoJSON lines and read again."""
    folder = scratch(node.sparkSession)
    network.write_network(node.select("node_id", "lon", "lat", "ordinal"), net.select("from_id", "to_id", "cost"), folder)
    back = network.read_network(node.sparkSession, folder, {"net_junction": "node_id long, lon double, lat double, ordinal double", "net_path": "from_id long, to_id long, cost double"})
    a, b = back["net_junction"], back["net_path"]
    one = a.agg(F.count("*").alias("n"), F.sum("node_id").alias("ids"), F.round(F.sum("lon"), 6).alias("total")).select(F.lit("net_junction").alias("layer"), "*")
    return one.union(b.agg(F.count("*"), F.sum(F.col("from_id") * 3 + F.col("to_id")), F.round(F.sum("cost"), 6)).select(F.lit("net_path"), "*"))


@query("A14", "v_unit", """SELECT building, 'unit' AS feature_type, CAST(unit_id AS VARCHAR) AS id, '{"coordinates": [' || CAST(unit_id % 40 AS VARCHAR) || '.5, 35.0], "type": "Point"}' AS geometry, '{"category": "' || coalesce(category, 'none') || '"}' AS properties FROM v_unit""")
def a14_archive_round_trip(d: DataFrame) -> DataFrame:
    """Zip archives of GeoJSON by building, written and read back with geometry and properties."""
    point = F.concat(F.lit('{"type": "Point", "coordinates": ['), (F.col("unit_id") % 40).cast("string"), F.lit(".5, 35.0]}"))
    rows = d.select("building", F.lit("unit").alias("feature_type"), F.col("unit_id").cast("string").alias("id"), point.alias("geometry"), F.concat(F.lit('{"category": "'), F.coalesce("category", F.lit("none")), F.lit('"}')).alias("properties"))
    folder = scratch(d.sparkSession)
    archive.write_archives(rows, folder, "building")
    return archive.unpack(d.sparkSession.read.parquet(folder), "building")


def _sections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    unit, level = frame(spark, sf_dir, "v_unit"), frame(spark, sf_dir, "v_level")
    return {
        "manifest": spark.createDataFrame([("1.0.0", "en")], "version string, language string"),
        "levels": level,
        "features": unit.select(F.col("unit_id").alias("id"), "level_id", "category"),
        "search": unit.select("unit_id", "category"),
        "graph": frame(spark, sf_dir, "v_net").select("from_id", "to_id", "cost"),
    }


def _written(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch(spark)
    bundle.write_bundle(_sections(spark, sf_dir), folder)
    return folder


@query("A15 A16", "", """WITH n AS (SELECT count(*) AS units FROM part), l AS (SELECT count(*) AS levels FROM nation)
  SELECT 'manifest' AS section, 'ok' AS state, CAST(1 AS BIGINT) AS n FROM n UNION ALL SELECT 'levels', 'ok', levels FROM l UNION ALL SELECT 'features', 'ok', units FROM n UNION ALL SELECT 'search', 'changed', NULL FROM n UNION ALL SELECT 'graph', 'missing', NULL FROM n""")
def a15_bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is written, one optional section is changed and one deleted, and it is read: whole sections come back, the others are named."""
    folder = _written(spark, sf_dir)
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/section=search")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/section=graph")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    sections, states = bundle.read_bundle(spark, folder)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in sections.items()]
    found = counts[0]
    for c in counts[1:]:
        found = found.union(c)
    return states.join(found, "section", "left").select("section", "state", "n")


@query("A16 A17", "v_level v_unit", "SELECT 'level' AS kind, level_id AS id, CAST(NULL AS VARCHAR) AS level_id FROM v_level UNION ALL SELECT 'feature', CAST(unit_id AS VARCHAR), level_id FROM v_unit")
def a17_bundle_inspection(level: DataFrame, unit: DataFrame) -> DataFrame:
    """Level ids, and features with their levels, of a bundle that was written and read."""
    folder = scratch(level.sparkSession)
    sections = {"manifest": level.limit(1), "levels": level, "features": unit.select(F.col("unit_id").alias("id"), "level_id")}
    bundle.write_bundle(sections, folder)
    return bundle.inspect(bundle.read_bundle(level.sparkSession, folder)[0])


@query("A18", "part", """+e AS (SELECT 't' || CAST(floor(p_partkey / 3) AS INT) AS parent, 't' || p_partkey AS child FROM part WHERE p_partkey % 11 <> 0), w(path, depth) AS (SELECT 't1', 0 UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON w.path = e.parent),
  r AS (SELECT path, min(depth) AS depth FROM w GROUP BY 1) SELECT a.path, CAST(depth AS INT) AS depth, depth IS NULL AS ignored FROM (SELECT 't' || p_partkey AS path FROM part UNION SELECT 't1') a LEFT JOIN r ON a.path = r.path""", recursive=True)
def a18_package_entries(p: DataFrame) -> DataFrame:
    """All entries of a package with their steps from the root; those that nothing leads to are ignored."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("t"), k.cast("string"))
    e = p.filter(k % 11 != 0).select(F.concat(F.lit("t"), F.floor(k / 3).cast("string")).alias("parent"), name.alias("child"))
    root = p.sparkSession.createDataFrame([("t1",)], "path string")
    return network.walk(p.select(name.alias("path")).union(root).distinct(), e, root)


@query("A19", "v_tri", """SELECT level_key AS path, CAST(0 AS INT) AS mesh, CAST(0 AS INT) AS primitive, count(*) * 3 AS vertices, count(*) AS triangles, round(min(least(x1, x2, x3)), 4) AS west, round(max(greatest(z1, z2, z3)), 4) AS top FROM v_tri GROUP BY 1""")
def a19_mesh_files(tri: DataFrame) -> DataFrame:
    """Binary glTF files of the levels' triangles, packed and read: vertices, triangles and bounds."""
    d = glb.primitives_of(cut(glb.packed(tri, "level_key")))
    return d.select("path", "mesh", "primitive", "vertices", "triangles", F.round(F.get("least", F.lit(0)), 4).alias("west"), F.round(F.get("greatest", F.lit(2)), 4).alias("top"))


@query("D18 G26", "v_tri", """+c AS (SELECT level_key, CASE category WHEN 'Floors' THEN 'walkable' ELSE 'structure' END AS role, unnest([[x1, y1, z1], [x2, y2, z2], [x3, y3, z3]]) AS p FROM v_tri)
  SELECT level_key, role, count(DISTINCT p) AS vertices, count(*) // 3 AS triangles, min(p[1]) AS west, max(p[2]) AS north, max(p[3]) AS top FROM c GROUP BY 1, 2""")
def d18_mesh_batches_by_role(tri: DataFrame) -> DataFrame:
    """One batch for each level and role, with its vertices welded."""
    point = lambda i: F.struct(*[F.col(f"{k}{i}").alias(k) for k in "xyz"])
    d = tri.select("level_key", role_of_category(F.col("category")).alias("role"), point(1).alias("a"), point(2).alias("b"), point(3).alias("c"))
    return scene.batches(d, "level_key", "role").select("level_key", "role", "vertices", "triangles", F.col("least_x").alias("west"), F.col("greatest_y").alias("north"), F.col("greatest_z").alias("top"))


@query("F37 G26", "v_tri", """+b AS (SELECT level_key, min(x1) AS lx, max(x1) AS hx, min(z1) AS lz, max(z1) AS hz FROM v_tri GROUP BY 1)
  SELECT object_id, t.y2 <> t.y1 AS second, CASE WHEN hx > lx THEN CAST(round((x1 - lx) / ((hx - lx) / 65535)) AS INT) ELSE 0 END AS qx, CASE WHEN hz > lz THEN CAST(round((z1 - lz) / ((hz - lz) / 65535)) AS INT) ELSE 0 END AS qz FROM v_tri t JOIN b ON t.level_key = b.level_key""")
def f37_quantized_by_batch(tri: DataFrame) -> DataFrame:
    """First corners in 65,535 steps between the bounds of their level."""
    d = tri.select("object_id", "level_key", (F.col("y2") != F.col("y1")).alias("second"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"))
    return scene.quantized(d, "level_key").select("object_id", "second", "qx", "qz")


@query("F38", "v_tri", """SELECT object_id, y2 <> y1 AS second, round(-y1 + 10, 6) AS x, round(x1 - 5, 6) AS y, round(z1 + 2, 6) AS z FROM v_tri""")
def f38_frame_transform(tri: DataFrame) -> DataFrame:
    """Corners turned by a quarter and moved, as a package's frame is."""
    d = registration.transformed(tri.withColumn("second", F.col("y2") != F.col("y1")), [0, -1, 0, 10, 1, 0, 0, -5, 0, 0, 1, 2, 0, 0, 0, 1])
    return d.select("object_id", "second", *[F.round(f"{k}1", 6).alias(k) for k in "xyz"])

"""Queries over aggregations (inventory group D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo, text
from floorspan.operators import graph, ranges, relational, spatial
from floorspan.plans.registry import query


@query("D4 D5", "v_node v_edge", """+ok AS (SELECT e.* FROM v_edge e JOIN v_node a ON e.from_id = a.node_id JOIN v_node b ON e.to_id = b.node_id WHERE e.from_id % 11 <> 0 AND e.to_id % 11 <> 0),
  deg AS (SELECT node_id, count(*) AS degree FROM (SELECT from_id AS node_id FROM ok UNION ALL SELECT to_id FROM ok) GROUP BY 1)
  SELECT n.ordinal, count(*) AS nodes, CAST(count(*) FILTER (WHERE d.degree IS NULL) AS BIGINT) AS isolated, CAST(sum(coalesce(d.degree, 0)) AS BIGINT) AS ends, coalesce(max(e.cost), 0) AS total_cost
  FROM v_node n LEFT JOIN deg d USING (node_id) LEFT JOIN (SELECT a.ordinal, sum(cost) AS cost FROM ok JOIN v_node a ON ok.from_id = a.node_id GROUP BY 1) e USING (ordinal) GROUP BY n.ordinal""")
def network_floor_report(n: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes, isolated nodes, edge ends and total cost of each floor, once edges without both ends are gone."""
    ok = graph.attach_nodes(e.filter("from_id % 11 <> 0 and to_id % 11 <> 0"), n)
    cost = ok.groupBy(F.col("from_ordinal").alias("ordinal")).agg(F.sum("cost").alias("cost"))
    per = n.join(graph.degree(n, ok), "node_id").groupBy("ordinal").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.sum("degree").alias("ends"))
    return per.join(cost, "ordinal", "left").select("ordinal", "nodes", "isolated", "ends", F.coalesce("cost", F.lit(0.0)).alias("total_cost"))


@query("D1 D2 D26", "v_unit", """SELECT level_id, CASE WHEN max(x) = min(x) THEN min(x) - 1e-6 ELSE min(x) END AS west, CASE WHEN max(y) = min(y) THEN min(y) - 1e-6 ELSE min(y) END AS south, CASE WHEN max(x) = min(x) THEN max(x) + 1e-6 ELSE max(x) END AS east, CASE WHEN max(y) = min(y) THEN max(y) + 1e-6 ELSE max(y) END AS north FROM v_unit GROUP BY 1""")
def d01_bounds_per_level(d: DataFrame) -> DataFrame:
    return spatial.padded(spatial.bounds(d, "level_id"))


@query("D3", "v_node", "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM v_node")
def d03_venue_bounds(d: DataFrame) -> DataFrame:
    return spatial.bounds(d, x="lon", y="lat")


@query("D4 D5", "v_unit", "SELECT count(*) AS features, CAST(count(*) FILTER (WHERE category IS NOT NULL) AS BIGINT) AS with_category, count(DISTINCT level_id) AS levels FROM v_unit")
def d04_feature_counts(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("features"), F.count("category").alias("with_category"), F.count_distinct("level_id").alias("levels"))


@query("D6", "v_media v_version", "SELECT v.id AS version_id, CAST(coalesce(sum(m.bytes + m.thumbnail), 0) AS BIGINT) AS bytes FROM v_version v LEFT JOIN v_media m ON m.version_id = v.id AND m.state = 'attached' GROUP BY 1")
def d06_attachment_bytes(m: DataFrame, v: DataFrame) -> DataFrame:
    per = m.filter("state = 'attached'").groupBy("version_id").agg(F.sum(F.col("bytes") + F.col("thumbnail")).alias("bytes"))
    return v.select(F.col("id").alias("version_id")).join(per, "version_id", "left").select("version_id", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


@query("D7", "v_venue v_version", "SELECT n.id AS venue_id, CAST(coalesce(max(v.seq), 0) + 1 AS BIGINT) AS next_seq FROM v_venue n LEFT JOIN v_version v ON v.venue_id = n.id AND v.status = 'failed' GROUP BY 1")
def d07_next_sequence(n: DataFrame, v: DataFrame) -> DataFrame:
    top = v.filter("status = 'failed'").groupBy("venue_id").agg(F.max("seq").alias("seq"))
    return n.select(F.col("id").alias("venue_id")).join(top, "venue_id", "left").select("venue_id", (F.coalesce("seq", F.lit(0)) + 1).cast("long").alias("next_seq"))


@query("D8", "v_job", """+d AS (SELECT * FROM v_job WHERE status = 'done' AND version_id % 7 <> 3 AND value > 0), r AS (SELECT version_id, value FROM d QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY created_at DESC, id DESC) <= 20),
  o AS (SELECT version_id, quantile_disc(value, 0.75) AS p FROM r GROUP BY 1), g AS (SELECT quantile_disc(value, 0.75) AS p FROM (SELECT value FROM d ORDER BY created_at DESC, id DESC LIMIT 20))
  SELECT v.version_id, CAST(greatest(1, round(coalesce(o.p, g.p))) AS BIGINT) AS seconds, o.p IS NULL AS from_all FROM (SELECT DISTINCT version_id FROM v_job) v LEFT JOIN o USING (version_id), g""")
def d08_expected_seconds(d: DataFrame) -> DataFrame:
    """How long a version's next job may take, by its last 20 durations; versions without any go by the last 20 of all."""
    done = d.filter("status = 'done' and version_id % 7 <> 3 and value > 0")
    return relational.expected_seconds(d.select("version_id").distinct(), done, "version_id", "value", ["created_at", "id"])


@query("D8 E13", "v_job", """+r AS (SELECT version_id, value FROM v_job WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY created_at DESC, id DESC) <= 20)
  SELECT version_id, CAST(greatest(1, round(quantile_disc(value, 0.75))) AS BIGINT) AS seconds FROM r GROUP BY 1""")
def d08_recent_duration_p75(d: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("version_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = d.filter("status = 'done'").withColumn("k", F.row_number().over(w)).filter("k <= 20")
    return recent.groupBy("version_id").agg(F.greatest(F.lit(1), F.round(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY value)")).cast("long")).cast("long").alias("seconds"))


@query("D9 G28", "v_node v_unit", """+r AS (SELECT l.level_id, u.w * 1e5 AS residual FROM (SELECT DISTINCT level_id FROM v_unit) l LEFT JOIN v_unit u ON l.level_id = u.level_id AND u.category IS NOT NULL)
  SELECT level_id, count(residual) AS n, quantile_disc(residual, 0.5) AS p50, quantile_disc(residual, 0.9) AS p90, max(residual) AS worst FROM r GROUP BY 1""")
def d09_residual_percentiles(n: DataFrame, u: DataFrame) -> DataFrame:
    return spatial.residual_stats(u.withColumn("residual", F.when(F.col("category").isNotNull(), F.col("w") * 1e5)), "level_id", "residual")


@query("D10 D11 F36", "v_node", "SELECT ordinal, median(altitude) AS middle, CASE WHEN count(*) >= 3 AND max(altitude) - min(altitude) <= 1e0 THEN median(altitude) END AS trusted FROM (SELECT ordinal * 10 + floor(altitude) AS ordinal, altitude FROM v_node) GROUP BY 1")
def d10_medians(d: DataFrame) -> DataFrame:
    d = d.select((F.col("ordinal") * 10 + F.floor("altitude")).alias("ordinal"), "altitude")
    middle = ranges.percentiles(d, ["ordinal"], "altitude", middle="middle")
    return middle.join(spatial.trusted_median(d, "ordinal", "altitude"), "ordinal").select("ordinal", "middle", F.col("median").alias("trusted"))


@query("F36 E3", "v_node", """+m AS (SELECT ordinal, CASE WHEN ordinal <> 0 THEN median(altitude) END AS plane FROM v_node GROUP BY 1), f AS (SELECT ordinal, coalesce(plane, ordinal * 4e0) AS z FROM m)
  SELECT ordinal, CASE WHEN ordinal = 1 THEN -3e0 ELSE z - (SELECT min(z) FROM f) END AS plane FROM f""")
def f36_floor_planes(d: DataFrame) -> DataFrame:
    """Network medians, else nominal spacing; the lowest goes to 0; overrides come last and move nothing else."""
    known = ranges.percentiles(d.filter("ordinal <> 0"), ["ordinal"], "altitude", middle="m")
    per = d.select("ordinal").distinct().join(known, "ordinal", "left").select("ordinal", F.coalesce("m", F.col("ordinal") * 4.0).alias("z"))
    low = per.agg(F.min("z")).scalar()
    return per.select("ordinal", F.when(F.col("ordinal") == 1, -3.0).otherwise(F.col("z") - low).alias("plane"))


@query("D12", "v_unit", """+c AS (SELECT building, coalesce(category, '?') AS v, count(*) AS n, max(unit_id) AS last FROM v_unit GROUP BY 1, 2) SELECT building, v AS label FROM c QUALIFY row_number() OVER (PARTITION BY building ORDER BY n DESC, last) = 1""")
def d12_mode_first_to_reach(d: DataFrame) -> DataFrame:
    return relational.mode_first_to_reach(d.withColumn("label", F.coalesce("category", F.lit("?"))), "building", "label", "unit_id")


@query("D13", "v_node", """+b AS (SELECT ordinal, CAST(floor(altitude / 0.5e0) AS BIGINT) AS bin, round(sum(1e0 + node_id % 7), 6) AS weight FROM v_node GROUP BY 1, 2) SELECT ordinal, bin FROM b QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY weight DESC, bin) = 1""")
def d13_weighted_mode(d: DataFrame) -> DataFrame:
    return spatial.weighted_mode(d, "ordinal", F.col("altitude"), 1.0 + F.col("node_id") % 7, 0.5)


@query("D15 G20", "v_node v_net", """+e AS (SELECT from_id AS node_id FROM v_net UNION ALL SELECT to_id FROM v_net) SELECT n.node_id, CAST(count(e.node_id) AS BIGINT) AS degree FROM v_node n LEFT JOIN e USING (node_id) GROUP BY 1""")
def d15_degree(n: DataFrame, e: DataFrame) -> DataFrame:
    return graph.degree(n, e)


@query("D16", "v_level", "SELECT ordinal, list(level_id ORDER BY building) AS level_ids, first(label ORDER BY building) AS representative FROM v_level GROUP BY 1")
def d16_levels_by_ordinal(d: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("building", "level_id", "label")))  # levels of an ordinal: few
    d = d.groupBy("ordinal").agg(rows.alias("x"))
    return d.select("ordinal", F.col("x.level_id").alias("level_ids"), F.col("x")[0]["label"].alias("representative"))


@query("D17", "embeddings", """+c AS (SELECT CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.1e0) AS BIGINT) AS cx, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.1e0) AS BIGINT) AS cy, count(*) AS n, median(CAST(embedding[3] AS DOUBLE)) AS mx, median(CAST(embedding[4] AS DOUBLE)) AS my FROM embeddings GROUP BY 1, 2)
  SELECT cx, cy, n, mx, my FROM c WHERE n >= 5 AND sqrt(mx * mx + my * my) > 0.02e0""")
def d17_grid_clusters(d: DataFrame) -> DataFrame:
    d = d.select(*[F.col("embedding")[i].cast("double").alias(k) for i, k in enumerate(("x", "y", "dx", "dy"))])
    return spatial.clusters(d, "x", "y", "dx", "dy", 0.1, 5, 0.02)


@query("", "v_unit", "SELECT level_id, coalesce(category, '?') AS role, count(*) AS primitives, CAST(sum(4) AS BIGINT) AS vertices, min(unit_id) AS first_id FROM v_unit GROUP BY 1, 2")
def d18_mesh_batches(d: DataFrame) -> DataFrame:
    return d.groupBy("level_id", F.coalesce("category", F.lit("?")).alias("role")).agg(F.count("*").alias("primitives"), F.sum(F.lit(4)).alias("vertices"), F.min("unit_id").alias("first_id"))


@query("D19", "v_net v_node", "SELECT least(from_id, to_id) AS lo, greatest(from_id, to_id) AS hi FROM v_net GROUP BY 1, 2 HAVING count(*) = 1")
def d19_boundary_edges(e: DataFrame, n: DataFrame) -> DataFrame:
    return spatial.boundary_edges(e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query("", "v_net v_node", """+p AS (SELECT e.cost / 1000 AS walk, asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) * 12742000e0 AS line, e.from_id, e.to_id
    FROM v_net e JOIN v_node a ON e.from_id = a.node_id JOIN v_node b ON e.to_id = b.node_id WHERE a.ordinal = b.ordinal), f AS (SELECT * FROM p WHERE line > 0)
  SELECT count(*) AS pairs, CAST(count(*) FILTER (WHERE walk < line) AS BIGINT) AS shorter, round(max(walk / line), 6) AS stretch, round(sum(walk) / sum(line), 6) AS ratio FROM f""")
def d20_route_quality(e: DataFrame, n: DataFrame) -> DataFrame:
    ends = [n.select(F.col("node_id").alias(f"{k}_id"), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"), F.col("ordinal").alias(f"{k}_o")) for k in ("from", "to")]
    d = e.join(ends[0], "from_id").join(ends[1], "to_id").filter("from_o = to_o")
    d = d.select("from_id", "to_id", (F.col("cost") / 1000).alias("walk"), geo.haversine(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")).alias("line"))
    d = d.filter("line > 0")
    ratio = F.when(F.sum("line") > 0, F.sum("walk") / F.sum("line"))
    return d.agg(F.count("*").alias("pairs"), F.count_if(F.col("walk") < F.col("line")).alias("shorter"), F.round(F.max(F.col("walk") / F.col("line")), 6).alias("stretch"), F.round(ratio, 6).alias("ratio"))


_REACH = """r AS (SELECT from_id AS a, to_id AS b FROM v_net WHERE to_id IN (SELECT node_id FROM v_node) UNION ALL SELECT to_id, from_id FROM v_net WHERE to_id IN (SELECT node_id FROM v_node)),
  w(a, b) AS (SELECT node_id, node_id FROM v_node UNION SELECT w.a, r.b FROM w JOIN r ON w.b = r.a), comp AS (SELECT a AS node_id, min(b) AS component FROM w GROUP BY 1)"""


@query("D22", "v_node v_net", "+" + _REACH + """, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), top AS (SELECT component FROM s ORDER BY size DESC, component LIMIT 1)
  SELECT CAST((SELECT count(*) FROM comp) AS BIGINT) AS nodes, CAST(count(*) AS BIGINT) AS components, max(size) AS largest, CAST(count(*) FILTER (WHERE size = 1) AS BIGINT) AS isolated,
    CAST((SELECT count(DISTINCT ordinal) FROM v_node n JOIN comp USING (node_id) JOIN top USING (component)) AS BIGINT) AS floors_in_largest FROM s""", recursive=True)
def d22_network_connectivity(n: DataFrame, e: DataFrame) -> DataFrame:
    _, e = graph.clip(n, e, n)
    c = graph.connected_components(n, e)
    s = c.groupBy("component").agg(F.count("*").alias("size"))
    total = s.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("isolated"), F.max_by("component", F.struct("size", (-F.col("component")).alias("k"))).alias("top"))
    floors = n.join(c, "node_id").join(F.broadcast(total.select(F.col("top").alias("component"))), "component").agg(F.count_distinct("ordinal").alias("floors_in_largest"))
    return total.drop("top").join(floors)  # one row beside one row


@query("D23", "v_blob", "SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY substr(md5(body), 1, 2)) AS n FROM v_blob) WHERE n = 1 OR id % 10 = 0")
def d23_count_one_ids(d: DataFrame) -> DataFrame:
    d = d.select("id", F.substring(F.md5("body"), 1, 2).alias("k"))
    counts = d.groupBy("k").agg(F.count("*").alias("n"))
    return d.join(counts, "k").filter("n = 1 or id % 10 = 0").select("id")


@query("D24 D25", "v_layer", "SELECT layer, CAST(sum(p_size) AS BIGINT) AS skipped, 'missing_geometry' AS code FROM v_layer WHERE p_size > 25 GROUP BY 1")
def d24_warning_rollup(d: DataFrame) -> DataFrame:
    return d.filter("p_size > 25").groupBy("layer").agg(F.sum("p_size").alias("skipped")).select("layer", "skipped", F.lit("missing_geometry").alias("code"))


@query("D25 E18", "v_job", "SELECT kind, status, max(id) AS latest FROM (SELECT kind, status, id FROM v_job UNION ALL SELECT 'retry ' || kind, status, id FROM v_job WHERE status = 'error') GROUP BY 1, 2")
def d25_latest_warning_per_message(d: DataFrame) -> DataFrame:
    """The last of all messages of a kind and status; jobs that failed leave a second message."""
    bag = d.select("kind", "status", "id").unionByName(d.filter("status = 'error'").select(F.concat(F.lit("retry "), "kind").alias("kind"), "status", "id"))
    return bag.groupBy("kind", "status").agg(F.max("id").alias("latest"))


@query("D27", "v_unit", "SELECT unit_id, round(w * h * 1e10, 4) AS area, round(x + w / 2, 9) AS cx, round(y + h / 2, 9) AS cy FROM v_unit")
def d27_polygon_area_and_centroid(d: DataFrame) -> DataFrame:
    # local coordinates keep the products exact enough
    ring = geo.rectangle(F.lit(0.0), F.lit(0.0), F.col("w") * 1e5, F.col("h") * 1e5)
    c = geo.ring_centroid(ring)
    return d.select("unit_id", F.round(geo.ring_area(ring), 4).alias("area"), F.round(F.col("x") + c["x"] * 1e-5, 9).alias("cx"), F.round(F.col("y") + c["y"] * 1e-5, 9).alias("cy"))


@query("D29 A21", "v_blob", "SELECT source, CAST(sum(byte_size) AS BIGINT) AS bytes, count(DISTINCT sha256(body)) AS blobs, list_sort(list(DISTINCT version_id)) AS versions FROM v_blob GROUP BY 1")
def d29_package_totals(d: DataFrame) -> DataFrame:
    return d.groupBy("source").agg(F.sum("byte_size").alias("bytes"), F.count_distinct(F.sha2("body", 256)).alias("blobs"), F.array_sort(F.collect_set("version_id")).alias("versions"))


@query("D14", "v_unit", "SELECT category, count(DISTINCT level_id) AS levels, count(DISTINCT building % 5) AS ordinals FROM v_unit WHERE category IN ('walkway', 'ramp', 'platform', 'lobby', 'footbridge') GROUP BY 1")
def d14_distinct_sets(d: DataFrame) -> DataFrame:
    return d.filter(text.is_walkway(F.col("category"))).groupBy("category").agg(F.count_distinct("level_id").alias("levels"), F.count_distinct(F.col("building") % 5).alias("ordinals"))

"""Venue-shaped views over the given tables, as SQL that Spark and DuckDB both run.

A view's text names tables and other views in braces.  ``frame`` builds the Spark DataFrame; ``with_views``
builds the common table expressions for the other engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_level": "SELECT 'L' || CAST(n_nationkey AS STRING) AS level_id, CAST(n_regionkey - 2 AS DOUBLE) AS ordinal, n_name AS label, n_nationkey AS building FROM {nation}",
    "v_node": """SELECT s_suppkey AS node_id, 139.76e0 + (s_suppkey % 40) * 1e-4 AS lon, 35.68e0 + floor(s_suppkey / 40) * 1e-4 AS lat,
        CAST(n_regionkey - 2 AS DOUBLE) AS ordinal, s_acctbal / 1000e0 AS altitude FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "v_edge": """SELECT l_suppkey AS from_id, l_partkey % (SELECT count(*) + 2 FROM {supplier}) AS to_id, min(l_quantity) * 1000e0 AS cost,
        min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS direction, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS barrier,
        min(l_linenumber) AS line, min(l_discount) AS discount FROM {lineitem} GROUP BY 1, 2""",
    "v_net": "SELECT e.* FROM {v_edge} e WHERE e.from_id % 11 <> 0 AND e.to_id % 11 <> 0 AND e.from_id <> e.to_id",
    "v_attr": """SELECT from_id, to_id, cost, direction, barrier = 1 AS barrier, (from_id + to_id) % 7 = 0 AS accessible_only, (from_id + to_id) % 3 <> 0 AS wheelchair,
        CASE (from_id + 3 * to_id) % 6 WHEN 0 THEN 'stairs' WHEN 1 THEN 'escalator' WHEN 2 THEN 'elevator' ELSE NULL END AS vertical,
        CASE WHEN to_id % 4 = 0 THEN NULL ELSE 0.5e0 + (to_id % 10) / 10e0 END AS clearance_m,
        CASE WHEN from_id % 5 = 0 THEN -1 ELSE CAST((from_id * 37) % 1440 AS INT) END AS start_minute,
        CASE WHEN from_id % 5 = 0 THEN -1 ELSE CAST((to_id * 53) % 1440 AS INT) END AS end_minute FROM {v_edge}""",
    "v_unit": """SELECT p_partkey AS unit_id, 'L' || CAST(p_partkey % 25 AS STRING) AS level_id, CAST(p_partkey % 25 AS INT) AS building,
        CASE p_partkey % 12 WHEN 0 THEN 'walkway' WHEN 1 THEN 'elevator' WHEN 2 THEN 'stairs' WHEN 3 THEN 'escalator' WHEN 4 THEN 'room' WHEN 5 THEN 'ramp'
          WHEN 6 THEN 'unenclosedarea' WHEN 7 THEN 'platform' WHEN 8 THEN 'restroom.female' WHEN 9 THEN 'lobby' WHEN 10 THEN 'footbridge' ELSE NULL END AS category,
        139.76e0 + (p_partkey % 40) * 1e-4 AS x, 35.68e0 + floor(p_partkey / 40) * 1e-4 AS y, (5 + p_size % 7) * 1e-5 AS w, (4 + p_size % 5) * 1e-5 AS h FROM {part}""",
    "v_unit_stack": """SELECT p_partkey AS unit_id, 'L' || CAST(p_partkey % 25 AS STRING) AS level_id, CAST(p_partkey % 25 AS INT) AS building,
        CASE p_partkey % 12 WHEN 0 THEN 'walkway' WHEN 1 THEN 'elevator' WHEN 2 THEN 'stairs' WHEN 3 THEN 'escalator' WHEN 4 THEN 'room' WHEN 5 THEN 'ramp'
          WHEN 6 THEN 'unenclosedarea' WHEN 7 THEN 'platform' WHEN 8 THEN 'restroom.female' WHEN 9 THEN 'lobby' WHEN 10 THEN 'footbridge' ELSE NULL END AS category,
        139.76e0 + (p_partkey % 40) * 1e-4 AS x, 35.68e0 + (floor(p_partkey / 40) % 40) * 1e-4 AS y, (5 + p_size % 7) * 1e-5 AS w, (4 + p_size % 5) * 1e-5 AS h FROM {part}""",
    "v_feature": """SELECT CASE WHEN unit_id % 150 = 0 THEN 'u1' ELSE 'u' || CAST(unit_id AS STRING) END AS id, CASE unit_id % 7 WHEN 0 THEN 'occupant' WHEN 1 THEN 'anchor' WHEN 2 THEN 'opening' ELSE 'unit' END AS feature_type,
        CASE WHEN unit_id % 200 = 0 THEN 'L99' ELSE level_id END AS level_id, unit_id % 7 <> 0 OR unit_id % 14 = 0 AS has_geometry, CASE WHEN unit_id % 21 <> 0 THEN x END AS x, y FROM {v_unit}
        UNION ALL SELECT level_id, 'level', CAST(NULL AS STRING), building % 8 <> 7, 0e0, 0e0 FROM {v_level} WHERE building % 6 <> 0
        UNION ALL SELECT 'L7' || CAST(r_regionkey + 5 AS STRING), 'level', CAST(NULL AS STRING), true, 0e0, 0e0 FROM {region} WHERE r_regionkey = 2
        UNION ALL SELECT 'v' || CAST(r_regionkey AS STRING), 'venue', CAST(NULL AS STRING), true, 0e0, 0e0 FROM {region} WHERE r_regionkey < 2
        UNION ALL SELECT 'b' || CAST(building AS STRING), CASE WHEN building % 2 = 0 THEN 'building' ELSE 'footprint' END, CAST(NULL AS STRING), building % 5 <> 0, 0e0, 0e0 FROM {v_level}""",
    "v_user": "SELECT c_custkey AS id, c_name AS username, CASE c_custkey % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' ELSE 'member' END AS role FROM {customer}",
    "v_venue": "SELECT n_nationkey AS id, n_regionkey AS tenant_id, lower(n_name) AS slug, n_name AS name FROM {nation}",
    "v_version": """SELECT p_partkey AS id, CAST(p_partkey % 25 AS INT) AS venue_id, CAST(floor(p_partkey / 25) AS BIGINT) AS seq,
        CASE p_partkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' WHEN 2 THEN 'published' ELSE 'failed' END AS status,
        CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE 'b' || CAST(p_partkey % 97 AS STRING) END AS bundle_hash, p_name AS public_id FROM {part}""",
    "v_issue": """SELECT o_orderkey AS id, CAST(o_custkey % 40 AS BIGINT) AS version_id, o_custkey AS author_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'in_review' END AS status,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 + o_orderkey % 50 END AS assignee_id, o_orderdate AS created_at, o_orderkey % 17 = 0 AS deleted, 1 + o_orderkey % 3 AS row_version,
        o_totalprice AS price, o_orderpriority AS priority FROM {orders}""",
    "v_reply": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS parent_id, CAST(o_custkey % 40 AS BIGINT) AS version_id, l_suppkey AS author_id, l_shipdate AS created_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "v_job": """SELECT event_id AS id, event_type AS kind, CAST(user_id % 60 AS BIGINT) AS version_id, ts AS created_at, value,
        CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'error' END AS status, props FROM {events}""",
    "v_blob": "SELECT doc_id AS id, CAST(doc_id % 30 AS BIGINT) AS version_id, text AS body, n_chars AS byte_size, source FROM {documents}",
    "v_media": """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 40 AS BIGINT) AS version_id, CAST(l_partkey % 900 AS BIGINT) AS original, CAST(l_suppkey % 700 AS BIGINT) AS thumbnail,
        CAST(l_quantity AS BIGINT) AS bytes, CASE l_returnflag WHEN 'A' THEN 'staged' WHEN 'N' THEN 'attached' ELSE 'detached' END AS state, l_shipdate AS created_at FROM {lineitem}""",
    "v_stored": "SELECT p_partkey % 1000 AS blob_id, min(p_size) AS size FROM {part} GROUP BY 1",
    "v_entry": """SELECT p_partkey AS feature_id, CASE p_partkey % 5 WHEN 0 THEN 'opening' WHEN 1 THEN 'occupant' WHEN 2 THEN 'amenity' WHEN 3 THEN 'kiosk' ELSE 'level' END AS feature_type,
        'L' || CAST(p_partkey % 25 AS STRING) AS level_id, lower(p_name) AS label, lower(p_brand) AS alt_label,
        CASE p_partkey % 3 WHEN 0 THEN 'pedestrian.gate' WHEN 1 THEN lower(p_type) ELSE NULL END AS category FROM {part}""",
    "v_label": """SELECT p_partkey AS id, CASE p_partkey % 14 WHEN 0 THEN 'F' || CAST(p_size AS STRING) WHEN 1 THEN 'b' || CAST(p_size AS STRING) WHEN 2 THEN 'M' || CAST(p_size AS STRING) || 'F'
        WHEN 3 THEN 'KB' || CAST(p_size AS STRING) WHEN 4 THEN 'RF' WHEN 5 THEN CAST(p_size AS STRING) || 'F' WHEN 6 THEN 'Floor ' || CAST(p_size AS STRING) WHEN 7 THEN 'GF_main' WHEN 8 THEN 'B' || CAST(p_size AS STRING) || 'FL(1FL)_x(TP-5.11)'
        WHEN 9 THEN 'L' || CAST(p_size AS STRING) WHEN 10 THEN 'lobby-' || CAST(p_size AS STRING) || 'f' WHEN 11 THEN 'basement' || CAST(p_size % 10 + 1 AS STRING) WHEN 12 THEN '' ELSE p_name END AS label FROM {part}""",
    "v_slab": """SELECT p_partkey AS object_id, 'main' AS document, 'link' AS link, CASE WHEN p_partkey % 25 = 24 THEN '' ELSE 'K' || CAST(p_partkey % 25 AS STRING) END AS level_key,
        'L' || CAST(CASE WHEN p_partkey % 25 = 7 THEN 8 ELSE p_partkey % 25 END AS STRING) AS level_name, 'L' || CAST(p_partkey % 25 AS STRING) AS level_id, (p_partkey % 25) * 4e0 AS elevation,
        CASE WHEN p_partkey % 25 = 5 OR p_size % 9 = 0 THEN 'Walls' ELSE 'Floors' END AS category, (floor(p_partkey / 25) % 20) * 4e0 AS x, (floor(p_partkey / 500) % 20) * 3e0 AS y,
        (p_partkey % 25) * 4e0 + CASE WHEN p_size % 4 = 0 THEN 0.3e0 ELSE 0.1e0 END AS z FROM {part}""",
    "v_tri": """SELECT object_id, document, link, level_key, level_name, elevation, category, x AS x1, y AS y1, z AS z1, x + 4e0 AS x2, y AS y2, z AS z2, x + 4e0 AS x3, y + 3e0 AS y3, z AS z3 FROM {v_slab}
        UNION ALL SELECT object_id, document, link, level_key, level_name, elevation, category, x, y, z, x + 4e0, y + 3e0, z, x, y + 3e0, z FROM {v_slab}""",
    "v_floor": """SELECT 'L' || CAST(n_nationkey AS STRING) AS level_id, 'L' || CAST(n_nationkey AS STRING) AS label,
        CASE n_nationkey WHEN 11 THEN 40.9e0 WHEN 20 THEN 300e0 ELSE n_nationkey * 4e0 + 0.2e0 * (n_nationkey % 3) END AS floor_plane FROM {nation}""",
    "v_unit_box": """SELECT level_id, x + 0.04e0 * (object_id % 25 % 5) + CASE WHEN object_id % 25 = 13 THEN 1.3e0 ELSE 0e0 END AS west, y AS south, x + 0.04e0 * (object_id % 25 % 5) + CASE WHEN object_id % 25 = 13 THEN 1.3e0 ELSE 0e0 END + 4e0 AS east,
        y + 3e0 AS north FROM {v_slab} WHERE category = 'Floors'""",
    "v_outline": """SELECT level_id, west AS x1, south AS y1, east AS x2, south AS y2 FROM {v_unit_box} UNION ALL SELECT level_id, east, south, east, north FROM {v_unit_box}
        UNION ALL SELECT level_id, east, north, west, north FROM {v_unit_box} UNION ALL SELECT level_id, west, north, west, south FROM {v_unit_box}""",
    "v_ask": """SELECT n_nationkey AS request_id, 139.7601e0 + (n_nationkey * 7 % 40) * 0.93e-4 AS lon1, 35.68e0 + (n_nationkey % 3) * 0.8e-4 + 0.00001e0 AS lat1, CASE WHEN n_nationkey = 3 THEN 9e0 ELSE CAST(n_regionkey - 2 AS DOUBLE) END AS ordinal1,
        139.7602e0 + (n_nationkey * 11 % 40) * 0.97e-4 AS lon2, 35.68005e0 + (n_nationkey % 2) * 0.9e-4 AS lat2, CAST((n_nationkey * 3) % 5 - 2 AS DOUBLE) AS ordinal2 FROM {nation}""",
    "v_room": """SELECT p_partkey AS unit_id, 'L' || CAST(p_partkey % 25 AS STRING) AS level_id, CAST(floor(p_partkey / 25) AS BIGINT) % 40 * 4000 AS x, CAST(floor(p_partkey / 1000) AS BIGINT) * 3000 AS y,
        CAST(CASE WHEN p_size % 4 <> 0 THEN 2200 + p_size * 20 END AS BIGINT) AS height, p_partkey % 12 = 7 AS platform, p_size % 3 = 0 AS split, p_size FROM {part}""",
    "v_side": """SELECT unit_id, level_id, height, platform, x AS ax, y AS ay, CASE WHEN split THEN x + 2000 ELSE x + 4000 END AS cx, y AS cy FROM {v_room}
        UNION ALL SELECT unit_id, level_id, height, platform, x + 2000, y, x + 4000, y FROM {v_room} WHERE split
        UNION ALL SELECT unit_id, level_id, height, platform, x + 4000, y, x + 4000, y + 3000 FROM {v_room} UNION ALL SELECT unit_id, level_id, height, platform, x, y + 3000, x + 4000, y + 3000 FROM {v_room}
        UNION ALL SELECT unit_id, level_id, height, platform, x, y, x, y + 3000 FROM {v_room}""",
    "v_door": """SELECT unit_id AS opening_id, level_id, x + CASE unit_id % 4 WHEN 0 THEN 1600 WHEN 1 THEN 4000 + (p_size % 9 - 4) * 55 ELSE 3000 END AS px, y + CASE unit_id % 4 WHEN 0 THEN (p_size % 9 - 4) * 55 WHEN 1 THEN 500 + p_size * 10 ELSE -100 END AS py,
        x + CASE unit_id % 4 WHEN 0 THEN 2400 + p_size % 5 * 100 WHEN 1 THEN 4000 + (p_size % 9 - 4) * 55 ELSE 4600 END AS qx, y + CASE unit_id % 4 WHEN 0 THEN (p_size % 9 - 4) * 55 WHEN 1 THEN 1400 + p_size * 10 ELSE 100 END AS qy FROM {v_room} WHERE unit_id % 4 <> 3""",
    "v_mid": """SELECT p_partkey AS node_id, p_partkey % 5 AS floor, CAST(floor(p_partkey / 5) AS BIGINT) AS j, CAST(floor(p_partkey / 5) AS BIGINT) % 40 * 1.2e0 + p_size % 5 * 0.1e0 AS x, CAST(floor(p_partkey / 200) AS BIGINT) * 1.9e0 + p_size % 7 * 0.1e0 AS y,
        0.5e0 + p_size % 10 * 0.3e0 AS clearance, p_size % 8 = 0 AS endcap, p_size FROM {part}""",
    "v_midline": """SELECT a.node_id AS from_id, b.node_id AS to_id FROM {v_mid} a JOIN {v_mid} b ON b.node_id = a.node_id + 5 WHERE a.j % 17 <> 16 AND a.j % 40 <> 39 AND a.p_size % 9 <> 0
        UNION ALL SELECT a.node_id, b.node_id FROM {v_mid} a JOIN {v_mid} b ON b.node_id = a.node_id + 200 WHERE a.j % 10 = 3 AND a.p_size % 3 <> 0""",
    "v_layer": """SELECT p_partkey AS id, 'Station_' || CAST(p_partkey % 3 AS STRING) || '_' || CASE p_partkey % 6 WHEN 0 THEN 'B1' WHEN 1 THEN '2' WHEN 2 THEN 'R' WHEN 3 THEN '0' WHEN 4 THEN 'M2' ELSE 'F3' END || '_' ||
        CASE p_partkey % 9 WHEN 0 THEN 'Floor' WHEN 1 THEN 'Space' WHEN 2 THEN 'Drawing' WHEN 3 THEN 'unit' WHEN 4 THEN 'opening' WHEN 5 THEN 'fixture' WHEN 6 THEN 'to_x_Drawing' WHEN 7 THEN 'Facility' ELSE 'misc' END AS layer,
        p_size, p_brand FROM {part}""",
}


def _expand(name: str, out: dict[str, str]) -> None:
    if name in out or name not in VIEWS:
        return
    for dep in re.findall(r"\{(\w+)\}", VIEWS[name]):
        _expand(dep, out)
    out[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the definitions of the views and all that they stand on, for the other engine."""
    out: dict[str, str] = {}
    for name in names:
        _expand(name, out)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{k} AS ({v})" for k, v in out.items()) if out else ("WITH RECURSIVE " if recursive else "")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    deps = {d: frame(spark, sf_dir, d) for d in dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    return spark.sql(VIEWS[name], **deps)

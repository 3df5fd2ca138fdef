"""Queries over scalar functions (inventory group F and the scalar rows of A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import floors, geo, text
from floorspan.plans.registry import query

_STRICT = """CASE WHEN regexp_full_match(upper(trim(label)), '[A-Z]+[0-9]{1,9}F?') THEN
  CASE WHEN regexp_extract(upper(trim(label)), '^([A-Z]+)', 1) = 'F' THEN CAST(regexp_extract(upper(trim(label)), '([0-9]+)', 1) AS INT) - 1
       WHEN regexp_extract(upper(trim(label)), '^([A-Z]+)', 1) = 'M' THEN CAST(regexp_extract(upper(trim(label)), '([0-9]+)', 1) AS INT)
       WHEN regexp_full_match(regexp_extract(upper(trim(label)), '^([A-Z]+)', 1), '[A-Z]*B') THEN -CAST(regexp_extract(upper(trim(label)), '([0-9]+)', 1) AS INT) END END"""


@query("F1 F3", "v_label", f"SELECT id, CAST({_STRICT} AS DOUBLE) AS ordinal, CASE WHEN {_STRICT} >= 0 THEN 'F' || CAST({_STRICT} + 1 AS STRING) WHEN {_STRICT} < 0 THEN 'B' || CAST(-({_STRICT}) AS STRING) END AS label_back FROM v_label")
def f01_floor_label_to_ordinal(d: DataFrame) -> DataFrame:
    o = floors.label_to_ordinal(F.col("label"))
    return d.select("id", o.alias("ordinal"), floors.ordinal_to_label(o).alias("label_back"))


_TOKENS = """+syn AS (SELECT tok, max(o) AS o FROM (
    SELECT unnest([CAST(n AS VARCHAR) || 'f', 'f' || CAST(n AS VARCHAR), CAST(n AS VARCHAR) || '階', CAST(n AS VARCHAR) || 'fl', CAST(n AS VARCHAR) || 'floor', 'floor' || CAST(n AS VARCHAR), CAST(n AS VARCHAR)]) AS tok, n - 1 AS o FROM range(1, 61) t(n)
    UNION ALL SELECT unnest(['gf', 'g階', 'ground', '0', 'f0', '0f', '0fl', '0floor', 'floor0']), 0
    UNION ALL SELECT unnest(['b' || CAST(n AS VARCHAR), 'b' || CAST(n AS VARCHAR) || 'f', 'b' || CAST(n AS VARCHAR) || 'fl', 'b' || CAST(n AS VARCHAR) || 'floor', CAST(n AS VARCHAR) || 'b', 'bf' || CAST(n AS VARCHAR),
      '地下' || CAST(n AS VARCHAR) || '階', '地下' || CAST(n AS VARCHAR) || 'f', '地下' || CAST(n AS VARCHAR) || 'fl', 'basement' || CAST(n AS VARCHAR)]), -n FROM range(1, 11) t(n)) GROUP BY tok),
  word AS (SELECT id, 0 AS k, 0 AS i, regexp_split_to_array(trim(label), '[_\\s（(]+')[1] AS w, label FROM {v}
    UNION ALL SELECT id, 1, generate_subscripts(a, 1), unnest(a), label FROM (SELECT id, label, list_filter(regexp_split_to_array(lower(trim(label)), '[_\\-\\s.]+'), lambda x: x <> '') AS a FROM {v})),
  val AS (SELECT word.id, k, i, length(w) AS n, coalesce(o, CASE WHEN regexp_full_match(lower(w), 'm[0-9]{1,9}') THEN CAST(regexp_extract(w, '([0-9]+)', 1) AS INT)
    WHEN regexp_full_match(lower(w), '[a-z]+b[0-9]{1,9}f?') THEN -CAST(regexp_extract(w, '([0-9]+)', 1) AS INT) END) AS v FROM word LEFT JOIN syn ON lower(w) = tok),
  best AS (SELECT id, v FROM val WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, -n, i) = 1)"""


@query("F2", "v_label", _TOKENS.replace("{v}", "v_label") + " SELECT l.id, CAST(v AS DOUBLE) AS ordinal FROM v_label l LEFT JOIN best ON l.id = best.id")
def f02_floor_token_parser(d: DataFrame) -> DataFrame:
    return d.select("id", floors.layer_to_ordinal(F.col("label")).alias("ordinal"))


_STRUCT = "^(.*)_(B[0-9]+|M[0-9]+|F?[0-9]+|R|RF|0)_(Drawing|Fixture|Floor|Space|Opening|Facility|Occupant|detail|level|unit|amenity)$"


@query("F4", "v_layer", f"SELECT id, nullif(regexp_extract(layer, '{_STRUCT}', 1, 'i'), '') AS building, nullif(regexp_extract(layer, '{_STRUCT}', 2, 'i'), '') AS token, nullif(regexp_extract(layer, '{_STRUCT}', 3, 'i'), '') AS category FROM v_layer")
def f04_structured_layer_name(d: DataFrame) -> DataFrame:
    b, t, c = floors.layer_parts(F.col("layer"))
    return d.select("id", b.alias("building"), t.alias("token"), c.alias("category"))


@query("F5", "v_layer", """SELECT id, CASE WHEN contains(lower(layer), '_to_') THEN 'detail' WHEN regexp_matches(lower(layer), '_(floor|level)$') THEN 'level' WHEN regexp_matches(lower(layer), '_(space|unit)$') THEN 'unit'
  WHEN lower(layer) LIKE '%\\_opening' ESCAPE '\\' THEN 'opening' WHEN regexp_matches(lower(layer), '_(drawing|detail|nw)$') THEN 'detail' WHEN regexp_matches(lower(layer), '_fixture$') THEN 'fixture'
  WHEN regexp_matches(lower(layer), '_(facility|amenity)$') THEN 'amenity' END AS target FROM v_layer""")
def f05_target_type_inference(d: DataFrame) -> DataFrame:
    return d.select("id", floors.layer_target(F.col("layer")).alias("target"))


@query("F7 B2 B3 A7", "part", """SELECT p_partkey AS id, nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, '') AS brand, list_filter(string_split(p_type, 'A'), lambda x: x <> '') AS parts,
  CASE WHEN p_partkey % 4 = 0 THEN 0e0 ELSE p_size * -1e0 END AS zeroed FROM part""")
def f07_empty_to_null(d: DataFrame) -> DataFrame:
    brand = text.non_empty(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")))
    zero = text.canonical_zero(F.when(F.col("p_partkey") % 4 == 0, F.lit(-0.0)).otherwise(F.col("p_size") * F.lit(-1.0)))
    return d.select(F.col("p_partkey").alias("id"), brand.alias("brand"), text.non_empty_list(F.split("p_type", "A")).alias("parts"), zero.alias("zeroed"))


_RAW = "CASE id % 4 WHEN 0 THEN upper(substr(h, 1, 12)) || '4' || substr(h, 14, 3) || 'a' || substr(h, 18, 15) WHEN 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-b' || substr(h, 18, 3) || '-' || substr(h, 21, 12) ELSE substr(h, 1, 32) END"


@query("F8 F52", "v_blob", f"""+raw AS (SELECT id, {_RAW} AS u FROM (SELECT id, md5(body) AS h FROM v_blob)), low AS (SELECT id, lower(trim(u)) AS u FROM raw)
  SELECT id, CASE WHEN regexp_full_match(u, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') THEN u
  WHEN regexp_full_match(u, '[0-9a-f]{{12}}4[0-9a-f]{{3}}[89ab][0-9a-f]{{15}}') THEN u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] END AS uuid FROM low""")
def f08_uuid_normalize(d: DataFrame) -> DataFrame:
    raw = d.select("id", F.md5("body").alias("h")).select("id", F.expr(_RAW).alias("u"))
    return raw.select("id", text.uuid4(F.col("u")).alias("uuid"))


@query("F11 C23 E21", "v_label", """+r AS (SELECT id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]', '', 'g'), '([0-9])(floor|fl|f)$', '\\1'), '^(level|lvl|l)([0-9])', '\\2'), '') AS whole,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_split_to_array(trim(label), '\\s+')[1]), '[^a-z0-9]', '', 'g'), '([0-9])(floor|fl|f)$', '\\1'), '^(level|lvl|l)([0-9])', '\\2'), '') AS head FROM v_label)
  SELECT id, whole, coalesce(list_contains(list_filter([whole, head], lambda x: x IS NOT NULL), CAST(id % 50 AS VARCHAR)), false) AS agrees FROM r""")
def f11_label_reduce_and_agree(d: DataFrame) -> DataFrame:
    other = F.array((F.col("id") % 50).cast("string"))
    return d.select("id", floors.reduce_label(F.col("label")).alias("whole"), F.arrays_overlap(floors.label_candidates(F.col("label")), other).alias("agrees"))


@query("F12 F16", "part", """SELECT p_partkey AS id, trim(regexp_replace(lower('  ' || p_name || '   ' || p_type || ' fi1kg カ゚f3 '), '\\s+', ' ', 'g')) AS search_text,
  CASE WHEN p_partkey % 50 = 0 THEN 'venue' ELSE regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || ' cafe zu rich fi'), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', '') END AS slug FROM part""")
def f12_search_text_and_slug(d: DataFrame) -> DataFrame:
    """Ligatures, circled and full-width forms and accents, which normalization takes apart."""
    name = F.when(F.col("p_partkey") % 50 == 0, "日本").otherwise(F.concat_ws(" / ", "p_name", F.concat("p_brand", F.lit(" Café Zürich ﬁ"))))
    return d.select(
        F.col("p_partkey").alias("id"),
        text.search_text(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit("\u3000ﬁ①㎏ ｶﾟＦ３ "))).alias("search_text"),
        text.slug(name).alias("slug"),
    )


@query("F18", "documents", """+b AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN text || chr(7) WHEN 1 THEN E' \\r\\n\\t' || chr(12288) || ' ' WHEN 2 THEN '' WHEN 3 THEN E'a\\r\\n' || text ELSE text END AS t FROM documents),
  c AS (SELECT id, regexp_replace(t, E'\\r\\n?', E'\\n', 'g') AS t FROM b)
  SELECT id, CASE WHEN regexp_matches(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]') THEN 'disallowed control character' WHEN length(t) < 1 OR length(t) > 4000 THEN 'length' WHEN NOT regexp_matches(t, '[^\\s\\x{3000}]') THEN 'whitespace-only' END AS fault FROM c""")
def f18_markdown_faults(d: DataFrame) -> DataFrame:
    """Why a body isn't valid: control characters, its length, white space alone."""
    k = F.col("doc_id") % 6
    t = F.when(k == 0, F.concat("text", F.lit("\x07"))).when(k == 1, " \r\n\t\u3000 ").when(k == 2, "").when(k == 3, F.concat(F.lit("a\r\n"), "text")).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), text.markdown_fault(t).alias("fault"))


_LABELS = """+m AS (SELECT c_custkey AS id, c_custkey % 16 AS k, c_name AS v, CASE c_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'de' WHEN 3 THEN 'FR-ca' ELSE 'EN-gb' END AS locale,
    CASE c_custkey % 3 WHEN 0 THEN 'FR-be' WHEN 1 THEN 'zh' END AS manifest FROM customer),
  e AS (SELECT id, locale, manifest, unnest([{'i': 'ja-JP', 'v': CASE WHEN k & 1 > 0 THEN 'j' || v ELSE '' END}, {'i': 'en-US', 'v': CASE WHEN k & 2 > 0 THEN 'e' || v ELSE '' END}, {'i': 'fr-CA', 'v': CASE WHEN k & 4 > 0 THEN 'f' || v ELSE '' END}, {'i': 'Zh-TW', 'v': CASE WHEN k & 8 > 0 THEN 'z' || v ELSE '' END}]) AS x FROM m),
  c AS (SELECT id, x.i AS i, x.v AS v, CASE WHEN x.i = locale THEN 0 WHEN lower(split_part(x.i, '-', 1)) = lower(locale) THEN 1 WHEN lower(x.i) = lower(manifest) THEN 2 WHEN lower(split_part(x.i, '-', 1)) = lower(split_part(manifest, '-', 1)) THEN 3
    WHEN lower(x.i) = 'ja' THEN 4 WHEN lower(split_part(x.i, '-', 1)) = 'ja' THEN 5 WHEN lower(x.i) = 'en' THEN 6 WHEN lower(split_part(x.i, '-', 1)) = 'en' THEN 7 ELSE 8 END AS place FROM e WHERE x.v <> ''),
  p AS (SELECT id, first(v ORDER BY place, i) AS label, count(*) AS n, count(*) FILTER (WHERE i = 'fr-CA') > 0 AS has_french FROM c GROUP BY 1)
  SELECT m.id, label, coalesce(label, CAST(m.id AS VARCHAR)) AS shown, CAST(coalesce(n, 0) AS INT) AS n, coalesce(has_french, false) AS has_french FROM m LEFT JOIN p ON m.id = p.id"""


@query("F14 F15 F40", "customer", _LABELS)
def f14_localized_pick(d: DataFrame) -> DataFrame:
    """All subsets of four keys, empty values among them, under five locales and three manifest languages."""
    k = F.col("c_custkey")
    value = lambda bit, mark: F.when((k % 16).bitwiseAND(bit) > 0, F.concat(F.lit(mark), "c_name")).otherwise("")
    labels = F.create_map(F.lit("ja-JP"), value(1, "j"), F.lit("en-US"), value(2, "e"), F.lit("fr-CA"), value(4, "f"), F.lit("Zh-TW"), value(8, "z"))
    locale = F.get(F.array(*map(F.lit, ("en", "ja", "de", "FR-ca", "EN-gb"))), (k % 5).cast("int"))
    manifest = F.when(k % 3 == 0, "FR-be").when(k % 3 == 1, "zh")
    d = d.select(k.alias("id"), text.localized(labels, locale, manifest).alias("label"), F.map_filter(labels, lambda _, v: v != "").alias("m"))
    return d.select("id", "label", F.coalesce("label", F.col("id").cast("string")).alias("shown"), F.size("m").alias("n"), text.has_language(F.col("m"), "fr").alias("has_french"))


@query("F17 F19", "documents", """+b AS (SELECT doc_id AS id, E'  \\n![x](attachment:' || CAST(doc_id % 7 AS VARCHAR) || E'-a)\\r\\n' || text AS t FROM documents),
  l AS (SELECT id, t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), E'\\r\\n', E'\\n', 'g'), E'\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM b)
  SELECT id, substr(lines[1], 1, 80) AS summary, length(regexp_replace(t, E'\\r\\n?', E'\\n', 'g')) AS n, list_distinct(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(attachment:([0-9a-z-]+)\\)', 1)) AS ids FROM l""")
def f17_issue_summary(d: DataFrame) -> DataFrame:
    t = F.concat(F.lit("  \n![x](attachment:"), (F.col("doc_id") % 7).cast("string"), F.lit("-a)\r\n"), F.col("text"))
    d = d.select(F.col("doc_id").alias("id"), t.alias("t"))
    return d.select("id", text.summary(F.col("t")).alias("summary"), F.length(text.clean_markdown(F.col("t"))).cast("long").alias("n"), text.attachment_ids(F.col("t")).alias("ids"))


@query("F20", "pages", "SELECT page_id AS id, regexp_replace(parse_filename(url), '(.)[.][^.]*$', '\\1') AS stem FROM pages")
def f20_icon_basename(d: DataFrame) -> DataFrame:
    return d.select(F.col("page_id").alias("id"), text.stem(F.col("url")).alias("stem"))


@query("F23", "v_issue", "SELECT id, sha256('assignee=' || coalesce(CAST(assignee_id AS VARCHAR), 'null') || E'\\n' || 'status=' || status || E'\\n' || 'version=' || CAST(version_id AS VARCHAR)) AS hash FROM v_issue")
def f23_stable_request_hash(d: DataFrame) -> DataFrame:
    return d.select("id", text.request_hash(("version", F.col("version_id")), ("status", F.col("status")), ("assignee", F.col("assignee_id"))).alias("hash"))


_DUE = "CASE WHEN o_orderkey % 9 = 0 THEN '1996-1-5' WHEN o_orderkey % 9 = 1 THEN '1996-02-31' ELSE {day} END"


@query("F24", "orders", f"""+d AS (SELECT o_orderkey AS id, {_DUE.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS due FROM orders),
  e AS (SELECT id, CASE WHEN regexp_full_match(due, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(due AS DATE) END AS day FROM d)
  SELECT id, CASE WHEN day IS NULL THEN 'none' WHEN day < DATE '1996-06-15' THEN 'overdue' WHEN day <= DATE '1996-06-18' THEN 'due_soon' ELSE 'later' END AS state FROM e""")
def f24_due_date_state(d: DataFrame) -> DataFrame:
    due = F.expr(_DUE.format(day="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return d.select(F.col("o_orderkey").alias("id"), text.due_state(due, F.lit("1996-06-15").cast("date")).alias("state"))


@query("F25 F26 F27", "events", """SELECT event_id AS id, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 1e6 AS seconds, ts + INTERVAL 90 DAY > TIMESTAMP '2024-06-01' AS live,
  regexp_full_match(CASE WHEN event_id % 2 = 0 THEN '2024-01-0' || CAST(event_id % 10 AS VARCHAR) || 'T00:00:00Z' ELSE '2024-01-01 00:00:00' END, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?Z') AND event_id % 10 <> 0 AS rfc FROM events""")
def f25_times_and_durations(d: DataFrame) -> DataFrame:
    now = F.lit("2024-06-01 00:00:00").cast(d.schema["ts"].dataType)
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("2024-01-0"), (F.col("event_id") % 10).cast("string"), F.lit("T00:00:00Z"))).otherwise("2024-01-01 00:00:00")
    rfc = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$") & F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return d.select(F.col("event_id").alias("id"), text.seconds_between(F.col("ts"), now).alias("seconds"), (F.col("ts") + F.expr("INTERVAL 90 DAY") > now).alias("live"), rfc.alias("rfc"))


@query("F28", "v_attr", """SELECT from_id, to_id, CASE WHEN start_minute < 0 OR end_minute < 0 THEN true WHEN start_minute <= end_minute THEN 600 >= start_minute AND 600 < end_minute ELSE 600 >= start_minute OR 600 < end_minute END AS open_at_ten FROM v_attr""")
def f28_time_of_day_window(d: DataFrame) -> DataFrame:
    return d.select("from_id", "to_id", text.in_day_window(F.lit(600), F.col("start_minute"), F.col("end_minute")).alias("open_at_ten"))


_HAV = "asin(least(1e0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) * 12742000e0"


@query("F29", "v_node", "SELECT node_id, round(" + _HAV.format(lon1="lon", lat1="lat", lon2="139.7671e0", lat2="35.6812e0") + ", 4) AS metres FROM v_node")
def f29_haversine(d: DataFrame) -> DataFrame:
    return d.select("node_id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(139.7671), F.lit(35.6812)), 4).alias("metres"))


@query("F30", "v_node", """+p AS (SELECT node_id, radians(lon - 139.76e0) * cos(radians(35.68e0)) * 6371000e0 AS x, radians(lat - 35.68e0) * 6371000e0 AS y FROM v_node),
  t AS (SELECT *, greatest(0e0, least(1e0, (x * 300e0 + y * 40e0) / 91600e0)) AS t FROM p) SELECT node_id, round(sqrt(pow(x - t * 300e0, 2) + pow(y - t * 40e0, 2)), 4) AS metres FROM t""")
def f30_point_segment_distance(d: DataFrame) -> DataFrame:
    x, y = geo.plane(F.col("lon"), F.col("lat"), F.lit(139.76), F.lit(35.68))
    return d.select("node_id", F.round(geo.point_segment(x, y, F.lit(0.0), F.lit(0.0), F.lit(300.0), F.lit(40.0)), 4).alias("metres"))


@query("F31", "v_node", """+k AS (SELECT node_id, lon, lat, altitude, (2 - 1 / 298.257223563e0) / 298.257223563e0 AS e2 FROM v_node), n AS (SELECT *, 6378137e0 / sqrt(1 - sin(radians(lat)) * sin(radians(lat)) * e2) AS n FROM k)
  SELECT node_id, round((n + altitude) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round((n + altitude) * cos(radians(lat)) * sin(radians(lon)), 3) AS y, round((n * (1 - e2) + altitude) * sin(radians(lat)), 3) AS z FROM n""")
def f31_geodetic_to_ecef(d: DataFrame) -> DataFrame:
    x, y, z = geo.ecef(F.col("lon"), F.col("lat"), F.col("altitude"))
    return d.select("node_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("F32 F35", "v_node", """+p AS (SELECT node_id, radians(lon - 139.76e0) * cos(radians(35.68e0)) * 6371000e0 AS x, radians(lat - 35.68e0) * 6371000e0 AS y, altitude FROM v_node)
  SELECT node_id, CAST(round(x * 1000) AS BIGINT) AS x_mm, CAST(round(y * 1000) AS BIGINT) AS y_mm, CAST(round(altitude * 1000) AS BIGINT) AS z_mm FROM p""")
def f32_local_millimetres(d: DataFrame) -> DataFrame:
    x, y = geo.plane(F.col("lon"), F.col("lat"), F.lit(139.76), F.lit(35.68))
    return d.select("node_id", geo.to_millimetres(x).alias("x_mm"), geo.to_millimetres(y).alias("y_mm"), geo.to_millimetres(F.col("altitude")).alias("z_mm"))


@query("F33 F34", "v_attr", """SELECT from_id, to_id, CAST(CAST(cost / 7 * 1000 AS FLOAT) AS DOUBLE) AS units, CAST(CASE vertical WHEN 'elevator' THEN 15 + from_id % 5 WHEN 'escalator' THEN 4 * (from_id % 5) WHEN 'stairs' THEN 10 * (from_id % 5) END AS BIGINT) AS vertical_m FROM v_attr""")
def f33_cost_units_and_vertical_cost(d: DataFrame) -> DataFrame:
    return d.select("from_id", "to_id", (F.col("cost") / 7 * 1000).cast("float").cast("double").alias("units"), geo.vertical_cost(F.col("vertical"), F.col("from_id") % 5).alias("vertical_m"))


@query("F39 F50", "v_level", "SELECT level_id, level_id || '|' || CAST(building AS VARCHAR) || '|' || label || '|' || CAST(building * 2 AS VARCHAR) || '|x' AS composite, CASE WHEN ordinal > 0 THEN '↑ F' || CAST(CAST(ordinal AS INT) + 1 AS VARCHAR) WHEN ordinal = 0 THEN '→ F1' ELSE '↓ B' || CAST(-CAST(ordinal AS INT) AS VARCHAR) END AS link FROM v_level")
def f39_composite_ids_and_link_labels(d: DataFrame) -> DataFrame:
    b = F.col("building")
    arrow = F.when(F.col("ordinal") > 0, "↑ ").when(F.col("ordinal") == 0, "→ ").otherwise("↓ ")
    return d.select("level_id", floors.composite_level_id(F.col("level_id"), b.cast("string"), F.col("label"), (b * 2).cast("string"), F.lit("x")).alias("composite"), F.concat(arrow, floors.ordinal_to_label(F.col("ordinal"))).alias("link"))


@query("F41", "part", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS name, p_type AS kind, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS INT) AS n FROM part""")
def f41_map_merge_precedence(d: DataFrame) -> DataFrame:
    base = F.create_map(F.lit("name"), F.col("p_name"), F.lit("kind"), F.lit("?"))
    over = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("name"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    m = text.merge_maps(base, over, F.create_map(F.lit("kind"), F.col("p_type")))
    return d.select(F.col("p_partkey").alias("id"), m.alias("m")).select("id", F.col("m")["name"].alias("name"), F.col("m")["kind"].alias("kind"), F.size("m").alias("n"))


@query("F42 F45", "events", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(CASE WHEN event_id % 2 = 0 THEN '{\"id\":\"f' || CAST(event_id AS VARCHAR) || '\"}' END, '$.id'), 'g' || CAST(event_id AS VARCHAR)) AS ref FROM events")
def f42_json_paths_and_references(d: DataFrame) -> DataFrame:
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"id":"f'), i, F.lit('"}'))).otherwise(F.concat(F.lit("g"), i))
    return d.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"), text.feature_reference(raw).alias("ref"))


@query("F43 F44 D28", "embeddings", """+l AS (SELECT vec_id, embedding[1:6] AS e FROM embeddings), pts AS (SELECT vec_id, [139.76e0 + e[1], 139.76e0 + e[3], 139.76e0 + e[5]] AS x, [35.68e0 + e[2], 35.68e0 + e[4], 35.68e0 + e[6]] AS y FROM l)
  SELECT vec_id, CAST(1 AS INT) AS n_inner, x[2] AS mid_lon, round(""" + _HAV.format(lon1="x[1]", lat1="y[1]", lon2="x[2]", lat2="y[2]") + " + " + _HAV.format(lon1="x[2]", lat1="y[2]", lon2="x[3]", lat2="y[3]") + ", 3) AS metres FROM pts")
def f43_edge_polylines(d: DataFrame) -> DataFrame:
    e = F.col("embedding")
    point = lambda i: F.struct((F.lit(139.76) + e[i].cast("double")).alias("x"), (F.lit(35.68) + e[i + 1].cast("double")).alias("y"))
    d = d.select("vec_id", F.concat(F.array(point(0)), F.array(point(2)), F.array(point(4))).alias("line"))
    inner = geo.inner_points(F.col("line"))
    return d.select("vec_id", F.size(inner).alias("n_inner"), inner[0]["x"].alias("mid_lon"), F.round(geo.polyline_length(F.col("line")), 3).alias("metres"))


@query("F46", "v_unit", "SELECT unit_id, unit_id % 4 = 0 OR unit_id % 4 = 1 OR (unit_id % 4 = 2 AND category IS NOT NULL AND contains(category, 'lobby')) AS wheelchair FROM v_unit")
def f46_accessibility_flags(d: DataFrame) -> DataFrame:
    k = F.col("unit_id") % 4
    words = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("Wheelchair.ramp"))).when((k == 2) & F.coalesce(F.col("category").contains("lobby"), F.lit(False)), F.array(F.lit("stairs"), F.lit("WHEELCHAIR"))).otherwise(F.array(F.lit("stairs")))
    return d.select("unit_id", text.accessible(words).alias("wheelchair"))


@query("F49", "v_unit", "SELECT unit_id, CAST((unit_id * 977) // 65536 % 256 AS INT) AS r, CAST((unit_id * 977) // 256 % 256 AS INT) AS g, CAST((unit_id * 977) % 256 AS INT) AS b, CAST(unit_id * 977 % 16777216 AS BIGINT) AS back FROM v_unit")
def f49_packed_rgb(d: DataFrame) -> DataFrame:
    d = d.select("unit_id", text.pack_rgb(F.col("unit_id") * 977).alias("c"))
    return d.select("unit_id", F.col("c.r").cast("int").alias("r"), F.col("c.g").cast("int").alias("g"), F.col("c.b").cast("int").alias("b"), text.unpack_rgb(F.col("c")).cast("long").alias("back"))


@query("F51 B14", "customer", "SELECT c_custkey AS id, c_acctbal / 40 BETWEEN -180 AND 180 AND c_acctbal / 80 BETWEEN -90 AND 90 AS valid, c_custkey % 5 <> 0 AS finite FROM customer")
def f51_coordinate_validation(d: DataFrame) -> DataFrame:
    x = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    return d.select(F.col("c_custkey").alias("id"), geo.in_bounds(F.col("c_acctbal") / 40, F.col("c_acctbal") / 80).alias("valid"), text.is_finite(x, F.lit(1.0)).alias("finite"))


@query("A6 B4", "part", "SELECT p_partkey AS id, p_partkey % 3 <> 2 AS supported, CASE WHEN p_partkey % 4 = 1 THEN 0e0 ELSE p_size / 2e0 END AS ordinal FROM part")
def a06_manifest_and_ordinals(d: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, "1.0.0").when(k % 3 == 1, "1.0.0-beta.2").otherwise("1.1.0")
    raw = F.when(k % 4 == 1, F.when(k % 8 == 1, "NaN").otherwise("x")).otherwise((F.col("p_size") / 2).cast("string"))
    return d.select(k.alias("id"), text.manifest_supported(version).alias("supported"), text.finite_or(raw, 0.0).alias("ordinal"))


@query("A22", "v_blob", """+h AS (SELECT id, byte_size AS size, CASE id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'bytes=0-99' WHEN 2 THEN 'Bytes= -50 ' WHEN 3 THEN 'bytes=-0' WHEN 4 THEN 'bytes=100-' WHEN 5 THEN 'bytes=9-3' WHEN 6 THEN 'bytes=0-1,4-5' WHEN 7 THEN 'bytes=99999999-' WHEN 8 THEN 'items=1-2'
    WHEN 9 THEN 'bytes=-99999999999999999999' WHEN 10 THEN 'bytes=99999999999999999999-' ELSE 'bytes=5-99999999999999999999' END AS header FROM v_blob)
  SELECT id, CASE WHEN id % 12 IN (1, 4) AND size > CASE id % 12 WHEN 1 THEN 0 ELSE 100 END THEN 'range' WHEN id % 12 = 2 AND size > 0 THEN 'range' WHEN id % 12 IN (1, 2, 3, 4, 7, 9) THEN CASE WHEN id % 12 = 7 AND size > 99999999 THEN 'range' ELSE 'unsatisfiable' END
      WHEN id % 12 = 5 AND size <= 9 OR id % 12 = 11 AND size <= 5 THEN 'unsatisfiable' ELSE 'whole' END AS kind,
    CASE WHEN id % 12 = 1 AND size > 0 THEN 0 WHEN id % 12 = 4 AND size > 100 THEN 100 WHEN id % 12 = 2 AND size > 0 THEN greatest(0, size - 50) WHEN id % 12 = 7 AND size > 99999999 THEN 99999999 END AS first_byte,
    CASE WHEN id % 12 = 1 AND size > 0 THEN least(99, size - 1) WHEN id % 12 = 4 AND size > 100 THEN size - 1 WHEN id % 12 = 2 AND size > 0 THEN size - 1 WHEN id % 12 = 7 AND size > 99999999 THEN size - 1 END AS last_byte FROM h""")
def a22_byte_range(d: DataFrame) -> DataFrame:
    """Headers of all kinds; a number beyond the largest safe one is refused at the end of a suffix and ignored elsewhere, once the range begins within the bytes."""
    k, huge = F.col("id") % 12, "99999999999999999999"
    header = F.when(k == 1, "bytes=0-99").when(k == 2, "Bytes= -50 ").when(k == 3, "bytes=-0").when(k == 4, "bytes=100-").when(k == 5, "bytes=9-3").when(k == 6, "bytes=0-1,4-5").when(k == 7, "bytes=99999999-").when(k == 8, "items=1-2")
    header = header.when(k == 9, f"bytes=-{huge}").when(k == 10, f"bytes={huge}-").when(k == 11, f"bytes=5-{huge}")
    d = d.select("id", text.byte_range(header, F.col("byte_size")).alias("r"))
    return d.select("id", F.col("r.kind").alias("kind"), F.col("r.first").alias("first_byte"), F.col("r.last").alias("last_byte"))


@query("B5 B6 B7 F47", "v_attr", """SELECT from_id, to_id, coalesce(vertical NOT IN ('stairs', 'escalator'), true) AND (clearance_m IS NULL OR clearance_m >= 0.8e0) AND NOT barrier AND wheelchair AND NOT (from_id % 4 = 0 AND accessible_only)
    AND CASE WHEN start_minute < 0 OR end_minute < 0 THEN true WHEN start_minute <= end_minute THEN 480 >= start_minute AND 480 < end_minute ELSE 480 >= start_minute OR 480 < end_minute END AS wheelchair_ok,
    NOT accessible_only AND NOT barrier AS walking_ok, direction IN (0, 1) AS forward, direction IN (0, 2) AS backward FROM v_attr""")
def b05_edge_admissibility(d: DataFrame) -> DataFrame:
    from floorspan.operators.graph import WALKING, WHEELCHAIR, backward, edge_allowed, forward

    chair = edge_allowed(WHEELCHAIR, minute=480) & ~((F.col("from_id") % 4 == 0) & F.col("accessible_only"))
    return d.select("from_id", "to_id", chair.alias("wheelchair_ok"), edge_allowed(WALKING).alias("walking_ok"), forward().alias("forward"), backward().alias("backward"))


@query("B8", "v_unit", "SELECT unit_id, coalesce(category IN ('walkway', 'ramp', 'platform', 'lobby', 'footbridge'), false) AS walkway, coalesce(category IN ('elevator', 'escalator', 'stairs'), false) AS transit FROM v_unit")
def b08_walkway_and_transit(d: DataFrame) -> DataFrame:
    return d.select("unit_id", text.is_walkway(F.col("category")).alias("walkway"), text.is_transit(F.col("category")).alias("transit"))


@query("B10", "v_entry", "SELECT feature_type, count(*) AS n, min(CASE feature_type WHEN 'amenity' THEN 1 WHEN 'kiosk' THEN 8 WHEN 'level' THEN 9 WHEN 'occupant' THEN 10 ELSE 11 END) AS type_rank FROM v_entry WHERE feature_type IN ('amenity', 'occupant', 'kiosk', 'opening') GROUP BY 1")
def b10_indexed_types(d: DataFrame) -> DataFrame:
    kept = d.filter(F.col("feature_type").isin("amenity", "occupant", "kiosk", "opening"))
    return kept.groupBy("feature_type").agg(F.count("*").alias("n"), F.min(text.type_rank(F.col("feature_type"))).alias("type_rank"))

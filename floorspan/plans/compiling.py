"""Queries over compiled scenes: walls, openings, panels and meshes (inventory group G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions.lookups import role_of_category
from floorspan.operators import scene, walls
from floorspan.plans.registry import query
from floorspan.session import cut

_HOSTS = f"""+w AS (SELECT level_id, ax, ay, cx, cy, min(coalesce(height, {walls.WALL_MM})) AS height, bool_and(platform) AS platform FROM v_side GROUP BY level_id, ax, ay, cx, cy),
  m AS (SELECT *, CAST(cx - ax AS HUGEINT) AS dx, CAST(cy - ay AS HUGEINT) AS dy FROM v_door JOIN w USING (level_id)),
  l AS (SELECT *, dx * dx + dy * dy AS len2, (px - ax) * dx + (py - ay) * dy AS pt, (qx - ax) * dx + (qy - ay) * dy AS qt, (px - ax) * dy - (py - ay) * dx AS pc, (qx - ax) * dy - (qy - ay) * dx AS qc FROM m),
  e AS (SELECT *, CASE WHEN pt <= 0 THEN ((px - ax) * (px - ax) + (py - ay) * (py - ay)) * len2 WHEN pt >= len2 THEN ((px - cx) * (px - cx) + (py - cy) * (py - cy)) * len2 ELSE pc * pc END AS po,
    CASE WHEN qt <= 0 THEN ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) * len2 WHEN qt >= len2 THEN ((qx - cx) * (qx - cx) + (qy - cy) * (qy - cy)) * len2 ELSE qc * qc END AS qo, greatest(0, least(len2, pt)) AS pa, greatest(0, least(len2, qt)) AS qa, {walls.TOLERANCE_MM**2} * len2 AS most FROM l),
  c AS (SELECT *, least(pa, qa) AS s, greatest(pa, qa) AS t, po + qo AS score FROM e WHERE pc * pc <= most AND qc * qc <= most AND pa <> qa),
  h AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.opening_id = c.opening_id AND (b.score * c.len2 < c.score * b.len2 OR (b.score * c.len2 = c.score * b.len2 AND (b.ax, b.ay, b.cx, b.cy) < (c.ax, c.ay, c.cx, c.cy))))),
  p AS (SELECT opening_id, ax AS hax, ay AS hay, cx AS hcx, cy AS hcy, s AS hs, t AS ht, len2 AS hl FROM h),
  k AS (SELECT c.*, hax, hay, hcx, hcy, hs, ht, hl FROM c JOIN p USING (opening_id) WHERE (po <= most AND qo <= most) OR (ax = hax AND ay = hay AND cx = hcx AND cy = hcy)
    OR ((ax - hax) * (hcy - hay) = (ay - hay) * (hcx - hax) AND (cx - hax) * (hcy - hay) = (cy - hay) * (hcx - hax))),
  f AS (SELECT opening_id, level_id, hax AS ax, hay AS ay, hcx AS cx, hcy AS cy, least({walls.DOOR_MM}, min(height)) AS height, hax + sign(hcx - hax) * ((abs(hcx - hax) * hs + hl // 2) // hl) AS x1, hay + sign(hcy - hay) * ((abs(hcy - hay) * hs + hl // 2) // hl) AS y1,
    hax + sign(hcx - hax) * ((abs(hcx - hax) * ht + hl // 2) // hl) AS x2, hay + sign(hcy - hay) * ((abs(hcy - hay) * ht + hl // 2) // hl) AS y2, count(*) AS n_walls FROM k GROUP BY opening_id, level_id, hax, hay, hcx, hcy, hs, ht, hl),
  g AS (SELECT * FROM f WHERE height > 0 AND (x1 <> x2 OR y1 <> y2))"""

_PANELS = (
    _HOSTS
    + """, cut AS (SELECT k.level_id, k.ax, k.ay, k.cx, k.cy, s, t, least(g.height, k.height) AS high FROM k JOIN g USING (opening_id)),
  live AS (SELECT *, CAST((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) AS HUGEINT) AS len2 FROM w WHERE NOT platform AND height > 0),
  mark AS (SELECT level_id, ax, ay, cx, cy, CAST(0 AS HUGEINT) AS m FROM live UNION SELECT level_id, ax, ay, cx, cy, len2 FROM live UNION SELECT cut.level_id, cut.ax, cut.ay, cut.cx, cut.cy, s FROM cut JOIN live USING (level_id, ax, ay, cx, cy) UNION SELECT cut.level_id, cut.ax, cut.ay, cut.cx, cut.cy, t FROM cut JOIN live USING (level_id, ax, ay, cx, cy)),
  span AS (SELECT *, lead(m) OVER (PARTITION BY level_id, ax, ay, cx, cy ORDER BY m) AS e FROM mark),
  void AS (SELECT span.*, coalesce((SELECT max(high) FROM cut WHERE cut.level_id = span.level_id AND cut.ax = span.ax AND cut.ay = span.ay AND cut.cx = span.cx AND cut.cy = span.cy AND s < e AND t > m), 0) AS void FROM span WHERE e IS NOT NULL),
  step AS (SELECT *, CASE WHEN lag(void) OVER (PARTITION BY level_id, ax, ay, cx, cy ORDER BY m) = void THEN 0 ELSE 1 END AS new FROM void),
  part AS (SELECT *, sum(new) OVER (PARTITION BY level_id, ax, ay, cx, cy ORDER BY m) AS part FROM step),
  whole AS (SELECT level_id, ax, ay, cx, cy, part, min(m) AS s, max(e) AS t, first(void) AS void FROM part GROUP BY level_id, ax, ay, cx, cy, part),
  pan AS (SELECT whole.level_id, ax, ay, cx, cy, part, ax + sign(cx - ax) * ((abs(cx - ax) * s + len2 // 2) // len2) AS x1, ay + sign(cy - ay) * ((abs(cy - ay) * s + len2 // 2) // len2) AS y1, ax + sign(cx - ax) * ((abs(cx - ax) * t + len2 // 2) // len2) AS x2, ay + sign(cy - ay) * ((abs(cy - ay) * t + len2 // 2) // len2) AS y2,
    CAST(ordinal * 4000 AS BIGINT) + void AS bottom, CAST(ordinal * 4000 AS BIGINT) + height AS top FROM whole JOIN live USING (level_id, ax, ay, cx, cy) JOIN v_level USING (level_id))"""
)


def _ring(room: DataFrame) -> DataFrame:
    """Units as rings; some have a vertex in the middle of a side."""
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    corners = F.array(point(0, 0), point(4000, 0), point(4000, 3000), point(0, 3000))
    return room.withColumn("ring", F.when(F.col("split"), F.array_insert(corners, 2, point(2000, 0))).otherwise(corners))


def _hosted(room: DataFrame, door: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    of_units = walls.sides(_ring(room))
    edges = cut(walls.walls(of_units))
    hosted, cuts = walls.host(door, edges)
    return of_units, edges, hosted, cuts


@query("G25", "v_room v_side v_door", _HOSTS + " SELECT opening_id, level_id, ax, ay, cx, cy, CAST(height AS BIGINT) AS height, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2, n_walls FROM g")
def g25_hosted_openings(room: DataFrame, side: DataFrame, door: DataFrame) -> DataFrame:
    """Each opening with the wall that hosts it, snapped to it, as high as the lowest wall that it cuts."""
    return _hosted(room, door)[2]


@query("G25", "v_room v_side v_door", _HOSTS + """, z AS (SELECT DISTINCT k.opening_id, v.unit_id FROM k JOIN g USING (opening_id) JOIN v_side v ON v.level_id = k.level_id AND v.ax = k.ax AND v.ay = k.ay AND v.cx = k.cx AND v.cy = k.cy)
  SELECT opening_id, list_sort(list(unit_id))[1] AS from_unit, list_sort(list(unit_id))[2] AS to_unit FROM z GROUP BY 1""")
def g25_portals(room: DataFrame, side: DataFrame, door: DataFrame) -> DataFrame:
    """The two units that each opening connects; one at the outside has no second."""
    of_units, _, _, cuts = _hosted(room, door)
    return walls.connected_units(cuts, of_units)


@query("G25", "v_room v_side v_door v_level", _PANELS + """ SELECT level_id, ax, ay, cx, cy, CAST(part AS BIGINT) AS part, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2, CAST(bottom AS BIGINT) AS bottom, CAST(top AS BIGINT) AS top
  FROM pan WHERE (x1 <> x2 OR y1 <> y2) AND bottom < top""")
def g25_wall_panels(room: DataFrame, side: DataFrame, door: DataFrame, level: DataFrame) -> DataFrame:
    """The walls of all units as panels, full ones and headers over their openings."""
    _, edges, _, cuts = _hosted(room, door)
    return walls.panels(edges, cuts, level.select("level_id", (F.col("ordinal") * 4000).cast("long").alias("z")))


_INDEXED = """+c AS (SELECT level_key, CASE category WHEN 'Floors' THEN 'walkable' ELSE 'structure' END AS role, object_id * 2 + CASE WHEN y2 <> y1 THEN 1 ELSE 0 END AS tri, {'x': x1, 'y': y1, 'z': z1} AS a, {'x': x2, 'y': y2, 'z': z2} AS b, {'x': x3, 'y': y3, 'z': z3} AS c FROM v_tri),
  v AS (SELECT DISTINCT level_key, role, unnest([a, b, c]) AS v FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY level_key, role ORDER BY v.x, v.y, v.z) - 1 AS place FROM v),
  t AS (SELECT c.level_key, c.role, c.tri, i.place AS i, j.place AS j, k.place AS k FROM c JOIN n i ON c.level_key = i.level_key AND c.role = i.role AND c.a = i.v JOIN n j ON c.level_key = j.level_key AND c.role = j.role AND c.b = j.v JOIN n k ON c.level_key = k.level_key AND c.role = k.role AND c.c = k.v)"""


def _indexed(tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    point = lambda i: F.struct(*[F.col(f"{k}{i}").alias(k) for k in "xyz"])
    key = F.col("object_id") * 2 + F.when(F.col("y2") != F.col("y1"), 1).otherwise(0)
    d = tri.select("level_key", role_of_category(F.col("category")).alias("role"), key.alias("tri"), point(1).alias("a"), point(2).alias("b"), point(3).alias("c"))
    return scene.indexed(d, ["level_key", "role"], "tri")


@query("G26", "v_tri", _INDEXED + " SELECT level_key, role, CAST(0 AS BIGINT) AS part, tri, i, j, k, 0e0 AS nx, 0e0 AS ny, 1e0 AS nz FROM t")
def g26_index_buffers(tri: DataFrame) -> DataFrame:
    """Triangles of each level and role as indices of its vertices, with facet normals."""
    _, triangles = _indexed(tri)
    return triangles.select("level_key", "role", "part", "tri", "i", "j", "k", *[F.col(f"normal.{c}").alias(f"n{c}") for c in "xyz"])


@query("G26", "v_tri", _INDEXED + " SELECT level_key, role, CAST(0 AS BIGINT) AS part, place, v.x AS x, v.y AS y, v.z AS z FROM n")
def g26_vertex_buffers(tri: DataFrame) -> DataFrame:
    """The vertices of each level and role, numbered in order."""
    return _indexed(tri)[0]

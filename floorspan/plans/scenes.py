"""Queries over registration: tile levels, their floors, residuals and activation gates (inventory groups C and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.operators import registration as reg
from floorspan.operators.nearest import nearest_segment
from floorspan.plans.registry import query
from floorspan.session import cut

BANDS = reg.Bands(floor_p90_max_m={"L3": 0.01})

_LEVELS = """+t AS (SELECT *, 'v1|' || document || '|' || link || '|' || level_key || '|' || CAST(CAST(round(elevation * 10) AS INT) AS VARCHAR) AS tile_level, abs((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) / 2 AS area FROM v_tri),
  bins AS (SELECT tile_level, CAST(round((z1 + z2 + z3) / 3 / 0.01e0) AS BIGINT) AS bin, round(sum(area), 6) AS area, count(*) AS n FROM t WHERE category = 'Floors' AND area > 0 GROUP BY 1, 2),
  pl AS (SELECT * FROM (SELECT tile_level, bin, sum(n) OVER (PARTITION BY tile_level) AS total, row_number() OVER (PARTITION BY tile_level ORDER BY area DESC, bin) AS k FROM bins) WHERE k = 1),
  lp AS (SELECT l.*, bin * 0.01e0 AS plane, CAST(coalesce(total, 0) AS BIGINT) AS n_triangles FROM (SELECT tile_level, min(level_key) AS level_key, min(level_name) AS level_name, min(elevation) AS elevation FROM t GROUP BY 1) l LEFT JOIN pl ON l.tile_level = pl.tile_level)"""

_MATCHED = (
    _LEVELS
    + """, near AS (SELECT tile_level, level_id, floor_plane, count(*) OVER (PARTITION BY tile_level) AS n_near, row_number() OVER (PARTITION BY tile_level ORDER BY abs(floor_plane - plane), level_id) AS k FROM lp, v_floor WHERE abs(floor_plane - plane) <= 1.5),
  nm AS (SELECT tile_level, list(DISTINCT level_id) AS named FROM lp JOIN v_floor ON label = level_key OR label = level_name GROUP BY 1),
  best AS (SELECT lp.tile_level, level_id, floor_plane, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN level_id IS NULL THEN 'unknown' WHEN list_contains(named, level_id) THEN 'agrees' WHEN len(named) = 1 THEN 'contradicts' ELSE 'unknown' END AS agreement
    FROM lp LEFT JOIN (SELECT * FROM near WHERE k = 1) n ON lp.tile_level = n.tile_level LEFT JOIN nm ON lp.tile_level = nm.tile_level)"""
)

_MEASURED = (
    _MATCHED
    + """, c AS (SELECT tile_level, CAST(round(x1 * 1000) AS BIGINT) AS x1, CAST(round(y1 * 1000) AS BIGINT) AS y1, CAST(round(x2 * 1000) AS BIGINT) AS x2, CAST(round(y2 * 1000) AS BIGINT) AS y2, CAST(round(x3 * 1000) AS BIGINT) AS x3, CAST(round(y3 * 1000) AS BIGINT) AS y3 FROM t WHERE category = 'Floors'),
  s AS (SELECT tile_level, x1, y1, x2, y2 FROM c UNION ALL SELECT tile_level, x2, y2, x3, y3 FROM c UNION ALL SELECT tile_level, x3, y3, x1, y1 FROM c),
  u AS (SELECT tile_level, CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN [x1, y1, x2, y2] ELSE [x2, y2, x1, y1] END AS q FROM s WHERE x1 <> x2 OR y1 <> y2),
  o AS (SELECT tile_level, q[1] / 1000e0 AS x1, q[2] / 1000e0 AS y1, q[3] / 1000e0 AS x2, q[4] / 1000e0 AS y2 FROM u GROUP BY ALL HAVING count(*) = 1),
  i AS (SELECT *, greatest(1, CAST(floor(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.5e0) AS BIGINT)) AS n FROM o),
  j AS (SELECT *, unnest(range(0, n)) AS i FROM i),
  pts AS (SELECT level_id, j.tile_level, x1 + (x2 - x1) * ((i + 0.5e0) / n) AS x, y1 + (y2 - y1) * ((i + 0.5e0) / n) AS y FROM j JOIN best ON j.tile_level = best.tile_level WHERE level_id IS NOT NULL),
  w AS (SELECT p.*, v.x1, v.y1, v.x2, v.y2, v.x2 - v.x1 AS ex, v.y2 - v.y1 AS ey FROM pts p JOIN v_outline v ON p.level_id = v.level_id),
  f AS (SELECT *, CASE WHEN ex * ex + ey * ey > 0 THEN greatest(0e0, least(1e0, ((x - x1) * ex + (y - y1) * ey) / (ex * ex + ey * ey))) ELSE 0e0 END AS t FROM w),
  g AS (SELECT *, x1 + ex * t AS near_x, y1 + ey * t AS near_y FROM f),
  h AS (SELECT *, sqrt((x - near_x) * (x - near_x) + (y - near_y) * (y - near_y)) AS distance FROM g),
  z AS (SELECT level_id, tile_level, x, y, near_x, near_y, distance, row_number() OVER (PARTITION BY tile_level, x, y ORDER BY distance, x1, y1, x2, y2) AS k,
    sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) OVER (PARTITION BY tile_level, x, y) % 2 = 1 AS inside FROM h),
  m AS (SELECT p.level_id, p.tile_level, p.x, p.y, near_x, near_y, distance, z.tile_level IS NULL OR (distance > 1.0 AND NOT inside) AS carved, p.x - near_x AS dx, p.y - near_y AS dy FROM pts p LEFT JOIN (SELECT * FROM z WHERE k = 1) z ON p.tile_level = z.tile_level AND p.x = z.x AND p.y = z.y),
  rep AS (SELECT level_id, count(*) AS sampled, CAST(count(*) FILTER (WHERE carved) AS BIGINT) AS carved_out, quantile_disc(distance, 0.5) FILTER (WHERE NOT carved) AS p50, quantile_disc(distance, 0.9) FILTER (WHERE NOT carved) AS p90, max(distance) FILTER (WHERE NOT carved) AS worst,
    coalesce(median(dx) FILTER (WHERE NOT carved), 0) AS shift_x, coalesce(median(dy) FILTER (WHERE NOT carved), 0) AS shift_y FROM m GROUP BY 1)"""
)


def _matched(tri: DataFrame, floor: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    tri = reg.with_level(tri, "v1")
    levels = cut(reg.tile_levels(tri))
    labels = levels.select("tile_level", F.explode(F.array("level_key", "level_name")).alias("label"))
    return tri, levels, cut(reg.match_floors(levels, floor.select("level_id", "floor_plane"), labels, floor.select("level_id", "label"), BANDS))


def _samples(tri: DataFrame, matched: DataFrame) -> DataFrame:
    sides = reg.boundary(tri.join(matched.filter("level_id is not null").select("tile_level", "level_id"), "tile_level"), "tile_level", "level_id")
    return reg.samples(sides, BANDS.spacing_m).select("level_id", "tile_level", F.struct("tile_level", "x", "y").alias("sample_id"), "x", "y")


@query("G27", "v_tri", _LEVELS + " SELECT tile_level, level_key, elevation, round(plane, 6) AS plane, round(elevation - plane, 6) AS difference, n_triangles FROM lp")
def g27_tile_level_planes(tri: DataFrame) -> DataFrame:
    """Tile levels with the plane of most walkable area."""
    d = reg.tile_levels(reg.with_level(tri, "v1"))
    return d.select("tile_level", "level_key", "elevation", F.round("plane", 6).alias("plane"), F.round("difference", 6).alias("difference"), "n_triangles")


@query("C22 C23", "v_tri v_floor", _MATCHED + " SELECT tile_level, level_id, n_near, agreement FROM best")
def c22_floor_of_tile_level(tri: DataFrame, floor: DataFrame) -> DataFrame:
    """The floor of each tile level by height, and whether its label agrees."""
    return _matched(tri, floor)[2].select("tile_level", "level_id", "n_near", "agreement")


@query("C18", "v_tri v_floor v_outline", _MEASURED + " SELECT tile_level, round(x, 6) AS x, round(y, 6) AS y, round(near_x, 6) AS near_x, round(near_y, 6) AS near_y, round(distance, 6) AS distance FROM m WHERE distance IS NOT NULL")
def c18_nearest_segment(tri: DataFrame, floor: DataFrame, outline: DataFrame) -> DataFrame:
    """Each boundary sample's closest point on the outlines of its floor."""
    tri, _, matched = _matched(tri, floor)
    found = nearest_segment(_samples(tri, matched), outline, "level_id", "sample_id", 4.0)
    return found.select("tile_level", *[F.round(c, 6).alias(c) for c in ("x", "y", "near_x", "near_y", "distance")])


@query("G28", "v_tri v_floor v_outline", _MEASURED + " SELECT level_id, sampled, carved_out, round(p50, 6) AS p50, round(p90, 6) AS p90, round(worst, 6) AS worst, round(shift_x, 6) AS shift_x, round(shift_y, 6) AS shift_y FROM rep")
def g28_registration_report(tri: DataFrame, floor: DataFrame, outline: DataFrame) -> DataFrame:
    """Residuals of each floor: samples, coverage differences, nearest-rank percentiles and the median shift."""
    tri, _, matched = _matched(tri, floor)
    d = reg.floor_report(reg.residuals(_samples(tri, matched), outline, BANDS))
    return d.select("level_id", "sampled", "carved_out", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "worst", "shift_x", "shift_y")])


_GATES = (
    _MEASURED
    + """, ob AS (SELECT tile_level, object_id, min(level_key) AS level_key, max(category) = 'Walls' AS opaque, object_id % 2 = 0 AS context FROM t GROUP BY tile_level, object_id),
  shown AS (SELECT lp.*, level_id, floor_plane, n_near, agreement FROM lp JOIN best ON lp.tile_level = best.tile_level WHERE lp.tile_level IN (SELECT tile_level FROM ob WHERE level_key <> '' AND NOT context)),
  placed AS (SELECT lp.tile_level, plane, level_id, floor_plane, lag(floor_plane) OVER (ORDER BY plane, lp.tile_level) AS below FROM lp JOIN best ON lp.tile_level = best.tile_level WHERE plane IS NOT NULL AND floor_plane IS NOT NULL),
  cl AS (SELECT level_id, floor(x / 40e0) AS cx, floor(y / 40e0) AS cy, count(*) AS n, median(dx) AS mx, median(dy) AS my FROM m WHERE NOT carved AND distance > CASE WHEN level_id = 'L3' THEN 0.01 ELSE 0.5 END GROUP BY 1, 2, 3)
  SELECT 'capabilityProfileMissing' AS gate, 'v1' AS subject, CAST(NULL AS DOUBLE) AS measured, CAST(NULL AS DOUBLE) AS band
  UNION ALL SELECT 'unclassifiedOpaqueContent', CAST(object_id AS VARCHAR), NULL, NULL FROM ob WHERE level_key = '' AND opaque AND NOT context
  UNION ALL SELECT 'levelPlaneUnresolved', tile_level, NULL, NULL FROM shown WHERE plane IS NULL
  UNION ALL SELECT 'levelNotMapped', tile_level, NULL, NULL FROM shown WHERE plane IS NOT NULL AND level_id IS NULL
  UNION ALL SELECT 'levelLabelContradiction', tile_level, NULL, NULL FROM shown WHERE plane IS NOT NULL AND agreement = 'contradicts'
  UNION ALL SELECT 'levelMappingAmbiguous', tile_level, NULL, 1.5 FROM best WHERE n_near > 1
  UNION ALL SELECT 'levelMappingScrambled', tile_level, round(floor_plane, 6), round(below, 6) FROM placed WHERE floor_plane < below
  UNION ALL SELECT 'levelMappingCollapsed', level_id, round(max(plane) - min(plane), 6), 1.5 FROM placed GROUP BY level_id HAVING max(plane) - min(plane) > 1.5
  UNION ALL SELECT 'registrationOutOfBand', level_id, round(p90, 6), CASE WHEN level_id = 'L3' THEN 0.01 ELSE 0.5 END FROM rep WHERE p90 > CASE WHEN level_id = 'L3' THEN 0.01 ELSE 0.5 END
  UNION ALL SELECT 'coherentShiftOutOfBand', level_id, round(sqrt(shift_x * shift_x + shift_y * shift_y), 6), 0.15 FROM rep WHERE sqrt(shift_x * shift_x + shift_y * shift_y) > 0.15
  UNION ALL SELECT 'coherentResidual', level_id || ' @ ' || CAST(CAST((cx + 0.5) * 40 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST((cy + 0.5) * 40 AS BIGINT) AS VARCHAR), round(sqrt(mx * mx + my * my), 6), 1.0 FROM cl WHERE n >= 5 AND sqrt(mx * mx + my * my) > 1.0"""
)


@query("G29", "v_tri v_floor v_outline", _GATES)
def g29_gates_of_an_activation(tri: DataFrame, floor: DataFrame, outline: DataFrame) -> DataFrame:
    """All twelve gates over a package that was measured against the venue."""
    tri, levels, matched = _matched(tri, floor)
    measured = cut(reg.residuals(_samples(tri, matched), outline, BANDS))
    context = tri.filter("object_id % 2 = 0").select("object_id").distinct()
    found = reg.gates("v1", True, None, tri, levels, matched, reg.floor_report(measured), reg.coherent(measured, BANDS), context, BANDS)
    return found.select("gate", "subject", F.round("measured", 6).alias("measured"), F.round("band", 6).alias("band"))

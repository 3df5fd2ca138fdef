"""Queries over references between features (inventory group C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.operators import references
from floorspan.plans.registry import query

_FEATURES = """+f AS (SELECT p_partkey AS place, 'f' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'L' || CAST(p_partkey % 25 AS VARCHAR) END AS level_id, CASE WHEN p_partkey % 39 = 0 THEN 'x' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 0 THEN 'f' || CAST(p_partkey // 2 AS VARCHAR) END AS unit_id,
    CASE WHEN p_partkey % 26 = 0 THEN 'y' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 2 = 0 THEN 'f' || CAST(p_partkey // 4 AS VARCHAR) END AS anchor_id, CASE WHEN p_partkey % 4 = 1 THEN ['z' || CAST(p_partkey AS VARCHAR), 'f' || CAST(p_partkey // 3 AS VARCHAR), 'z', 'f' || CAST(p_partkey - 1 AS VARCHAR)] ELSE [] END AS unit_ids,
    CASE WHEN p_partkey % 10 = 0 THEN p_retailprice END AS display_point, CASE WHEN p_partkey % 6 <> 1 AND p_partkey % 7 <> 2 THEN CAST(p_size AS DOUBLE) END AS center FROM part),
  j AS (SELECT f.*, u.id IS NOT NULL AS has_u, u.level_id AS u_level, u.center AS u_center, a.id IS NOT NULL AS has_a, a.unit_id AS a_unit, a.center AS a_center, v.id IS NOT NULL AS has_v, v.level_id AS v_level FROM f LEFT JOIN f u ON f.unit_id = u.id LEFT JOIN f a ON f.anchor_id = a.id LEFT JOIN f v ON a.unit_id = v.id),
  x AS (SELECT f.place, f.id, t.nr, f.unit_ids[t.nr] AS candidate, u.id IS NOT NULL AS found, u.level_id, u.center FROM f, unnest(range(1, len(f.unit_ids) + 1)) AS t(nr) LEFT JOIN f u ON f.unit_ids[t.nr] = u.id),
  s AS (SELECT *, coalesce(level_id, u_level) AS one, coalesce(level_id, u_level, CASE WHEN anchor_id IS NOT NULL THEN v_level END) AS two, (SELECT min(nr) FROM x WHERE x.place = j.place AND x.level_id IS NOT NULL) AS stop FROM j)"""


def _features(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda mark, n: F.concat(F.lit(mark), n.cast("long").cast("string"))
    half = lambda n: F.floor(k / n)
    listed = F.when(k % 4 == 1, F.array(name("z", k), name("f", half(3)), F.lit("z"), name("f", k - 1))).otherwise(F.array().cast("array<string>"))
    return part.select(
        k.alias("place"), name("f", k).alias("id"), F.when(k % 5 == 0, name("L", k % 25)).alias("level_id"), F.when(k % 39 == 0, name("x", k)).when(k % 3 == 0, name("f", half(2))).alias("unit_id"),
        F.when(k % 26 == 0, name("y", k)).when(k % 2 == 0, name("f", half(4))).alias("anchor_id"), listed.alias("unit_ids"), F.when(k % 10 == 0, F.col("p_retailprice")).alias("display_point"),
        F.when((k % 6 != 1) & (k % 7 != 2), F.col("p_size").cast("double")).alias("center"),
    )


@query("C10", "part", _FEATURES + " SELECT id, coalesce(two, (SELECT level_id FROM x WHERE x.place = s.place AND x.nr = s.stop)) AS level_id FROM s")
def c10_resolved_levels(part: DataFrame) -> DataFrame:
    """The level of every feature: its own, its unit's, its anchor's unit's, or that of the first listed unit that has one."""
    return references.resolve_levels(_features(part))[0].select("id", "level_id")


@query("C10", "part", _FEATURES + """ SELECT id, 'unit_id' AS reference, unit_id AS value FROM s WHERE level_id IS NULL AND unit_id IS NOT NULL AND NOT has_u UNION ALL SELECT id, 'anchor_id', anchor_id FROM s WHERE one IS NULL AND anchor_id IS NOT NULL AND NOT has_a
  UNION ALL SELECT id, 'anchor unit_id', anchor_id FROM s WHERE one IS NULL AND has_a AND a_unit IS NULL UNION ALL SELECT id, 'unit_id', a_unit FROM s WHERE one IS NULL AND has_a AND a_unit IS NOT NULL AND NOT has_v
  UNION ALL SELECT s.id, 'unit_ids', candidate FROM s JOIN x ON s.place = x.place WHERE two IS NULL AND NOT found AND (stop IS NULL OR nr < stop)""")
def c10_reference_warnings(part: DataFrame) -> DataFrame:
    """A warning for each step on the way to a level that names a feature that isn't there."""
    return references.resolve_levels(_features(part))[1].select("id", "reference", "value")


@query("C11", "part", _FEATURES + " SELECT id, coalesce(display_point, center, a_center, u_center, (SELECT arg_min(center, nr) FROM x WHERE x.place = j.place AND x.center IS NOT NULL)) AS center FROM j")
def c11_resolved_centers(part: DataFrame) -> DataFrame:
    """The centre of every feature, by five steps."""
    return references.resolve_centers(_features(part)).select("id", "center")

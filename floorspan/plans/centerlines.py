"""Queries over networks of middle lines (inventory group G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.operators import centerlines, graph
from floorspan.plans.registry import query

_SPURS = """+h AS (SELECT from_id AS a, to_id AS b FROM v_midline UNION ALL SELECT to_id, from_id FROM v_midline), deg AS (SELECT a AS id, count(*) AS degree FROM h GROUP BY 1),
  l AS (SELECT a, b, sqrt((m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y)) AS metres FROM h JOIN v_mid m ON a = m.node_id JOIN v_mid n ON b = n.node_id),
  w(tip, prev, cur, metres, steps) AS (SELECT a, a, b, metres, 1 FROM l JOIN deg ON a = id WHERE degree = 1 UNION ALL SELECT tip, cur, l.b, w.metres + l.metres, steps + 1 FROM w JOIN deg ON cur = id JOIN l ON l.a = cur AND l.b <> prev WHERE degree = 2),
  e AS (SELECT w.*, degree, t.clearance AS tip_clear, t.endcap AS cap, n.clearance AS end_clear FROM w JOIN deg ON cur = id JOIN v_mid t ON tip = t.node_id JOIN v_mid n ON cur = n.node_id WHERE degree <> 2),
  s AS (SELECT tip, cur AS "end", metres, steps, CASE WHEN metres < 3 THEN 'short' WHEN degree >= 3 AND metres < 8 AND tip_clear < end_clear * 0.5 AND NOT cap THEN 'wedge' END AS why FROM e),
  g AS (SELECT * FROM s WHERE why IS NOT NULL)"""


@query("G9", "v_mid v_midline", _SPURS + """ SELECT tip, "end", round(metres, 6) AS metres, CAST(steps AS BIGINT) AS steps, why FROM g""", recursive=True)
def g09_spurs(mid: DataFrame, line: DataFrame) -> DataFrame:
    """Leaf chains that are short, or wedges that narrow towards their tip."""
    return centerlines.spurs(mid, line).select("tip", "end", F.round("metres", 6).alias("metres"), "steps", "why")


@query("G9", "v_mid v_midline", _SPURS + """, c(tip, a, b) AS (SELECT w.tip, prev, cur FROM w JOIN g ON w.tip = g.tip) SELECT from_id, to_id FROM v_midline WHERE NOT EXISTS (SELECT 1 FROM c WHERE (a = from_id AND b = to_id) OR (a = to_id AND b = from_id))""", recursive=True)
def g09_pruned_lines(mid: DataFrame, line: DataFrame) -> DataFrame:
    """The middle lines that are left once spurs are cut off."""
    return centerlines.pruned(mid, line)[0].select("from_id", "to_id")


@query("G9", "v_mid v_midline", """+h AS (SELECT from_id AS a, to_id AS b FROM v_midline UNION ALL SELECT to_id, from_id FROM v_midline), r(a, b) AS (SELECT node_id, node_id FROM v_mid UNION SELECT r.a, h.b FROM r JOIN h ON r.b = h.a),
  k AS (SELECT m.*, component FROM v_mid m JOIN (SELECT a AS node_id, min(b) AS component FROM r GROUP BY 1) USING (node_id)),
  d AS (SELECT a.component AS ca, b.component AS cb, a.node_id AS i, b.node_id AS j, a.x AS ax, b.x AS bx, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS metres FROM k a JOIN k b ON a.floor = b.floor AND a.node_id < b.node_id AND a.component <> b.component AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2),
  p AS (SELECT least(ca, cb) AS lo, greatest(ca, cb) AS hi, arg_min(struct_pack(i := i, j := j, metres := metres, ax := ax, bx := bx), struct_pack(m := metres, i := i, j := j)) AS b FROM d WHERE metres <= 2 GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (ORDER BY lo, hi) AS n FROM p WHERE (b.ax < 24) = (b.bx < 24)),
  e AS (SELECT n, lo AS a, hi AS b FROM o UNION ALL SELECT n, hi, lo FROM o),
  w(n, cur) AS (SELECT n, lo FROM o UNION SELECT w.n, e.b FROM w JOIN e ON w.cur = e.a AND e.n < w.n)
  SELECT b.i AS from_id, b.j AS to_id, round(b.metres, 6) AS metres FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.n = o.n AND w.cur = o.hi)""", recursive=True)
def g09_bridges(mid: DataFrame, line: DataFrame) -> DataFrame:
    """Bridges of up to 2 m between parts of a floor's network that no door joins; a wall stands at 24 m."""
    parts = graph.connected_components(mid, line)
    found = centerlines.bridges(mid.join(parts, "node_id"), (F.col("x1") < 24) == (F.col("x2") < 24))
    return found.select("from_id", "to_id", F.round("metres", 6).alias("metres"))

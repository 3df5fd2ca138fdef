"""Queries over routes between points (inventory groups C, E and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.operators import graph, relational, routing
from floorspan.plans.registry import query
from floorspan.session import cut


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000e0 * asin(least(1e0, sqrt(power(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * power(sin(radians({c} - {a}) / 2), 2))))"


_WAYS = """+way AS (SELECT row_number() OVER (ORDER BY e.from_id, e.to_id) - 1 AS edge_id, e.from_id, e.to_id, e.cost, a.ordinal, e.direction, a.lon AS ax, a.lat AS ay, (a.lon + b.lon) / 2 + 0.00002e0 * ((e.from_id + e.to_id) % 3) AS mx, (a.lat + b.lat) / 2 AS my, b.lon AS qx, b.lat AS qy
    FROM v_net e JOIN v_node a ON e.from_id = a.node_id JOIN v_node b ON e.to_id = b.node_id)"""

_SNAP = (
    _WAYS
    + f""", half AS (SELECT edge_id, ordinal, 0 AS piece, ax AS x1, ay AS y1, mx AS x2, my AS y2 FROM way UNION ALL SELECT edge_id, ordinal, 1, mx, my, qx, qy FROM way),
  len AS (SELECT *, {_hav("x1", "y1", "x2", "y2")} AS metres FROM half),
  part AS (SELECT *, coalesce(sum(metres) OVER (PARTITION BY edge_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(metres) OVER (PARTITION BY edge_id) AS total FROM len),
  ends AS (SELECT request_id, 1 AS side, lon1 AS x, lat1 AS y, ordinal1 AS ordinal FROM v_ask UNION ALL SELECT request_id, 2, lon2, lat2, ordinal2 FROM v_ask),
  met AS (SELECT q.request_id, q.side, q.x, q.y, p.*, p.ordinal = q.ordinal AS here, x2 - x1 AS ex, y2 - y1 AS ey FROM ends q JOIN part p ON p.ordinal = q.ordinal OR q.ordinal NOT IN (SELECT ordinal FROM way)),
  cl AS (SELECT *, CASE WHEN ex * ex + ey * ey > 0 THEN greatest(0e0, least(1e0, ((x - x1) * ex + (y - y1) * ey) / (ex * ex + ey * ey))) ELSE 0e0 END AS t FROM met),
  far AS (SELECT *, {_hav("x", "y", "(x1 + ex * t)", "(y1 + ey * t)")} AS distance FROM cl),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, side, edge_id ORDER BY distance, piece) AS k FROM far) WHERE k = 1),
  spot AS (SELECT * FROM (SELECT request_id, side, edge_id, here, distance, before + t * metres AS along, total, row_number() OVER (PARTITION BY request_id, side ORDER BY distance, edge_id) AS place FROM one) WHERE place <= CASE WHEN here THEN 3 ELSE 1 END)"""
)

_ROUTE = (
    _SNAP
    + """, s AS (SELECT spot.*, from_id, to_id, cost, direction, cost * along / total AS before_cost, cost * (total - along) / total AS after_cost, distance * 1000 AS off FROM spot JOIN way USING (edge_id)),
  seed AS (SELECT request_id, edge_id AS origin, from_id AS n, before_cost + off AS c FROM s WHERE side = 1 AND direction IN (0, 2) UNION ALL SELECT request_id, edge_id, to_id, after_cost + off FROM s WHERE side = 1 AND direction IN (0, 1)),
  r AS (SELECT from_id AS a, to_id AS b, min(cost) AS c FROM (SELECT from_id, to_id, cost FROM way WHERE direction IN (0, 1) UNION ALL SELECT to_id, from_id, cost FROM way WHERE direction IN (0, 2)) GROUP BY 1, 2),
  w(request_id, origin, n, c, k) AS (SELECT request_id, origin, n, min(c), 0 FROM seed GROUP BY 1, 2, 3 UNION ALL SELECT w.request_id, w.origin, r.b, min(w.c + r.c), max(w.k) + 1 FROM w JOIN r ON w.n = r.a WHERE w.k < 12 GROUP BY w.request_id, w.origin, r.b),
  reach AS (SELECT request_id, origin, n, min(c) AS c FROM w GROUP BY 1, 2, 3),
  goal AS (SELECT request_id, edge_id AS target, from_id AS n, before_cost AS c, off FROM s WHERE side = 2 AND direction IN (0, 1) UNION ALL SELECT request_id, edge_id, to_id, after_cost, off FROM s WHERE side = 2 AND direction IN (0, 2)),
  found AS (SELECT 'network' AS kind, 0 AS rank, g.request_id, origin, target, reach.c + g.c + g.off AS total, reach.c + g.c - o.off AS cost FROM goal g JOIN reach ON g.request_id = reach.request_id AND g.n = reach.n JOIN s o ON o.request_id = g.request_id AND o.side = 1 AND o.edge_id = origin
    UNION ALL SELECT 'direct', 1, o.request_id, o.edge_id, o.edge_id, o.cost * abs(d.along - o.along) / o.total + o.off + d.off, o.cost * abs(d.along - o.along) / o.total FROM s o JOIN s d ON o.request_id = d.request_id AND o.side = 1 AND d.side = 2 AND o.edge_id = d.edge_id AND NOT (o.along < d.along AND o.direction = 2) AND NOT (o.along > d.along AND o.direction = 1)),
  best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total, rank, origin, target) AS k FROM found)"""
)


def _ways(net: DataFrame, node: DataFrame, numbered: bool = True) -> DataFrame:
    """The network's edges between known nodes, numbered by their ends unless nobody asks, with a bend in the middle."""
    end = lambda k: node.select(F.col("node_id").alias(f"{k}_id"), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"), F.col("ordinal").alias(f"{k}_ordinal"))
    ids = node.select("node_id")
    d = cut(graph.clip(node, net.select("from_id", "to_id", "cost", "direction"), ids)[1])
    if numbered:
        d = cut(graph.dense_index(d.withColumn("_key", F.struct("from_id", "to_id")), "_key").drop("_key"))
    else:
        d = d.withColumn("node_index", F.lit(None).cast("long"))
    d = d.join(end("from"), "from_id").join(end("to"), "to_id")
    bend = F.struct(((F.col("from_lon") + F.col("to_lon")) / 2 + 0.00002 * ((F.col("from_id") + F.col("to_id")) % 3)).alias("lon"), ((F.col("from_lat") + F.col("to_lat")) / 2).alias("lat"))
    return d.select(F.col("node_index").alias("edge_id"), "from_id", "to_id", "cost", "direction", F.col("from_ordinal").alias("ordinal"), F.array(bend).alias("interior"))


@query("C16", "v_net v_node v_ask", _SNAP + " SELECT request_id, side, place, edge_id, round(distance, 6) AS distance, round(along, 6) AS along FROM spot", recursive=False)
def c16_snap_to_edges(net: DataFrame, node: DataFrame, ask: DataFrame) -> DataFrame:
    """The three nearest edges of each end on its floor; for a floor without edges the nearest of all."""
    parts = routing.pieces(routing.polylines(node, _ways(net, node)))
    ends = [ask.select(F.struct("request_id", F.lit(i).alias("side")).alias("point_id"), F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"), F.col(f"ordinal{i}").alias("ordinal")) for i in (1, 2)]
    found = routing.snap(ends[0].union(ends[1]), parts)
    return found.select("point_id.request_id", "point_id.side", F.col("place").cast("long").alias("place"), "edge_id", F.round("distance", 6).alias("distance"), F.round("along", 6).alias("along"))


def _routes(net: DataFrame, node: DataFrame, ask: DataFrame) -> DataFrame:
    venue = F.lit(1).alias("venue")
    return routing.route(ask.select(venue, "*"), node, _ways(net, node).select(venue, "*"))


@query("G13 G14", "v_net v_node v_ask", _ROUTE + " SELECT request_id, kind, round(cost, 3) AS cost, origin AS from_edge, target AS to_edge FROM best WHERE k = 1", recursive=True)
def g13_routes_between_points(net: DataFrame, node: DataFrame, ask: DataFrame) -> DataFrame:
    """Cheapest ways between points that are snapped to up to three edges each, over the network or along a shared edge."""
    return _routes(net, node, ask).select("request_id", "kind", F.round("cost", 3).alias("cost"), "from_edge", "to_edge")


@query("G15", "v_net v_node v_ask")
def g15_route_geometry(net: DataFrame, node: DataFrame, ask: DataFrame) -> DataFrame:
    """The same ways as nodes, edges and polylines by floor."""
    return _routes(net, node, ask).select("request_id", "nodes", "edges", "segments")


@query("C17", "v_ask v_node", f"""SELECT request_id, node_id, round(d, 6) AS distance FROM (SELECT request_id, node_id, d, row_number() OVER (PARTITION BY request_id ORDER BY d, node_id) AS k
  FROM (SELECT request_id, node_id, {_hav("lon1", "lat1", "lon", "lat")} AS d FROM v_ask JOIN v_node ON ordinal = ordinal1)) WHERE k = 1""")
def c17_node_of_point(ask: DataFrame, node: DataFrame) -> DataFrame:
    """The nearest node on the floor of each point, by growing grid cells; ties go to the lower node."""
    points = ask.select("request_id", F.col("ordinal1").alias("ordinal"), F.col("lon1").alias("x"), F.col("lat1").alias("y"))
    return relational.nearest_on_grid(points, node, "ordinal", "request_id", "node_id", 5e-4).select("request_id", "node_id", F.round("distance", 6).alias("distance"))


_PAIRS = (
    _WAYS
    + f""", m AS (SELECT from_id, to_id, direction, {_hav("ax", "ay", "mx", "my")} + {_hav("mx", "my", "qx", "qy")} AS c FROM way),
  r AS (SELECT a, b, min(c) AS c FROM (SELECT from_id AS a, to_id AS b, c FROM m WHERE direction IN (0, 1) UNION ALL SELECT to_id, from_id, c FROM m WHERE direction IN (0, 2)) WHERE c > 0 GROUP BY 1, 2),
  w(s, n, c, k) AS (SELECT node_id, node_id, 0e0, 0 FROM v_node UNION ALL SELECT w.s, r.b, min(w.c + r.c), max(w.k) + 1 FROM w JOIN r ON w.n = r.a WHERE w.k < 10 GROUP BY w.s, r.b),
  net AS (SELECT s, n, min(c) AS c FROM w GROUP BY 1, 2),
  p AS (SELECT a.node_id AS a, b.node_id AS b, {_hav("a.lon", "a.lat", "b.lon", "b.lat")} AS d FROM v_node a JOIN v_node b ON a.ordinal = b.ordinal AND a.node_id < b.node_id),
  first AS (SELECT a, b, d, c FROM p JOIN net ON a = s AND b = n WHERE d > 10 AND d <= 40 AND c > 0 ORDER BY a, b LIMIT 50)"""
)


def _pairs(net: DataFrame, node: DataFrame) -> DataFrame:
    metres = geo.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    near = relational.grid_pairs(node, "node_id", "lon", "lat", 5e-4, (metres > routing.PAIR_OVER_M) & (metres <= routing.PAIR_UPTO_M), "ordinal")
    side = lambda k: node.select(F.col("node_id").alias(k), F.col("lon").alias(f"lon_{k}"), F.col("lat").alias(f"lat_{k}"))
    d = near.join(side("a"), "a").join(side("b"), "b").withColumn("direct_m", geo.haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")))
    return routing.sampled_pairs(d.select("a", "b", "direct_m"), routing.walked(routing.polylines(node, _ways(net, node, False))))


@query("E16", "v_net v_node", _PAIRS + " SELECT a, b, round(d, 6) AS direct_m, round(c, 6) AS network_m FROM first", recursive=True)
def e16_first_pairs(net: DataFrame, node: DataFrame) -> DataFrame:
    """The first 50 pairs of nodes of a floor, over 10 and up to 40 m apart, that the network joins; neighbours meet in grid cells."""
    return _pairs(net, node).select("a", "b", F.round("direct_m", 6).alias("direct_m"), F.round("network_m", 6).alias("network_m"))


@query("D21", "v_net v_node", _PAIRS + " SELECT count(*) AS sample_count, round(max(c / d), 6) AS rho_max FROM first", recursive=True)
def d21_stretch(net: DataFrame, node: DataFrame) -> DataFrame:
    """How many pairs were sampled, and the greatest ratio of the way over the network to the straight line."""
    return _pairs(net, node).agg(F.count("*").alias("sample_count"), F.round(F.max(F.col("network_m") / F.col("direct_m")), 6).alias("rho_max"))

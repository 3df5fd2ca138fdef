"""Routes between points: snapping to edges, multi-source search, walks along one edge, and the geometry of the way.

A graph is nodes (node_id, lon, lat, ordinal) and edges (edge_id, from_id, to_id, cost, ordinal, interior, direction); interior is an
array of (lon, lat) between the ends, and edge_id numbers the edges from 0 by from_id, to_id and cost.  Filter the
edges by ``graph.edge_allowed`` first.  Snapping is a join over grid cells.  The search is sequential: requests are dealt
in slices, and each slice gets its venue's graph, which fits into a worker's memory.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.operators import graph
from floorspan.operators.nearest import nearest_segments
from floorspan.session import cut, ship

#: Cost units of a metre, edges that an endpoint is snapped to at most, and the bounds of sampled pairs.
UNITS_PER_METRE, SNAPS = 1000.0, 3
PAIRS, PAIR_OVER_M, PAIR_UPTO_M = 50, 10.0, 40.0
SLICE = 256


def polylines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with ``line``: their points (x, y) from end to end, in degrees."""
    end = lambda k: nodes.select(F.col("node_id").alias(f"{k}_id"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias(f"_{k}"))
    d = edges.join(end("from"), "from_id").join(end("to"), "to_id")
    inner = F.transform(F.coalesce("interior", F.array().cast("array<struct<lon: double, lat: double>>")), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return d.withColumn("line", F.concat(F.array("_from"), inner, F.array("_to"))).drop("_from", "_to")


def pieces(lines: DataFrame) -> DataFrame:
    """(edge_id, ordinal, piece, x1, y1, x2, y2, before, total): an edge's straight pieces with the metres before them and of the whole edge."""
    size = F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: geo.haversine(F.get("line", i)["x"], F.get("line", i)["y"], F.get("line", i + 1)["x"], F.get("line", i + 1)["y"]))
    d = lines.withColumn("_m", size)
    upto = F.transform(F.sequence(F.lit(0), F.size("_m")), lambda i: F.aggregate(F.slice("_m", F.lit(1), i), F.lit(0.0), lambda a, m: a + m))
    d = d.withColumn("_b", upto).select("edge_id", "ordinal", "line", "_m", "_b", F.element_at("_b", -1).alias("total"), F.explode(F.sequence(F.lit(0), F.size("_m") - 1)).alias("piece"))
    at = lambda c, i=0: F.get(c, F.col("piece") + i)
    return d.select("edge_id", "ordinal", "piece", *[at("line", i)[k].alias(f"{k}{i + 1}") for i in (0, 1) for k in "xy"], at("_m").alias("metres"), at("_b").alias("before"), "total")


def snap(points: DataFrame, parts: DataFrame, cell: float = 5e-4) -> DataFrame:
    """(point_id, place, edge_id, x, y, along, total, edge_ordinal, distance): the nearest edges of each point (point_id, lon, lat, ordinal).

    The SNAPS nearest edges of the point's floor by the distance to their closest points, ties by edge_id; for a floor
    without any edge, the nearest edge of all.
    """
    own = points.select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"), "ordinal")
    metres = geo.haversine(F.col("x"), F.col("y"), F.col("near.x"), F.col("near.y"))
    rim = lambda c: F.lit(0.999 * geo.EARTH_M * math.radians(c)) * F.cos(F.radians(F.least(F.abs("y") + c, F.lit(89.0))))
    extra = ["x1", "y1", "x2", "y2", "before", "metres", "total", F.col("ordinal").alias("edge_ordinal")]
    by_floor = parts.select("ordinal", "edge_id", "piece", *extra)
    here = nearest_segments(own, by_floor, "ordinal", "point_id", "edge_id", cell, SNAPS, metres, rim, "piece")
    bare = own.join(parts.select("ordinal").distinct(), "ordinal", "left_anti").withColumn("any", F.lit(0))
    anywhere = parts.select(F.lit(0).alias("any"), "edge_id", "piece", *extra)
    far = nearest_segments(bare, anywhere, "any", "point_id", "edge_id", cell * 16, 1, metres, rim, "piece").drop("any")
    found = here.unionByName(far)
    return found.select(
        "point_id", "place", "edge_id", F.col("near.x").alias("x"), F.col("near.y").alias("y"), (F.col("before") + F.col("near.t") * F.col("metres")).alias("along"), "total", "edge_ordinal", "distance"
    )


#: Edges of all venues that are searched as they are; of more, only those on the cheapest ways are sent to the workers.
SEARCHED_EDGES = 1 << 22


def _used(requests: DataFrame, snapped: DataFrame, edges: DataFrame, venue: str) -> DataFrame:
    """(venue, request_id, edge_id) of the edges on the cheapest ways of each request from its spots to the nodes at its goals.

    Labels are (cost, origin, cost before, node before, edge), so of equal ways the one is kept that the search takes.
    """
    spots = requests.select(venue, "request_id").join(snapped.select("point_id.request_id", F.col("point_id.end").alias("end"), "edge_id", "along", "total", "distance"), "request_id")
    ends = edges.select(venue, "edge_id", "from_id", "to_id", F.col("cost").cast("double").alias("cost"), "direction")
    known = cut(spots.join(ends.join(F.broadcast(spots.select(venue, "edge_id").distinct()), [venue, "edge_id"], "left_semi"), [venue, "edge_id"]))  # 2 * SNAPS a request at most
    whole, off = F.greatest("total", F.lit(2.220446049250313e-16)), F.col("distance") * UNITS_PER_METRE
    before, after = F.col("cost") * F.col("along") / whole, F.col("cost") * (F.col("total") - F.col("along")) / whole
    none = F.lit(None).cast("long")
    label = lambda c: F.struct(c.alias("cost"), F.col("edge_id").alias("origin"), F.lit(-1.0).alias("at"), none.alias("node"), none.alias("edge"))
    start, goal = known.filter("end = 1"), known.filter("end = 2")
    seeds = start.filter(graph.backward()).select(venue, "request_id", F.col("from_id").alias("node"), label(before + off).alias("l")).union(start.filter(graph.forward()).select(venue, "request_id", "to_id", label(after + off)))
    goals = goal.filter(graph.forward()).select(venue, "request_id", F.col("from_id").alias("node"), (before + off).alias("extra")).union(goal.filter(graph.backward()).select(venue, "request_id", "to_id", after + off))
    there = ends.filter(graph.forward()).select(venue, F.col("from_id").alias("source"), F.col("to_id").alias("target"), "cost", F.col("edge_id").alias("edge"))
    arcs = there.union(ends.filter(graph.backward()).select(venue, "to_id", "from_id", "cost", "edge_id"))
    arcs = arcs.groupBy(venue, "source", "target").agg(F.min("cost").alias("cost"), F.min_by("edge", F.struct("cost", "edge")).alias("edge"))
    on = lambda: F.struct((F.col("l.cost") + F.col("cost")).alias("cost"), F.col("l.origin").alias("origin"), F.col("l.cost").alias("at"), F.col("node").cast("long").alias("node"), F.col("edge").cast("long").alias("edge"))
    keys = [venue, "request_id"]
    labels = graph.relax(seeds, arcs, goals, keys, on, False)
    used, at = known.select(*keys, "edge_id"), goals.select(*keys, "node").distinct()
    while True:  # back along the ways, all at once
        step = cut(at.join(labels, [*keys, "node"]).filter("l.edge is not null").select(*keys, F.col("l.edge").alias("edge_id"), F.col("l.node").alias("node")).distinct())
        if step.isEmpty():
            return cut(used.distinct())
        used, at = used.union(step.select(*keys, "edge_id")), step.select(*keys, "node").distinct()


def route(requests: DataFrame, nodes: DataFrame, edges: DataFrame, venue: str = "venue", most: int = SEARCHED_EDGES) -> DataFrame:
    """(venue, request_id, kind, cost, from_edge, to_edge, nodes, edges, from_x, from_y, to_x, to_y, segments) of each request that can be answered.

    Requests are (venue, request_id, lon1, lat1, ordinal1, lon2, lat2, ordinal2), nodes and edges have a venue column too; ids of
    nodes and edges differ between venues.  ``cost`` is that of the way over the network alone; the choice also counts the ways
    to and from the network, and of equal ones takes the lower from_edge, to_edge and last node.  kind is direct for a walk
    along one edge that is cheaper than any other, else network.  Requests with a coordinate that isn't finite have no row.
    Of more than ``most`` edges, the workers get those alone that rounds of joins find on the cheapest ways.
    """
    spark = requests.sparkSession
    ship(spark)
    finite = F.lit(True)
    for c in ("lon1", "lat1", "ordinal1", "lon2", "lat2", "ordinal2"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    requests = requests.filter(finite)
    lines = polylines(nodes, edges)
    parts = pieces(lines)
    ends = [requests.select(F.struct("request_id", F.lit(i).alias("end")).alias("point_id"), F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"), F.col(f"ordinal{i}").alias("ordinal")) for i in (1, 2)]
    snapped = cut(snap(ends[0].union(ends[1]), parts))
    spots = snapped.groupBy("point_id.request_id").agg(F.collect_list(F.struct(F.col("point_id.end").alias("end"), "place", "edge_id", "x", "y", "along", "total", "edge_ordinal", "distance")).alias("spots"))  # 2 * SNAPS at most
    asked = requests.select(venue, "request_id").join(spots, "request_id").withColumn("slice", F.pmod(F.xxhash64("request_id"), F.lit(1 << 20)))
    sizes = asked.groupBy(venue).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("n"))
    asked = asked.join(sizes, venue).withColumn("slice", (F.col("slice") % F.col("n")).cast("int")).drop("n")
    graph_rows = lines.select(venue, "edge_id", "from_id", "to_id", F.col("cost").cast("double").alias("cost"), F.col("ordinal").cast("double").alias("ordinal"), "direction", F.transform("line", lambda p: F.array(p["x"], p["y"])).alias("line"))
    if edges.count() > most:
        asked = cut(asked)
        wanted = _used(requests, snapped, edges, venue).join(asked.select(venue, "request_id", "slice"), [venue, "request_id"]).select(venue, "slice", "edge_id").distinct()
        dealt = graph_rows.join(cut(wanted), [venue, "edge_id"]).select(*graph_rows.columns, "slice")
    else:
        dealt = graph_rows.join(sizes, venue).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    point = "struct<lon: double, lat: double>"
    kind = requests.schema[venue].dataType.simpleString()
    id_kind = requests.schema["request_id"].dataType.simpleString()
    columns = [venue, "request_id", "kind", "cost", "from_edge", "to_edge", "nodes", "edges", "from_x", "from_y", "to_x", "to_y", "segments"]
    schema = f"{venue} {kind}, request_id {id_kind}, kind string, cost double, from_edge long, to_edge long, nodes array<long>, edges array<long>, from_x double, from_y double, to_x double, to_y double, segments array<struct<ordinal: double, line: array<{point}>>>"

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {int(r.edge_id): r for r in right.itertuples()}
        around: dict[int, list[tuple[int, int, float]]] = {}
        for e in known.values():
            if e.direction in (0, 1):
                around.setdefault(int(e.from_id), []).append((int(e.to_id), int(e.edge_id), e.cost))
            if e.direction in (0, 2):
                around.setdefault(int(e.to_id), []).append((int(e.from_id), int(e.edge_id), e.cost))
        out = []
        for r in left.itertuples():
            spots = sorted(r.spots, key=lambda s: s["place"])
            found = answer(known, around, [s for s in spots if s["end"] == 1], [s for s in spots if s["end"] == 2])
            if found is not None:
                out.append((key[0], r.request_id, *found))
        return pd.DataFrame(out, columns=columns)

    return asked.groupBy(venue, "slice").cogroup(dealt.groupBy(venue, "slice")).applyInPandas(lambda k, a, b: run(k, a, b), schema)


def _shares(edge, spot) -> tuple[float, float]:
    """The cost of an edge's parts before and after a spot on it."""
    total = max(spot["total"], 2.220446049250313e-16)
    return edge.cost * spot["along"] / total, edge.cost * (spot["total"] - spot["along"]) / total


def _off(spot) -> float:
    return spot["distance"] * UNITS_PER_METRE


def answer(known: dict, around: dict, starts: list, goals: list) -> tuple | None:
    """The cheapest way from any of the spots to any of the others."""
    direct = None
    for o in starts:
        for d in goals:
            e = known[o["edge_id"]]
            if o["edge_id"] != d["edge_id"] or (o["along"] < d["along"] and e.direction == 2) or (o["along"] > d["along"] and e.direction == 1):
                continue
            cost = e.cost * abs(d["along"] - o["along"]) / max(o["total"], 2.220446049250313e-16)
            key = cost + _off(o) + _off(d), o["edge_id"]
            if direct is None or key < direct[0]:
                direct = key, cost, o, d
    best, seed, came = search(known, around, starts, goals)
    chosen = None
    for d in goals:
        e = known[d["edge_id"]]
        before, after = _shares(e, d)
        for node, part, may in ((int(e.from_id), before, e.direction in (0, 1)), (int(e.to_id), after, e.direction in (0, 2))):
            if may and node in best:
                key = best[node] + part + _off(d), seed[node], d["edge_id"], node
                if chosen is None or key < chosen[0]:
                    chosen = key, d
    if chosen is None and direct is None:
        return None
    if chosen is None or (direct is not None and direct[0][0] < chosen[0][0]):
        _, cost, o, d = direct
        e = known[o["edge_id"]]
        return "direct", cost, o["edge_id"], d["edge_id"], [], [], o["x"], o["y"], d["x"], d["y"], grouped([((o["x"], o["y"]), e.ordinal), *[(p, e.ordinal) for p in between(e.line, o["along"], d["along"])], ((d["x"], d["y"]), e.ordinal)])
    (total, from_edge, to_edge, node), d = chosen
    o = next(s for s in starts if s["edge_id"] == from_edge)
    nodes, edges = [node], []
    while nodes[-1] in came:
        before, edge = came[nodes[-1]]
        nodes.append(before)
        edges.append(edge)
    nodes, edges = nodes[::-1], edges[::-1]
    first, last = known[from_edge], known[to_edge]
    way = [((o["x"], o["y"]), first.ordinal)]
    way += [(p, first.ordinal) for p in rest_of(first.line, o["along"], nodes[0] == first.from_id)]
    for at, edge in zip(nodes, edges, strict=False):
        e = known[edge]
        line = [tuple(p) for p in e.line]
        way += [(p, e.ordinal) for p in (line if at == e.from_id else line[::-1])[1:]]
    way += [(p, last.ordinal) for p in rest_of(last.line, d["along"], nodes[-1] == last.from_id)[::-1]]
    way.append(((d["x"], d["y"]), last.ordinal))
    return "network", total - _off(o) - _off(d), from_edge, to_edge, nodes, edges, o["x"], o["y"], d["x"], d["y"], grouped(way)


def search(known: dict, around: dict, starts: list, goals: list) -> tuple[dict[int, float], dict[int, int], dict[int, tuple[int, int]]]:
    """Least costs from the spots, the edge that each node's way set out on, and the step before it; until all goals are settled."""
    best: dict[int, float] = {}
    seed: dict[int, int] = {}
    came: dict[int, tuple[int, int]] = {}
    heap: list[tuple[float, int, int]] = []
    for o in starts:
        e = known[o["edge_id"]]
        back, on = _shares(e, o)
        for node, cost, may in ((int(e.from_id), back + _off(o), e.direction in (0, 2)), (int(e.to_id), on + _off(o), e.direction in (0, 1))):
            if may and (cost, o["edge_id"]) < (best.get(node, math.inf), seed.get(node, math.inf)):
                best[node], seed[node] = cost, o["edge_id"]
                heapq.heappush(heap, (cost, o["edge_id"], node))
    left = {int(n) for d in goals for e in (known[d["edge_id"]],) for n, may in ((e.from_id, e.direction in (0, 1)), (e.to_id, e.direction in (0, 2))) if may}
    while heap and left:
        cost, origin, node = heapq.heappop(heap)
        if (cost, origin) > (best[node], seed[node]):
            continue
        left.discard(node)
        for to, edge, c in around.get(node, ()):
            if (cost + c, origin) < (best.get(to, math.inf), seed.get(to, math.inf)):
                best[to], seed[to], came[to] = cost + c, origin, (node, edge)
                heapq.heappush(heap, (cost + c, origin, to))
    return best, seed, came


def metres(a, b) -> float:
    lon1, lat1, lon2, lat2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _marks(line) -> Iterator[tuple[float, tuple[float, float]]]:
    """The points of a line with the metres before each."""
    at = 0.0
    for i, p in enumerate(line):
        at += metres(line[i - 1], p) if i else 0.0
        yield at, (float(p[0]), float(p[1]))


def rest_of(line, along: float, to_start: bool) -> list[tuple[float, float]]:
    """The points from a place on a line to its start or its end, without the place itself."""
    marks = list(_marks(line))
    return [p for at, p in reversed(marks) if at < along] if to_start else [p for at, p in marks if at > along]


def between(line, a: float, b: float) -> list[tuple[float, float]]:
    found = [p for at, p in list(_marks(line))[1:] if min(a, b) < at < max(a, b)]
    return found if a <= b else found[::-1]


def grouped(way: list[tuple[tuple[float, float], float]]) -> list[dict]:
    """Runs of one floor, without repeated points; where the floor changes, the last point begins the next run as well."""
    out: list[tuple[float, list]] = []
    for p, ordinal in way:
        if out and out[-1][0] == ordinal:
            if out[-1][1][-1] != p:
                out[-1][1].append(p)
        else:
            out.append((ordinal, [out[-1][1][-1], p] if out else [p]))
    return [{"ordinal": float(o), "line": [{"lon": x, "lat": y} for x, y in line]} for o, line in out if len(line) > 1]


def walked(lines: DataFrame) -> DataFrame:
    """(source, target, cost) with the metres of each edge's line, in each direction that it may be walked; edges without length are left out."""
    return graph.adjacency(lines.withColumn("cost", geo.polyline_length(F.col("line"))).filter("cost > 0"))


def sampled_pairs(candidates: DataFrame, adjacent: DataFrame, most: int = PAIRS) -> DataFrame:
    """(a, b, direct_m, network_m) of the first of the candidates (a, b, direct_m), by a and b, that the network joins.

    Ways are searched for a few times as many candidates as are wanted, and for more only while too few of them are joined.
    """
    want = 4 * most
    while True:
        asked = cut(candidates.orderBy("a", "b").limit(want).withColumn("request_id", F.shiftleft("a", 32).bitwiseOR(F.col("b"))))
        requests = asked.select(F.lit(1).alias("venue"), "request_id", F.col("a").alias("source"), F.col("b").alias("target"))
        found = graph.routes(requests, adjacent.withColumn("venue", F.lit(1))).filter("cost > 0").select("request_id", F.col("cost").alias("network_m"))
        got = cut(asked.join(found, "request_id").orderBy("a", "b").limit(most).select("a", "b", "direct_m", "network_m"))
        if got.count() >= most or asked.count() < want:
            return got
        want *= 4

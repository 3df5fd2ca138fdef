"""Routing graphs as node and edge DataFrames.

Edges have from_id, to_id and cost, and the attribute columns that a predicate names.  Iterative operators cut
their lineage with ``checkpoint()``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspan.functions.text import in_day_window
from floorspan.session import cut, drop, ship


@dataclass(frozen=True)
class Profile:
    skip_stairs: bool = False
    skip_escalators: bool = False
    least_clearance_m: float | None = None
    allow_barriers: bool = False
    exclude_accessible_only: bool = False
    need_wheelchair: bool = False


WALKING = Profile(exclude_accessible_only=True)
WHEELCHAIR = Profile(skip_stairs=True, skip_escalators=True, least_clearance_m=0.8, need_wheelchair=True)


def edge_allowed(profile: Profile, minute: int | None = None) -> Column:
    """Whether a traveller may use an edge; an unknown clearance is no obstacle."""
    ok = F.lit(True)
    barred = [k for k, skip in (("stairs", profile.skip_stairs), ("escalator", profile.skip_escalators)) if skip]
    if barred:
        ok = ok & F.coalesce(~F.col("vertical").isin(*barred), F.lit(True))
    if profile.least_clearance_m is not None:
        ok = ok & (F.col("clearance_m").isNull() | (F.col("clearance_m") >= profile.least_clearance_m))
    if not profile.allow_barriers:
        ok = ok & ~F.col("barrier")
    if profile.exclude_accessible_only:
        ok = ok & ~F.col("accessible_only")
    if profile.need_wheelchair:
        ok = ok & F.col("wheelchair")
    if minute is not None:
        ok = ok & in_day_window(F.lit(minute), F.col("start_minute"), F.col("end_minute"))
    return ok


def forward() -> Column:
    return F.col("direction").isin(0, 1)


def backward() -> Column:
    return F.col("direction").isin(0, 2)


def attach_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends found, with the ends' ordinals."""
    ends = nodes.select("node_id", "ordinal")
    out = edges.join(ends.select(F.col("node_id").alias("from_id"), F.col("ordinal").alias("from_ordinal")), "from_id")
    return out.join(ends.select(F.col("node_id").alias("to_id"), F.col("ordinal").alias("to_ordinal")), "to_id")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("node_id")
    no_from = edges.join(ids, edges["from_id"] == ids["node_id"], "left_anti")
    no_to = edges.join(ids, edges["from_id"] == ids["node_id"], "left_semi").join(ids, edges["to_id"] == ids["node_id"], "left_anti")
    return no_from.union(no_to)


def dense_index(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """A 0-based index in key order, without sorting all rows in one task: ranges are counted, then numbered within."""
    ranges = cut(nodes.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    starts, at = [], 0
    for r in sorted(ranges.groupBy("_p").count().collect()):  # a row for each partition
        starts.append((r["_p"], at))
        at += r["count"]
    offsets = nodes.sparkSession.createDataFrame(starts, "_p int, _start long")
    numbered = ranges.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    return numbered.join(F.broadcast(offsets), "_p").withColumn("node_index", F.col("_start") + F.col("_i") - 1).drop("_p", "_i", "_start")


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, target, cost): an edge in each direction that it may be walked."""
    there = edges.filter(forward()).select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), "cost")
    return there.unionByName(edges.filter(backward()).select(F.col("to_id").alias("source"), F.col("from_id").alias("target"), "cost"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) of every node, 0 for isolated ones."""
    ends = edges.select(F.col("from_id").alias("node_id")).union(edges.select(F.col("to_id").alias("node_id")))
    counted = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_id").alias("node_id")).union(edges.select(F.col("to_id").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node id that can be reached, edges taken both ways.

    Each round gives a node the least label around it and then its label's label, which halves long chains.
    """
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = held = cut(nodes.select(F.col("node_id").alias("id"), F.col("node_id").alias("label")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        new = labels.join(around, labels["id"] == around["a"], "left").select("id", "label", F.least("label", F.coalesce("l", "label")).alias("l"))
        jump = new.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        old, held = held, cut(new.join(jump, "l", "left").select("id", F.coalesce("ll", "l").alias("new"), "label"))
        drop(old)
        changed = held.filter("new <> label").limit(1).count()
        labels = held.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("id").alias("node_id"), F.col("label").alias("component"))


def shortest_costs(adjacent: DataFrame, source: int, cutoff: float | None = None) -> DataFrame:
    """(node_id, cost) of all nodes that can be reached from a source, within a cutoff if one is given.

    Rounds of relaxation: only nodes whose cost fell in a round send it on in the next.
    """
    adjacent = cut(adjacent.groupBy("source", "target").agg(F.min("cost").alias("cost")))  # read in every round
    best = cut(adjacent.sparkSession.createDataFrame([(source, 0.0)], "id long, cost double"))
    front = best
    while True:
        step = front.join(adjacent, front["id"] == adjacent["source"]).select(F.col("target").alias("id"), (front["cost"] + adjacent["cost"]).alias("c"))
        if cutoff is not None:
            step = step.filter(F.col("c") <= cutoff)
        step = step.groupBy("id").agg(F.min("c").alias("c"))
        better = cut(step.join(best, "id", "left").filter("cost is null or c < cost").select("id", F.col("c").alias("cost")))
        if better.isEmpty():
            return best.select(F.col("id").alias("node_id"), "cost")
        best = cut(best.join(better.select("id"), "id", "left_anti").union(better))
        front = better


def reciprocal_pairs(paths: DataFrame) -> DataFrame:
    """(path_id, partner_id): a path and the one that runs back over the same ends, paired one to one.

    Equal signatures are numbered, so duplicates don't multiply; the smaller id of a pair comes first.
    """
    w = Window.partitionBy("from_id", "to_id").orderBy("path_id")
    p = paths.select("path_id", "from_id", "to_id", F.row_number().over(w).alias("n"))
    q = p.select(F.col("path_id").alias("partner_id"), F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id"), "n")
    return p.join(q, ["from_id", "to_id", "n"]).filter("path_id < partner_id").select("path_id", "partner_id")


def clip(nodes: DataFrame, edges: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``inside`` and the edges between them."""
    kept = nodes.join(inside.select("node_id"), "node_id", "left_semi")
    ids = kept.select("node_id")
    e = edges.join(ids, edges["from_id"] == ids["node_id"], "left_semi").join(ids, edges["to_id"] == ids["node_id"], "left_semi")
    return kept, e


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, node_id, detail) of isolated nodes and of components other than the largest; by code."""
    alone = isolated(nodes, edges).select(F.lit("isolated_node").alias("code"), "node_id", F.lit(1).cast("long").alias("detail"))
    parts = connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    top = parts.agg(F.max_by("component", F.struct("size", (-F.col("component")).alias("k"))).alias("c"))
    split = parts.join(F.broadcast(top), parts["component"] == top["c"], "left_anti")  # one row
    return split.select(F.lit("disconnected_component").alias("code"), F.col("component").alias("node_id"), F.col("size").alias("detail")).union(alone)


#: Arcs of a graph that a worker searches by itself; larger graphs are searched by rounds of joins.
SEARCHED_ARCS = 1 << 23


def relax(seeds: DataFrame, arcs: DataFrame, goals: DataFrame, keys: list[str], extend: Callable[[], Column], every: bool) -> DataFrame:
    """(keys, node, l): the least labels of the nodes that matter for the goals, in rounds of joins.

    Labels ``l`` are structs that begin with their cost, and ``extend`` makes one from l, node and the arc's columns; seeds are (keys, node, l),
    arcs (the first of the keys, source, target, cost, ...) with costs of 0 or more, goals (keys, node, extra).  A round sends on the labels of nearly the least
    cost that haven't been sent yet.  What costs more than the goals known so far (the dearest goal, or with its extra the cheapest
    one unless ``every``) is left out, so labels up to that cost are final at the end, and others may be missing.
    """
    arcs = cut(arcs.filter("source <> target").repartitionByRange("cost").sortWithinPartitions("cost"))  # sorted: a bound on costs skips the files' rest
    width = arcs.filter("cost > 0").agg(F.percentile_approx("cost", 0.02)).first()[0] or 1.0
    best = cut(seeds.groupBy(*keys, "node").agg(F.min("l").alias("l")).withColumn("fresh", F.lit(True)))
    goals = cut(goals.select(*keys, "node", "extra").join(arcs.select(keys[0], F.col("target").alias("node")).union(seeds.select(keys[0], "node")).distinct(), [keys[0], "node"], "left_semi"))
    far = F.lit(float("inf"))
    while True:
        reached = goals.join(best.select(*keys, "node", "l"), [*keys, "node"], "left").withColumn("c", F.coalesce(F.col("l.cost") + (F.lit(0.0) if every else F.col("extra")), far))
        bounds = cut(reached.groupBy(*keys).agg((F.max("c") if every else F.min("c")).alias("most")))
        waiting = best.filter("fresh").join(bounds, keys).filter(F.col("l.cost") <= F.col("most"))
        least, most = waiting.agg(F.min("l.cost"), F.max("most")).first()
        if least is None:
            for d in (arcs, goals, bounds):
                drop(d)
            return best.select(*keys, "node", "l")
        front = waiting.filter(F.col("l.cost") < least + width) if least + width > least else waiting
        ways = arcs if math.isinf(most) else arcs.filter(F.col("cost") <= most - least)
        sent = front.join(ways.withColumnRenamed("source", "node"), [keys[0], "node"]).filter(F.col("l.cost") + F.col("cost") <= F.col("most"))
        sent = sent.select(*keys, F.col("target").alias("_to"), extend().alias("_new")).groupBy(*keys, F.col("_to").alias("node")).agg(F.min("_new").alias("_new"))
        better = F.col("_new").isNotNull() & (F.col("l").isNull() | (F.col("_new") < F.col("l")))
        stays = F.coalesce("fresh", F.lit(False)) & (F.coalesce(F.col("l.cost"), far) >= least + width)
        old, best = best, cut(best.join(sent, [*keys, "node"], "full_outer").select(*keys, "node", F.when(better, F.col("_new")).otherwise(F.col("l")).alias("l"), (better | stays).alias("fresh")))
        drop(old)
        drop(bounds)


def routes(requests: DataFrame, edges: DataFrame, key: str = "venue", most: int = SEARCHED_ARCS) -> DataFrame:
    """(venue, request_id, cost, path) of the cheapest route of each request (venue, request_id, source, target).

    Of equal costs, the path whose nodes come first is taken.  A venue of up to ``most`` arcs is searched on a worker; those
    of larger venues, by rounds of joins.
    """
    ship(requests.sparkSession)
    edges = cut(edges.select(key, "source", "target", F.col("cost").cast("double").alias("cost")).groupBy(key, "source", "target").agg(F.min("cost").alias("cost")))
    large = cut(edges.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key))  # a row for each large venue
    if large.isEmpty():
        return _searched(requests, edges, key)
    requests = cut(requests)
    some, arcs = requests.join(large, key, "left_semi"), edges.join(F.broadcast(large), key, "left_semi")
    start = F.struct(F.lit(0.0).alias("cost"), F.array(F.col("source").cast("long")).alias("path"))
    seeds = some.select(key, F.col("source").alias("start"), F.col("source").alias("node"), start.alias("l")).distinct()
    goals = some.select(key, F.col("source").alias("start"), F.col("target").alias("node"), F.lit(0.0).alias("extra")).distinct()
    on = lambda: F.struct((F.col("l.cost") + F.col("cost")).alias("cost"), F.concat("l.path", F.array(F.col("target").cast("long"))).alias("path"))
    found = relax(seeds, arcs, goals, [key, "start"], on, True)
    answered = some.join(found.select(key, F.col("start").alias("source"), F.col("node").alias("target"), "l"), [key, "source", "target"], "left").select(key, F.col("request_id").cast("long").alias("request_id"), F.col("l.cost").alias("cost"), F.col("l.path").alias("path"))
    return answered.union(_searched(requests.join(large, key, "left_anti"), edges.join(F.broadcast(large), key, "left_anti"), key))


def _searched(requests: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, float]]] = {}
        for s, t, c in zip(right["source"], right["target"], right["cost"], strict=True):
            around.setdefault(int(s), []).append((int(t), float(c)))
        out = []
        for source, some in left.groupby("source"):  # one search answers all requests from a node
            found = search_all(around, int(source), {int(t) for t in some["target"]})
            out += [(k[0], r.request_id, *found.get(int(r.target), (None, None))) for r in some.itertuples()]
        return pd.DataFrame(out, columns=[key, "request_id", "cost", "path"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(run, f"{key} {kind}, request_id long, cost double, path array<long>")


def search(around: dict[int, list[tuple[int, float]]], source: int, target: int) -> tuple[float | None, list[int] | None]:
    """Dijkstra's algorithm with paths in the order of (cost, path)."""
    return search_all(around, source, {target}).get(target, (None, None))


def search_all(around: dict[int, list[tuple[int, float]]], source: int, targets: set[int]) -> dict[int, tuple[float, list[int]]]:
    """``search`` for many targets at once; those that can't be reached are left out."""
    done: set[int] = set()
    least: dict[int, float] = {}
    found: dict[int, tuple[float, list[int]]] = {}
    heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (source,))]
    while heap and len(found) < len(targets):
        cost, path = heapq.heappop(heap)
        at = path[-1]
        if at in done:
            continue
        if at in targets:
            found[at] = cost, list(path)
        done.add(at)
        for t, c in around.get(at, ()):
            if t not in done and cost + c <= least.get(t, math.inf):  # equal costs stay: their paths decide
                least[t] = cost + c
                heapq.heappush(heap, (cost + c, (*path, t)))
    return found


def match_pairs(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum-cost maximum matching of (lower, upper, cost) within each group of ``keys``: most pairs, then least cost.

    Groups are the connectors of one kind between two floors, so they are small.
    """
    ship(candidates.sparkSession)
    kinds = ", ".join(f"{k} {candidates.schema[k].dataType.simpleString()}" for k in keys)

    def run(k: tuple, df: pd.DataFrame) -> pd.DataFrame:
        pairs = best_matching({(int(a), int(b)): float(c) for a, b, c in zip(df["lower"], df["upper"], df["cost"], strict=True)})
        return pd.DataFrame([(*k, a, b) for a, b in pairs], columns=[*keys, "lower", "upper"])

    least = candidates.groupBy(*keys, "lower", "upper").agg(F.min("cost").alias("cost"))
    return least.groupBy(*keys).applyInPandas(run, f"{kinds}, lower long, upper long")


def best_matching(cost: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The Hungarian method over rows of a matrix; a pair that isn't allowed costs more than all others together."""
    if not cost:
        return []
    lower, upper = sorted({a for a, _ in cost}), sorted({b for _, b in cost})
    row, col = {a: i for i, a in enumerate(lower)}, {b: j for j, b in enumerate(upper)}
    least = min(cost.values())
    barred = (min(len(lower), len(upper)) + 1) * (max(cost.values()) - least + 1)
    matrix = np.full((len(lower), len(upper)), barred)
    for (a, b), c in cost.items():
        matrix[row[a], col[b]] = c - least
    turned = len(lower) > len(upper)
    m = np.ascontiguousarray(matrix.T) if turned else matrix
    n_rows, n_cols = m.shape
    u, v = np.zeros(n_rows), np.zeros(n_cols + 1)  # the last column stands for a row that has none yet
    mate = np.full(n_cols + 1, -1)
    for i in range(n_rows):
        mate[n_cols], at = i, n_cols
        slack, back, used = np.full(n_cols, np.inf), np.full(n_cols, n_cols), np.zeros(n_cols + 1, dtype=bool)
        while mate[at] >= 0:
            used[at] = True
            now = m[mate[at]] - u[mate[at]] - v[:n_cols]
            better = ~used[:n_cols] & (now < slack)
            slack[better], back[better] = now[better], at
            free = np.where(used[:n_cols], np.inf, slack)
            to = int(free.argmin())
            step = free[to]
            u[mate[used]] += step
            v[used] -= step
            slack[~used[:n_cols]] -= step
            at = to
        while at != n_cols:
            mate[at] = mate[back[at]]
            at = back[at]
        mate[n_cols] = -1
    pairs = [(int(mate[j]), j) for j in range(n_cols) if mate[j] >= 0]
    pairs = [(lower[j], upper[i]) if turned else (lower[i], upper[j]) for i, j in pairs]
    return sorted(p for p in pairs if p in cost)

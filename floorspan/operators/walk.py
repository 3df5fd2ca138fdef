"""Walkable areas, chords, smoothing and grid paths."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.operators.nearest import cells_of, closest_point
from floorspan.session import cut, ship

Box = tuple[float, float, float, float]


def walkable(px: Column, py: Column, outer: Column, holes: Column, tolerance: float) -> Column:
    """Inside the outer ring, or nearer to it than the tolerance, and outside all holes (which have none)."""
    near = geo.in_ring(px, py, outer) | (geo.ring_distance(px, py, outer) <= tolerance)
    return near & ~F.exists(holes, lambda h: geo.in_ring(px, py, h))


def chord_legal(ax: Column, ay: Column, bx: Column, by: Column, ok: Callable[[Column, Column], Column], step: float) -> Column:
    """All samples of a chord at most ``step`` apart are walkable."""
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    return F.forall(F.sequence(F.lit(0), n), lambda i: ok(ax + (bx - ax) * i / n, ay + (by - ay) * i / n))


def crosses(a: tuple[float, float], b: tuple[float, float], box: Box, step: float = 0.5) -> bool:
    """Whether a sample of the chord lies inside the box."""
    n = max(1, int(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 / step) + 1)
    for i in range(n + 1):
        x, y = a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n
        if box[0] < x < box[2] and box[1] < y < box[3]:
            return True
    return False


def smooth(points: list[tuple[float, float]], obstacles: list[Box]) -> list[int]:
    """Indices of the points that stay: from each, the farthest that a legal chord reaches comes next."""
    kept, at = [0], 0
    while at < len(points) - 1:
        at = next(j for j in range(len(points) - 1, at, -1) if j == at + 1 or not any(crosses(points[at], points[j], o) for o in obstacles))
        kept.append(at)
    return kept


def smooth_routes(points: DataFrame, obstacles: list[Box]) -> DataFrame:
    """(route, i) of the points that stay of each route's points (route, i, x, y); a route is a group of its own."""
    ship(points.sparkSession)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("i")
        kept = smooth(list(zip(df["x"], df["y"], strict=True)), obstacles)
        return df.iloc[kept][["route", "i"]]

    return points.groupBy("route").applyInPandas(run, f"route {points.schema['route'].dataType.simpleString()}, i long")


def _octile(a: tuple[int, int], b: tuple[int, int]) -> int:
    dx, dy = abs(a[0] - b[0]), abs(a[1] - b[1])
    return 1000 * max(dx, dy) + 414 * min(dx, dy)


def grid_path(a: tuple[int, int], b: tuple[int, int], obstacles: list[Box], margin: int = 20) -> int | None:
    """Steps of a shortest way between grid points with eight neighbours, in thousandths of a metre; null when there is none.

    The search is led by the way that is left without obstacles, so that it looks at the grid around the way alone.  A second one
    sets out from the goal and heads for the start until both meet: a goal that is shut in ends it, however wide the rest.
    """
    lo = (min(a[0], b[0]) - margin, min(a[1], b[1]) - margin)
    hi = (max(a[0], b[0]) + margin, max(a[1], b[1]) + margin)

    def around(at: tuple[int, int]):
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                to = (at[0] + dx, at[1] + dy)
                if to != at and lo[0] <= to[0] <= hi[0] and lo[1] <= to[1] <= hi[1] and not any(o[0] < to[0] < o[2] and o[1] < to[1] < o[3] for o in obstacles):
                    yield to, 1414 if dx and dy else 1000

    if a != b and any(o[0] < b[0] < o[2] and o[1] < b[1] < o[3] for o in obstacles):
        return None
    best, heap = {a: 0}, [(_octile(a, b), _octile(a, b), a)]
    back, seen, met = [(_octile(b, a), b)], {b}, False
    while heap:
        whole, left, at = heapq.heappop(heap)
        if at == b:
            return best[at]
        cost = best[at]
        if whole > cost + left:
            continue
        for to, step in around(at):
            c = cost + step
            if c < best.get(to, 1 << 60):
                best[to] = c
                heapq.heappush(heap, (c + _octile(to, b), _octile(to, b), to))
        if not met:
            if not back:
                return None
            _, at = heapq.heappop(back)
            met = at in best
            for to, _ in () if met else around(at):
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(back, (_octile(to, a), to))
    return None


def grid_paths(ends: DataFrame, obstacles: list[Box]) -> DataFrame:
    """(ordinal, length_mm) of the way between each row's ends (ordinal, a_lon, a_lat, b_lon, b_lat in metres)."""
    ship(ends.sparkSession)

    def run(batches):
        for df in batches:
            out = [(r.ordinal, grid_path((round(r.a_lon), round(r.a_lat)), (round(r.b_lon), round(r.b_lat)), obstacles)) for r in df.itertuples()]
            yield pd.DataFrame(out, columns=["ordinal", "length_mm"])

    named = ends.toDF("ordinal", "a_lon", "a_lat", "b_lon", "b_lat")
    return named.mapInPandas(run, "ordinal double, length_mm long")


#: How far a sample may lie outside an area, how near a lock blocks a skipped point, and the spacing of samples.
OUTSIDE_M, LOCK_M, SAMPLE_M = 0.3, 0.4, 0.5


def floor_parts(features: DataFrame, is_walkway: Column, is_transit: Column) -> DataFrame:
    """(ordinal, part, ring, x, y) of each floor: areas of walkways, obstacles, and locks at openings and in transit units.

    Features are (ordinal, feature_type, category, ring, x, y) with a centre (x, y); a unit that is neither walkway nor transit, a fixture
    and a kiosk are obstacles.  Floors with neither area nor lock are left out.
    """
    kind = F.col("feature_type")
    part = (
        F.when((kind == "unit") & F.coalesce(is_walkway, F.lit(False)), "area")
        .when((kind == "unit") & F.coalesce(is_transit, F.lit(False)), "lock")
        .when(kind.isin("unit", "fixture", "kiosk"), "obstacle")
        .when(kind == "opening", "lock")
    )
    d = features.withColumn("part", part).filter("part is not null")
    some = d.filter("part <> 'obstacle'").select("ordinal").distinct()
    lock = F.col("part") == "lock"
    return d.join(some, "ordinal", "left_semi").select("ordinal", "part", F.when(~lock, F.col("ring")).alias("ring"), F.when(lock, F.col("x")).alias("x"), F.when(lock, F.col("y")).alias("y"))


def in_ring(ring: list, x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def ring_distance(ring: list, x: float, y: float) -> float:
    best = float("inf")
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / size)) if size else 0.0
        best = min(best, ((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) ** 0.5)
    return best


class _Near:
    """Rings or points by square cells of their bounds, so that a place meets those around it alone."""

    def __init__(self, things: list, bounds: Callable[[object], Box], rim: float, cell: float = 4.0):
        self.cell, self.at, self.wide = cell, {}, []
        for t in things:
            w, s, e, n = bounds(t)
            if not all(map(math.isfinite, (w, s, e, n))):
                continue  # nothing is inside or near
            x0, y0, x1, y1 = (math.floor(v / cell) for v in (w - rim, s - rim, e + rim, n + rim))
            if (x1 - x0 + 1) * (y1 - y0 + 1) > 4096:  # a large one is looked at everywhere
                self.wide.append(t)
                continue
            for i in range(x0, x1 + 1):
                for j in range(y0, y1 + 1):
                    self.at.setdefault((i, j), []).append(t)

    def __call__(self, x: float, y: float) -> list:
        if not (math.isfinite(x) and math.isfinite(y)):
            return []
        own = self.at.get((math.floor(x / self.cell), math.floor(y / self.cell)), [])
        return own + self.wide if self.wide else own


def _bounds(ring: list) -> Box:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return (min(xs), min(ys), max(xs), max(ys)) if ring else (math.nan,) * 4


def on_floor(areas: list | Callable, obstacles: list | Callable, x: float, y: float) -> bool:
    """Inside an area or at most OUTSIDE_M beside it, and inside no obstacle; both are rings, or give those around a place."""
    here = lambda of: of(x, y) if callable(of) else of
    return not any(in_ring(o, x, y) for o in here(obstacles)) and any(in_ring(a, x, y) or ring_distance(a, x, y) <= OUTSIDE_M for a in here(areas))


def passes(points: list, i: int, j: int, areas: list | Callable, obstacles: list | Callable, locks: list | Callable) -> bool:
    """Whether the chord from point i to point j may stand for all points between."""
    for x, y in points[i + 1 : j]:
        if any(((x - lx) ** 2 + (y - ly) ** 2) ** 0.5 < LOCK_M for lx, ly in (locks(x, y) if callable(locks) else locks)):
            return False
    (ax, ay), (bx, by) = points[i], points[j]
    n = max(1, math.ceil(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 / SAMPLE_M))
    return all(on_floor(areas, obstacles, ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(n + 1))


def smoothed(points: list, areas: list, obstacles: list, locks: list) -> list[int]:
    """The places of the points that stay: from each the farthest that a chord may reach, else the next one; a point near a lock stays."""
    area, obstacle = _Near(areas, _bounds, 2 * OUTSIDE_M), _Near(obstacles, _bounds, OUTSIDE_M)
    lock = _Near(locks, lambda p: (p[0], p[1], p[0], p[1]), 2 * LOCK_M)
    held = [any(((x - lx) ** 2 + (y - ly) ** 2) ** 0.5 < LOCK_M for lx, ly in lock(x, y)) for x, y in points]
    kept, at = [0], 0
    while at < len(points) - 1:
        last = next((j for j in range(at + 1, len(points)) if held[j]), len(points) - 1)  # no chord leaves this one out
        at = next((j for j in range(last, at + 1, -1) if passes(points, at, j, area, obstacle, [])), at + 1)
        kept.append(at)
    return kept


def smooth_on_floors(routes: DataFrame, parts: DataFrame, per_slice: int = 16) -> DataFrame:
    """(route_id, segment, ordinal, n_points, points) of route segments (route_id, segment, ordinal, points), points an array of (x, y) in metres.

    Segments of a floor without parts stay as they are.  A chord lies in its segment's bounds, so a segment meets the parts
    that reach into these alone, in grid cells; a pair counts in the first cell that both share.
    """
    ship(routes.sparkSession)
    rim = 2 * max(OUTSIDE_M, LOCK_M)
    edges = ("west", "south", "east", "north")
    finite = lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    ends = lambda a: {n: f(F.transform(a, lambda p: p[c])) for n, f, c in zip(edges, (F.array_min, F.array_min, F.array_max, F.array_max), "xyxy", strict=True)}  # noqa: B023, E731
    known = parts.select("ordinal").distinct().withColumn("_known", F.lit(True))
    routes = cut(routes.select("route_id", "segment", "ordinal", "points").withColumn("_id", F.monotonically_increasing_id()).withColumns(ends(F.filter("points", finite))))
    spot = F.array(F.struct("x", "y"))
    floor = parts.select("ordinal", "part", F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    floor = cut(floor.withColumns(ends(F.filter(F.coalesce("ring", spot), finite))))
    widest = [d.agg(F.max(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")))).first()[0] or 0.0 for d in (routes, floor)]
    cell = max(16.0, max(widest) / 64)
    reach = lambda lo, hi, pad: F.sequence(F.floor((F.col(lo) - pad) / cell), F.floor((F.col(hi) + pad) / cell))
    spread = lambda d, pad: d.filter("west is not null").withColumn("_cx", F.explode(reach("west", "east", pad))).withColumn("_cy", F.explode(reach("south", "north", pad)))
    a = spread(routes.select("_id", "ordinal", *edges), rim).select("_id", "ordinal", "_cx", "_cy", *[F.col(c).alias(f"_{c}") for c in edges])
    low = lambda c: F.floor((F.col(f"_{c}") - rim) / cell)
    own = [F.col(k) == F.greatest(low(c), F.floor(F.col(c) / cell)) for k, c in (("_cx", "west"), ("_cy", "south"))]
    near = spread(floor, 0.0).join(a, ["ordinal", "_cx", "_cy"]).filter(own[0] & own[1]).select(F.col("_id").alias("_of"), "part", F.transform("ring", lambda p: F.array(p["x"], p["y"])).alias("ring"), "x", "y")
    slices = max(1, -(-routes.count() // per_slice))
    tasks = min(slices, 2000)  # segments are few bytes and much work, so the planner would put them into one task
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)).cast("int")
    dealt = routes.drop(*edges).join(known, "ordinal", "left").withColumn("_s", deal("_id"))
    near = near.withColumn("_t", deal("_of"))
    kind = lambda c: routes.schema[c].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = dict(iter(right.groupby("_of")))
        out = []
        for r in left.itertuples(index=False):
            points = [(p["x"], p["y"]) for p in r.points]
            kept = list(range(len(points)))
            if r[left.columns.get_loc("_known")] is True:
                some = of.get(r[left.columns.get_loc("_id")], right.iloc[:0])
                rings = {k: [[tuple(p) for p in ring] for ring in some.loc[some["part"] == k, "ring"]] for k in ("area", "obstacle")}
                kept = smoothed(points, rings["area"], rings["obstacle"], list(some.loc[some["part"] == "lock", ["x", "y"]].itertuples(index=False, name=None)))
            out.append((r.route_id, r.segment, r.ordinal, len(points), [{"x": points[k][0], "y": points[k][1]} for k in kept]))
        return pd.DataFrame(out, columns=["route_id", "segment", "ordinal", "n_points", "points"])

    schema = f"route_id {kind('route_id')}, segment int, ordinal {kind('ordinal')}, n_points int, points array<struct<x: double, y: double>>"
    return dealt.repartition(tasks, "_s").groupBy("_s").cogroup(near.repartition(tasks, "_t").groupBy("_t")).applyInPandas(run, schema)


#: Fixed value: a point of a route that is nearer to the boundary of an area hugs the wall.
NEAR_WALL_M = 0.6


def near_walls(points: DataFrame, parts: DataFrame, key: list[str], most: float = NEAR_WALL_M, cell: float = 4.0) -> DataFrame:
    """The keys of the points (key, ordinal, x, y) less than ``most`` from the boundary of an area of their floor, and not within LOCK_M of a lock.

    Sides of the areas' rings are sent to the cells that they reach into and those around, locks to the nine around theirs.
    """
    if cell < max(most, LOCK_M):
        raise ValueError(f"cells are at least {max(most, LOCK_M)} m wide")
    n = F.size("ring")
    side = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col("ring"), i).alias("p"), F.get(F.col("ring"), (i + 1) % n).alias("q")))
    sides = parts.filter("part = 'area'").filter(n > 1).select("ordinal", F.explode(side).alias("s")).select("ordinal", *[F.col(f"s.{e}.{c}").alias(f"{c}{i}") for i, e in ((1, "p"), (2, "q")) for c in "xy"])
    sides = sides.withColumn("_c", F.explode(cells_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), cell, 1)))
    at = lambda i=0, j=0: F.struct((F.floor(F.col("x") / cell) + i).alias("x"), (F.floor(F.col("y") / cell) + j).alias("y"))
    locks = parts.filter("part = 'lock'").select("ordinal", F.explode(F.array(*[at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_c"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    here = points.select(*key, "ordinal", "x", "y").withColumn("_c", at())
    apart = lambda a, b: F.sqrt((F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b))
    met = here.join(sides, ["ordinal", "_c"]).withColumn("near", closest_point(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))))
    walled = met.filter(apart(F.col("near.x"), F.col("near.y")) < most).select(*key).distinct()
    exempt = here.join(locks, ["ordinal", "_c"]).filter(apart(F.col("lx"), F.col("ly")) < LOCK_M).select(*key).distinct()
    return walled.join(exempt, key, "left_anti")

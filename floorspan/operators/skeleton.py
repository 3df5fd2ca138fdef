"""An approximate middle line of walkable areas, on a raster.

Boxes of a floor are drawn on a grid, obstacles are taken out, and every free cell gets its distance to the
nearest wall.  Cells that lie on a ridge of the distance become nodes; neighbouring ones are joined.  Spurs, straightening
and doorways of a vector skeleton are left out.

A floor is cut into tiles of the grid.  A tile is drawn with a margin around it; where a distance could come from beyond the margin,
the tile is drawn again with a wider one, so the result is that of the whole grid and a worker holds a few tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.session import cut, ship


#: Cells of a tile's side, and of the first margin around it.
TILE, MARGIN = 1024, 64


def raster(free: np.ndarray, blocked: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The free cells of a grid with its cells' centres; boxes are rows (west, south, east, north)."""
    grid = np.zeros((len(y), len(x)), dtype=bool)
    for boxes, value in ((free, True), (blocked, False)):
        for w, s, e, n in boxes:
            grid[np.searchsorted(y, s) : np.searchsorted(y, n, "right"), np.searchsorted(x, w) : np.searchsorted(x, e, "right")] = value
    return grid


def wall_distance(grid: np.ndarray, open_sides: tuple[bool, bool, bool, bool] = (False,) * 4, most: int | None = None) -> np.ndarray:
    """Steps of each cell to the nearest wall, diagonals counting one, ``most`` at most: the grid is worn off layer by layer.

    Beyond the sides (west, south, east, north) are walls, but beyond open ones nothing is known, and they wear nothing off.
    """
    west, south, east, north = open_sides
    p = np.zeros((grid.shape[0] + 2, grid.shape[1] + 2), dtype=bool)
    p[0, :], p[-1, :] = south, north
    p[1:-1, 1:-1] = grid
    p[:, 0] &= west  # a corner is open where both of its sides are
    p[:, -1] &= east
    p[1:-1, 0], p[1:-1, -1] = west, east
    out, flat, width = np.zeros(p.shape, dtype=np.int32), p.reshape(-1), p.shape[1]
    inner = np.zeros(p.shape, dtype=bool)
    inner[1:-1, 1:-1] = True
    at, steps = np.flatnonzero(flat & inner.reshape(-1)), 0
    while len(at) and (most is None or steps < most):
        out.reshape(-1)[at] += 1
        steps += 1
        stay = np.logical_and.reduce([flat[at + i * width + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        flat[at[~stay]] = False
        at = at[stay]
    return out[1:-1, 1:-1]


def ridge(distance: np.ndarray, least: int) -> np.ndarray:
    """Cells at least ``least`` from walls that no two opposite neighbours both exceed, and that exceed or equal one pair of them."""
    p = np.pad(distance, 1)
    rows, cols = np.nonzero(distance >= least)
    here = distance[rows, cols]
    at = lambda i, j: p[rows + 1 + i, cols + 1 + j]
    tops = [(here >= at(i, j)) & (here >= at(-i, -j)) & ((here > at(i, j)) | (here > at(-i, -j))) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))]
    out = np.zeros(distance.shape, dtype=bool)
    out[rows, cols] = np.logical_or.reduce(tops)
    return out


def skeletons(areas: DataFrame, key: str = "level_id", cell: float = 0.5, clearance: float = 0.4, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """(key, node, x, y, clearance, right, up): ridge nodes of each key's boxes (x, y, w, h in metres, free) and their neighbours' ids."""
    ship(areas.sparkSession)
    kind = areas.schema[key].dataType.simpleString()
    columns = [key, "node", "x", "y", "clearance", "right", "up", "tr", "tc"]
    c = F.col
    boxes = cut(areas.select(key, *[c(k).cast("double").alias(k) for k in "xywh"], "free").select(key, c("x").alias("west"), c("y").alias("south"), (c("x") + c("w")).alias("east"), (c("y") + c("h")).alias("north"), "free"))
    own = boxes.filter("free").groupBy(key).agg((F.min("west") - cell).alias("_w"), (F.min("south") - cell).alias("_s"), F.max("east").alias("_e"), F.max("north").alias("_n"))
    own = cut(own.select(c(key).alias("_k"), "_w", "_s", (F.ceil((c("_e") - c("_w")) / cell) + 2).alias("_cols"), (F.ceil((c("_n") - c("_s")) / cell) + 2).alias("_rows")))
    tiles = own.agg(F.sum(F.ceil(c("_rows") / tile) * F.ceil(c("_cols") / tile))).first()[0] or 1
    tasks = int(min(2000, -(-tiles // 8)))  # boxes are few bytes and much work, so the planner would put them into one task
    placed = boxes.join(own, c(key).eqNullSafe(c("_k"))).drop("_k")

    def spread(wide: int) -> DataFrame:
        """The boxes of each tile with a margin; a cell more on each side, as the bounds are rounded."""
        reach = lambda lo, hi, o, n: F.sequence(
            F.greatest(F.lit(0), F.floor((F.floor((c(lo) - c(o)) / cell) - 1 - wide) / tile)), F.least(F.floor((c(n) - 1) / tile), F.floor((F.floor((c(hi) - c(o)) / cell) + 1 + wide) / tile))
        )
        near = placed.filter(f"east >= _w - {wide + 2} * {cell} and north >= _s - {wide + 2} * {cell} and west <= _w + (_cols + {wide + 2}) * {cell} and south <= _s + (_rows + {wide + 2}) * {cell} and west <= east and south <= north")
        return near.withColumn("tr", F.explode(reach("south", "north", "_s", "_rows"))).withColumn("tc", F.explode(reach("west", "east", "_w", "_cols")))

    def drawn(k: tuple, df: pd.DataFrame, wide: int) -> pd.DataFrame:
        none = pd.DataFrame({n: pd.Series(dtype=object if n == key else "float64" if n in ("x", "y", "clearance") else "Int64") for n in columns})
        tr, tc = int(k[1]), int(k[2])
        edges, is_free = df[["west", "south", "east", "north"]].to_numpy(dtype=float), df["free"].to_numpy(dtype=bool)
        if not is_free.any():
            return none
        west, south, width, height = (df[n].iloc[0] for n in ("_w", "_s", "_cols", "_rows"))
        width, height = int(width), int(height)
        r0, r1, c0, c1 = max(0, tr * tile - wide), min(height, (tr + 1) * tile + wide), max(0, tc * tile - wide), min(width, (tc + 1) * tile + wide)
        grid = raster(edges[is_free], edges[~is_free], west + (np.arange(c0, c1) + 0.5) * cell, south + (np.arange(r0, r1) + 0.5) * cell)
        distance = wall_distance(grid, (c0 > 0, r0 > 0, c1 < width, r1 < height), wide + 1)
        a0, a1, b0, b1 = tr * tile - r0, min((tr + 1) * tile, height) - r0, tc * tile - c0, min((tc + 1) * tile, width) - c0  # the tile in its window
        if distance[max(0, a0 - 2) : a1 + 2, max(0, b0 - 2) : b1 + 2].max(initial=0) > wide - 2:
            out = pd.DataFrame([(k[0], None, 0.0, 0.0, 0.0, None, None, tr, tc)], columns=columns)
            return out.astype({n: "Int64" for n in ("node", "right", "up")})
        on = ridge(distance, max(1, int(np.ceil(clearance / cell))))
        rows, cols = np.nonzero(on[a0:a1, b0:b1])
        rows, cols = rows + a0, cols + b0
        on = np.pad(on, ((0, 1), (0, 1)))
        node = (rows + r0) * width + cols + c0
        out = pd.DataFrame({key: k[0], "node": node, "x": west + (cols + c0 + 0.5) * cell, "y": south + (rows + r0 + 0.5) * cell, "clearance": distance[rows, cols] * cell})
        for n, i, j in (("right", 0, 1), ("up", 1, 0)):
            out[n] = pd.Series(node + i * width + j, dtype="Int64").where(on[rows + i, cols + j])
        out["tr"], out["tc"] = tr, tc
        return out[columns]

    schema = f"{key} {kind}, node long, x double, y double, clearance double, right long, up long, tr long, tc long"
    def draw(wide: int):
        def run(k: tuple, df: pd.DataFrame) -> pd.DataFrame:
            return drawn(k, df, wide)

        return run

    wide, todo, done = margin, None, None
    while True:
        parts = spread(wide)
        if todo is not None:
            parts = parts.join(todo.withColumnRenamed(key, "_t"), [c(key).eqNullSafe(c("_t")), *[parts[n] == todo[n] for n in ("tr", "tc")]], "left_semi")
        found = cut(parts.repartition(tasks, key, "tr", "tc").groupBy(key, "tr", "tc").applyInPandas(draw(wide), schema))
        nodes = found.filter("node is not null").drop("tr", "tc")
        done = nodes if done is None else done.union(nodes)
        todo = found.filter("node is null").select(key, "tr", "tc")
        if todo.isEmpty():
            return done
        wide *= 4

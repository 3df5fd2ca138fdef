"""Spatial joins, clusters and statistics over columns of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspan.operators import ranges


def range_join(points: DataFrame, boxes: DataFrame, x: Column, y: Column, box: list[Column], cell: float, group: str) -> DataFrame:
    """Points strictly inside boxes (west, south, east, north) of the same group.

    A box is sent to the grid cells that it touches and a point to its own, so that they meet in an equi-join.
    """
    west, south, east, north = box
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    spread = boxes.withColumns({"_cx": F.explode(cells(west, east))}).withColumn("_cy", F.explode(cells(south, north)))
    own = points.withColumns({"_cx": F.floor(x / cell), "_cy": F.floor(y / cell)})
    return own.join(spread, ["_cx", "_cy", group]).filter((x > west) & (x < east) & (y > south) & (y < north)).drop("_cx", "_cy")


def bounds(df: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def padded(df: DataFrame, pad: float = 1e-6) -> DataFrame:
    """Bounds whose zero-width sides are widened."""
    thin_x, thin_y = F.col("west") == F.col("east"), F.col("south") == F.col("north")
    return df.withColumns(
        {
            "west": F.when(thin_x, F.col("west") - pad).otherwise(F.col("west")),
            "east": F.when(thin_x, F.col("east") + pad).otherwise(F.col("east")),
            "south": F.when(thin_y, F.col("south") - pad).otherwise(F.col("south")),
            "north": F.when(thin_y, F.col("north") + pad).otherwise(F.col("north")),
        }
    )


def residual_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank percentiles and the maximum, null for a group without values."""
    sums = df.groupBy(F.col(key).alias("_k")).agg(F.count(value).alias("n"), F.max(value).alias("worst"))
    found = ranges.percentiles(df, [key], value, {"p50": "0.5", "p90": "0.9"})
    return sums.join(found, F.col("_k").eqNullSafe(F.col(key)), "left").select(F.col("_k").alias(key), "n", "p50", "p90", "worst")


def trusted_median(df: DataFrame, key: str, value: str, least: int = 3, spread: float = 1.0) -> DataFrame:
    """The median of groups with enough values that lie close together, else null."""
    ok = (F.count(value) >= least) & (F.max(value) - F.min(value) <= spread)
    sums = df.groupBy(F.col(key).alias("_k")).agg(ok.alias("_ok"))
    found = ranges.percentiles(df, [key], value, middle="median")
    return sums.join(found, F.col("_k").eqNullSafe(F.col(key)), "left").select(F.col("_k").alias(key), F.when(F.col("_ok"), F.col("median")).alias("median"))


def weighted_mode(df: DataFrame, key: str, value: Column, weight: Column, width: float) -> DataFrame:
    """The value bin of the greatest total weight, the lower of equals."""
    bins = df.groupBy(F.col(key), F.floor(value / width).alias("bin")).agg(F.round(F.sum(weight), 6).alias("weight"))
    return bins.groupBy(key).agg(F.max_by("bin", F.struct("weight", (-F.col("bin")).alias("low"))).alias("bin"))


def clusters(df: DataFrame, x: str, y: str, dx: str, dy: str, cell: float, least: int, shift: float) -> DataFrame:
    """Grid cells with enough samples whose median offset is longer than ``shift``."""
    cells = df.groupBy(F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy")).agg(F.count("*").alias("n"), F.median(dx).alias("mx"), F.median(dy).alias("my"))
    return cells.filter((F.col("n") >= least) & (F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")) > shift))


def boundary_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Undirected edges (a, b) that occur once within the keys."""
    return edges.groupBy(*keys, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def monotone(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value falls below the one before them."""
    return ranges.before(df, [key], [order], value, "before").filter(F.col(value) < F.col("before"))

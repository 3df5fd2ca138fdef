"""Joins, sets, ordering and grouping shapes that the review, search and import data need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.session import cut


def latest_per(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The named columns of each key's row of the highest order; one aggregation, no sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_x")).select(key, "_x.*")


#: Durations that an estimate goes by, and their nearest-rank percentile.
RECENT, RANK = 20, 0.75


def expected_seconds(groups: DataFrame, durations: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, seconds, from_all) of each group: the percentile of its RECENT last durations, else of the last of all; null without any."""
    latest = [F.col(o).desc() for o in order]
    at = F.expr(f"percentile_disc({RANK}) WITHIN GROUP (ORDER BY {value})")  # of RECENT values at most
    own = durations.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*latest))).filter(F.col("_k") <= RECENT).groupBy(key).agg(at.alias("_own"))
    all_ = durations.orderBy(*latest).limit(RECENT).agg(at.alias("_all"))
    d = groups.select(key).join(own, key, "left").join(F.broadcast(all_))  # one row
    seconds = F.coalesce("_own", "_all")
    return d.select(key, F.greatest(F.lit(1), F.round(seconds)).cast("long").alias("seconds"), F.col("_own").isNull().alias("from_all"))


def missing(needed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return needed.join(present, key, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def first_of_chain(df: DataFrame, key: str, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Left joins in order of preference: ``steps`` are (lookup, column of df, column of the lookup's value); adds ``resolved``."""
    found = []
    for i, (lookup, on, value) in enumerate(steps):
        small = lookup.select(F.col(lookup.columns[0]).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.join(small, F.col(on) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_v{i}"))
    return df.withColumn("resolved", F.coalesce(*found)).drop(*[f"_v{i}" for i in range(len(steps))])


def grid_pairs(points: DataFrame, key: str, x: str, y: str, cell: float, near: Column, group: str | None = None) -> DataFrame:
    """Pairs (a, b), a before b, of points in neighbouring cells that ``near`` (over a.* and b.*) accepts.

    A point is sent to the nine cells around it, so pairs meet in an equi-join; ``near`` must not hold beyond a cell's width.
    """
    cx, cy = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    own = points.withColumns({"_cx": cx, "_cy": cy})
    around = [F.struct((F.col("_cx") + i).alias("x"), (F.col("_cy") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = own.withColumn("_c", F.explode(F.array(*around))).withColumns({"_cx": F.col("_c.x"), "_cy": F.col("_c.y")}).drop("_c")
    a, b = own.alias("a"), spread.alias("b")
    on = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    if group:
        on = on & (F.col(f"a.{group}") == F.col(f"b.{group}"))
    return a.join(b, on & near).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def nearest_on_grid(queries: DataFrame, targets: DataFrame, on: str, query_key: str, target_key: str, cell: float, k: int = 1) -> DataFrame:
    """The k nearest targets (lon, lat) of each query (x, y), in degrees, within the same ``on``; ties go to the lower key.

    Each round a query meets the targets of the nine cells around it.  It is done once its k-th distance is less than
    that to the block's rim; the others go on with cells four times as wide, at last as wide as all points together.
    """
    targets = cut(targets.select(on, target_key, "lon", "lat"))
    left = cut(queries.select(on, query_key, "x", "y"))
    ends = [(F.min(c), F.max(c)) for c in ("x", "y", "lon", "lat")]
    q, t = left.agg(*ends[0], *ends[1]).first(), targets.agg(*ends[2], *ends[3]).first()
    lows, highs = [(q[i], t[i]) for i in (0, 2)], [(q[i], t[i]) for i in (1, 3)]
    extent = 0.0 if None in (*q, *t) else max(max(h) - min(lo) for lo, h in zip(lows, highs, strict=True))
    done = None
    while True:
        at = lambda x, y, i=0, j=0: F.struct((F.floor(F.col(x) / cell) + i).alias("x"), (F.floor(F.col(y) / cell) + j).alias("y"))  # noqa: B023, E731
        spread = targets.withColumn("_c", F.explode(F.array(*[at("lon", "lat", i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
        pairs = left.withColumn("_c", at("x", "y")).join(spread, [on, "_c"]).withColumn("distance", geo.haversine(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")))
        # a cell at least lies between a query and the rim: over a parallel, or over a meridian
        rim = 0.999 * geo.EARTH_M * F.least(F.lit(math.radians(cell)), F.asin(F.cos(F.radians("y")) * math.sin(math.radians(min(cell, 90.0)))))
        w = Window.partitionBy(query_key).orderBy("distance", target_key)
        ranked = pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
        last = cell > extent
        if not last:
            ranked = ranked.withColumn("_far", F.max(F.when(F.col("place") == k, F.col("distance"))).over(Window.partitionBy(query_key)))
            ranked = ranked.filter(F.col("_far") < rim)
        found = cut(ranked.select(query_key, target_key, "distance", "place"))
        done = found if done is None else done.union(found)
        if last:
            return done
        left = cut(left.join(found.select(query_key), query_key, "left_anti"))
        if left.isEmpty():
            return done
        cell *= 4


def band(left: DataFrame, right: DataFrame, at: str, to: str, width: float) -> DataFrame:
    """Rows whose values differ by at most ``width``: bands of that width meet in an equi-join with their neighbours."""
    cell = F.floor(F.col(at) / width)
    spread = left.withColumn("_b", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = right.withColumn("_b", F.floor(F.col(to) / width))
    return spread.join(other, "_b").filter(F.abs(F.col(at) - F.col(to)) <= width).drop("_b")


#: Cells to a band's width, where whole cells inside the band are counted and not compared.
BAND_CELLS = 128


def nearest_in_band(left: DataFrame, right: DataFrame, key: str, other: str, at: str, to: str, width: float) -> DataFrame:
    """(key, other, n): of the right rows whose value differs by at most ``width``, the nearest (of equals the lowest) and their number.

    The right values are counted by value and by narrow cells.  Cells wholly inside the band of all values of a left cell enter by their
    counts, their highest below and their lowest above; only the left cell's own and those around the band's two edges are compared.
    """
    k, step = BAND_CELLS, width / BAND_CELLS
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    values = right.filter(finite(to)).groupBy(F.col(to).alias("_v")).agg(F.count("*").alias("_n"), F.min(other).alias("_o")).withColumn("_c", F.floor(F.col("_v") / step))
    cells = values.groupBy("_c").agg(F.sum("_n").alias("_n"), F.max(F.struct("_v", "_o")).alias("_top"), F.min(F.struct("_v", "_o")).alias("_low"))
    from_cell = lambda shifts: F.explode(F.array(*(F.col("_c") - j for j in shifts)))
    inner = [j for j in range(2 - k, k - 1) if j]
    counted = (
        cells.withColumn("_at", from_cell(inner))
        .groupBy("_at")
        .agg(F.sum("_n").alias("_inner"), F.max(F.when(F.col("_c") < F.col("_at"), F.col("_top"))).alias("_below"), F.min(F.when(F.col("_c") > F.col("_at"), F.col("_low"))).alias("_above"))
    )
    here = left.filter(finite(at)).select(key, at).withColumn("_at", F.floor(F.col(at) / step))
    met = here.join(values.withColumn("_at", from_cell([0, *(s * j for j in range(k - 1, k + 2) for s in (-1, 1))])), "_at").filter(F.abs(F.col(at) - F.col("_v")) <= width)
    near = lambda v, o: F.struct(F.abs(F.col(at) - F.col(v)).alias("d"), F.col(o).alias("o"))
    compared = met.select(key, near("_v", "_o").alias("_x"), "_n")
    known = here.join(counted, "_at")
    best = F.least(F.when(F.col("_below").isNotNull(), near("_below._v", "_below._o")), F.when(F.col("_above").isNotNull(), near("_above._v", "_above._o")))
    found = compared.union(known.select(key, best.alias("_x"), F.col("_inner").alias("_n"))).groupBy(key).agg(F.min("_x").alias("_x"), F.sum("_n").alias("n"))
    return found.select(key, F.col("_x.o").alias(other), "n")


def difference(before: DataFrame, after: DataFrame, key: str, changed: Column) -> DataFrame:
    """(added, removed, changed) counts of two versions of rows; ``changed`` is over b.* and a.*."""
    both = before.withColumn("_in", F.lit(True)).alias("b").join(after.withColumn("_in", F.lit(True)).alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    return both.agg(
        F.count_if(F.col("b._in").isNull()).alias("added"), F.count_if(F.col("a._in").isNull()).alias("removed"), F.count_if(F.col("b._in").isNotNull() & F.col("a._in").isNotNull() & changed).alias("changed")
    )


def upsert(old: DataFrame, new: DataFrame, key: str, may_replace: Column | None = None) -> DataFrame:
    """New rows take the place of old ones with the same key where ``may_replace`` (over the old row) holds, else the old stay."""
    frozen = old if may_replace is None else old.filter(~may_replace)
    fresh = new if may_replace is None else new.join(frozen, key, "left_anti")
    return old.join(fresh, key, "left_anti").unionByName(fresh)


def mode_first_to_reach(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each group's most common value; of equals, the one that reached the count first in the order."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.max(order).alias("last"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", (-F.col("last")).alias("early"))).alias(value))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Numbers the runs of equal values in each key's order (column run)."""
    w = Window.partitionBy(key).orderBy(order)
    begins = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    return df.withColumn("_b", begins).withColumn("run", F.sum("_b").over(w)).drop("_b")


def search_score(text: str) -> Column:
    """500 or 450 for the label or alternative itself, 400/350 at its start, 300/250 inside, 200 in category or type, else 0."""
    label, alt = F.col("label"), F.col("alt_label")
    return (
        F.when(label == text, 500)
        .when(alt == text, 450)
        .when(label.startswith(text), 400)
        .when(alt.startswith(text), 350)
        .when(label.contains(text), 300)
        .when(alt.contains(text), 250)
        .when(F.coalesce(F.col("category").contains(text), F.lit(False)) | F.col("feature_type").contains(text), 200)
        .otherwise(0)
    )


def in_category(category: str) -> Column:
    kind = F.col("feature_type")
    if category == "gates":
        return (kind == "opening") & F.coalesce(F.col("category").startswith("pedestrian"), F.lit(False))
    return {"all": F.lit(True), "shops": kind == "occupant", "facilities": kind.isin("amenity", "kiosk")}[category]


def search(entries: DataFrame, text: str, category: str = "all", level: str | None = None, most: int = 50) -> DataFrame:
    """The best entries for a text; for an empty one, a category's entries, those of the level first."""
    found = entries.filter(in_category(category))
    here = F.coalesce(F.col("level_id") == level, F.lit(False))
    if not text:
        rows = found.filter(F.lit(category != "all")).withColumn("score", F.lit(0))
        return rows.orderBy(F.when(here, 0).otherwise(1), "label", "feature_id").limit(most).select("feature_id", "label", "score")
    rows = found.withColumn("score", search_score(text)).filter("score > 0").withColumn("score", F.col("score") + F.when(here, 20).otherwise(0))
    return rows.orderBy(F.desc("score"), "label", "feature_id").limit(most).select("feature_id", "label", "score")

"""Walls from the boundaries of units, openings in them, and the panels that are left, in whole millimetres.

Comparisons of distances are exact: squared distances are fractions over a wall's squared length, compared by
cross-multiplication in 38 digits, which is room for walls and openings of up to a kilometre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspan.session import cut

#: Fixed values, in millimetres: nominal heights of walls and doors, and how far an opening may be off its wall.
WALL_MM, DOOR_MM, TOLERANCE_MM = 3000, 2400, 200
KEY = ["level_id", "ax", "ay", "cx", "cy"]


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def sides(units: DataFrame) -> DataFrame:
    """(unit_id, KEY, height, platform): each side of the units' rings (array of x, y), from its lesser end to its greater."""
    n = F.size("ring")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_sort(F.array(F.get(F.col("ring"), i), F.get(F.col("ring"), (i + 1) % n))))
    d = units.filter(n > 1).withColumn("s", F.explode(pair))
    ends = [F.col("s")[i][c].alias(f"{k}{c}") for i, k in ((0, "a"), (1, "c")) for c in "xy"]
    return d.select("unit_id", "level_id", *ends, F.coalesce("height", F.lit(WALL_MM)).cast("long").alias("height"), "platform").filter("ax <> cx or ay <> cy")


def walls(of_units: DataFrame) -> DataFrame:
    """(KEY, height, platform): one wall for each distinct side, as high as the lowest of its units; ``platform`` where all are platforms."""
    return of_units.groupBy(*KEY).agg(F.min("height").alias("height"), F.min("platform").alias("platform"))


def _cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: int, rim: int) -> Column:
    side = lambda p, q: F.sequence(F.floor((F.least(p, q) - rim) / cell), F.floor((F.greatest(p, q) + rim) / cell))
    return F.flatten(F.transform(side(x1, x2), lambda i: F.transform(side(y1, y2), lambda j: F.struct(i.alias("x"), j.alias("y")))))


def candidates(openings: DataFrame, edges: DataFrame, tolerance: int = TOLERANCE_MM, cell: int = 4000) -> DataFrame:
    """Openings (opening_id, level_id, px, py, qx, qy) with the walls that they overlap and whose line both ends are near.

    Adds ``len2``, the ends' projections ``start`` and ``end`` in parts of len2, ``score`` (len2 times the sum of the squared
    distances of both ends from the wall) and ``close``, whether both ends are near the wall itself.  An opening comes as near to
    such a wall as its ends do to the line, so both meet in grid cells.  Stored walls take little room in their files, many
    times more in memory, and a row for each cell: the planner would take them for small, so the join is told to sort.
    """
    c = F.col
    mine = openings.withColumn("_c", F.explode(_cells(c("px"), c("py"), c("qx"), c("qy"), cell, abs(tolerance))))
    theirs = edges.withColumn("_c", F.explode(_cells(c("ax"), c("ay"), c("cx"), c("cy"), cell, 0)))
    d = mine.join(theirs.hint("merge"), ["level_id", "_c"]).drop("_c").dropDuplicates(["opening_id", *KEY])
    d = d.withColumns({"dx": c("cx") - c("ax"), "dy": c("cy") - c("ay")}).withColumn("len2", c("dx") * c("dx") + c("dy") * c("dy"))
    for k in "pq":
        x, y = c(f"{k}x") - c("ax"), c(f"{k}y") - c("ay")
        back = (c(f"{k}x") - c("cx"), c(f"{k}y") - c("cy"))
        d = d.withColumns({f"{k}_t": x * c("dx") + y * c("dy"), f"{k}_cross": _wide(x * c("dy") - y * c("dx")), f"{k}_from": _wide(x * x + y * y), f"{k}_back": _wide(back[0] * back[0] + back[1] * back[1])})
        off = F.when(c(f"{k}_t") <= 0, c(f"{k}_from") * _wide(c("len2"))).when(c(f"{k}_t") >= c("len2"), c(f"{k}_back") * _wide(c("len2"))).otherwise(c(f"{k}_cross") * c(f"{k}_cross"))
        d = d.withColumns({f"{k}_off": off, f"{k}_at": F.greatest(F.lit(0), F.least(c("len2"), c(f"{k}_t")))})
    most = _wide(c("len2")) * _wide(F.lit(tolerance * tolerance))
    on_line = (c("p_cross") * c("p_cross") <= most) & (c("q_cross") * c("q_cross") <= most)
    d = d.withColumns({"start": F.least("p_at", "q_at"), "end": F.greatest("p_at", "q_at")}).filter(on_line & (c("start") < c("end")))
    return d.withColumns({"score": c("p_off") + c("q_off"), "close": (c("p_off") <= most) & (c("q_off") <= most)}).select(*openings.columns, *[k for k in KEY if k != "level_id"], "height", "platform", "len2", "start", "end", "score", "close")


def at(a: Column, b: Column, part: Column, whole: Column) -> Column:
    """The coordinate at part / whole of the way from a to b, rounded half away from zero."""
    d = _wide(whole)
    n = F.abs(_wide(b - a)) * _wide(part) + (d - d % 2) / 2
    return a + F.when(b < a, -1).otherwise(1) * ((n - n % d) / d).cast("long")


def host(openings: DataFrame, edges: DataFrame, tolerance: int = TOLERANCE_MM, door: int = DOOR_MM) -> tuple[DataFrame, DataFrame]:
    """The hosted openings, and the cuts that they make.

    An opening's host is the candidate of the least score, of equal ones the least in order; openings without one, or that shrink to
    a point on it, are left out.  It cuts its host, the candidates that it is close to and those on the host's line, and
    is as high as a door or the lowest of these walls.  The first result is (opening_id, level_id, ax, ay, cx, cy, height, x1, y1, x2, y2,
    n_walls), snapped to the host; the second is (KEY, opening_id, start, end, high) of each wall cut.
    """
    c = F.col
    found = cut(candidates(openings, edges, tolerance))
    key = F.struct("ax", "ay", "cx", "cy")
    own = found.groupBy("opening_id").agg(F.collect_list(F.struct("score", "len2", key.alias("k"), "start", "end")).alias("all"))  # the walls within reach of one opening
    less = lambda a, b: (a["score"] * _wide(b["len2"]) < b["score"] * _wide(a["len2"])) | ((a["score"] * _wide(b["len2"]) == b["score"] * _wide(a["len2"])) & (a["k"] < b["k"]))
    best = F.aggregate("all", F.get(c("all"), 0), lambda acc, x: F.when(less(x, acc), x).otherwise(acc))
    own = own.select("opening_id", best.alias("h"))
    snapped = [at(c(f"h.k.a{w}"), c(f"h.k.c{w}"), c(f"h.{p}"), c("h.len2")).alias(f"{w}{i}") for i, p in ((1, "start"), (2, "end")) for w in "xy"]
    own = own.select("opening_id", "h", *snapped).filter("x1 <> x2 or y1 <> y2")
    d = found.join(own.hint("merge"), "opening_id")
    turn = lambda x, y: _wide(c(x) - c("h.k.ax")) * _wide(c("h.k.cy") - c("h.k.ay")) == _wide(c(y) - c("h.k.ay")) * _wide(c("h.k.cx") - c("h.k.ax"))
    d = d.filter(c("close") | (turn("ax", "ay") & turn("cx", "cy")) | (key == c("h.k")))
    low = d.groupBy("opening_id", "level_id").agg(F.min("height").alias("low"), F.count("*").alias("n_walls"), F.first("h").alias("h"), *[F.first(f"{w}{i}").alias(f"{w}{i}") for i in (1, 2) for w in "xy"])
    high = F.greatest(F.lit(0), F.least(F.lit(door).cast("long"), c("low")))
    low = low.withColumn("high", high).filter("high > 0")
    hosted = low.select("opening_id", "level_id", *[c(f"h.k.{k}").alias(k) for k in ("ax", "ay", "cx", "cy")], c("high").alias("height"), "x1", "y1", "x2", "y2", "n_walls")
    return hosted, d.select(*KEY, "opening_id", "start", "end").join(low.select("opening_id", "high"), "opening_id")


def connected_units(cuts: DataFrame, of_units: DataFrame) -> DataFrame:
    """(opening_id, from_unit, to_unit): the first two units at the walls that an opening cuts; the second is null for the outside."""
    pairs = cut(cuts.select("opening_id", *KEY).join(of_units.select("unit_id", *KEY).hint("merge"), KEY).select("opening_id", "unit_id").distinct())
    first = pairs.groupBy("opening_id").agg(F.min("unit_id").alias("from_unit"))
    second = pairs.join(first.hint("merge"), "opening_id").filter("unit_id > from_unit").groupBy("opening_id").agg(F.min("unit_id").alias("to_unit"))
    return first.join(second.hint("merge"), "opening_id", "left")


def panels(edges: DataFrame, cuts: DataFrame, planes: DataFrame) -> DataFrame:
    """(KEY, part, x1, y1, x2, y2, bottom, top): the walls' panels, full ones and headers over openings, by their place along the wall.

    Cuts of equal height merge by a running maximum of their ends.  Their ends divide the wall into spans, each as void as the highest cut
    over it; neighbours of equal void are one panel.  Walls of platforms alone have none.  ``planes`` is (level_id, z).
    """
    c = F.col
    live = edges.filter(~c("platform") & (c("height") > 0)).withColumn("len2", (c("cx") - c("ax")) * (c("cx") - c("ax")) + (c("cy") - c("ay")) * (c("cy") - c("ay")))
    own = cuts.join(live.select(*KEY, "height"), KEY).withColumn("high", F.least("high", "height"))
    order = Window.partitionBy(*KEY, "high").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(before.isNull() | (c("start") > before), 1).otherwise(0)).over(order)
    merged = own.withColumn("run", run).groupBy(*KEY, "high", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    marks = live.select(*KEY, F.explode(F.array(F.lit(0).cast("long"), "len2")).alias("m")).union(merged.select(*KEY, F.explode(F.array("start", "end")))).distinct()
    along = Window.partitionBy(*KEY).orderBy("m")
    marks = marks.select(*KEY, "m", F.row_number().over(along).alias("r"), F.lead("m").over(along).alias("to"))
    place = lambda k: marks.select(*KEY, c("m").alias(k), c("r").alias(f"r_{k}"))
    over = merged.join(place("start"), [*KEY, "start"]).join(place("end"), [*KEY, "end"])
    voids = over.select(*KEY, "high", F.explode(F.sequence(c("r_start"), c("r_end") - 1)).alias("r")).groupBy(*KEY, "r").agg(F.max("high").alias("void"))
    spans = marks.filter("to is not null").join(voids, [*KEY, "r"], "left").withColumn("void", F.coalesce("void", F.lit(0).cast("long")))
    by = Window.partitionBy(*KEY).orderBy("r")
    spans = spans.withColumn("new", F.coalesce((c("void") != F.lag("void").over(by)).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(by))
    whole = spans.groupBy(*KEY, "part").agg(F.min("m").alias("start"), F.max("to").alias("end"), F.first("void").alias("void"))
    d = whole.join(live, KEY).join(planes, "level_id")
    ends = [at(c(f"a{w}"), c(f"c{w}"), c(p), c("len2")).alias(f"{w}{i}") for i, p in ((1, "start"), (2, "end")) for w in "xy"]
    d = d.select(*KEY, c("part").cast("long").alias("part"), *ends, (c("z") + c("void")).alias("bottom"), (c("z") + c("height")).alias("top"))
    return d.filter("(x1 <> x2 or y1 <> y2) and bottom < top")

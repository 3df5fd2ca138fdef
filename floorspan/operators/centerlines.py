"""Networks of middle lines: bridges between parts that abut, and spurs cut off, as rounds of joins.

Nodes are (node_id, floor, x, y) in metres, edges (from_id, to_id) with ends on one floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspan.session import cut, drop

#: Metres that a bridge spans at most, lengths under which a spur goes, and a wedge that narrows by this ratio.
BRIDGE_M, SPUR_M, WEDGE_M, NARROWS = 2.0, 3.0, 8.0, 0.5


def _distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return F.sqrt(dx * dx + dy * dy)


def closest_pairs(nodes: DataFrame, most: float = BRIDGE_M) -> DataFrame:
    """(lo, hi, from_id, to_id, metres, x1, y1, x2, y2): the closest nodes of each two components of a floor that come within ``most``.

    Nodes carry their ``component``.  They meet in grid cells; of equally close pairs the one of the lower ids counts.
    """
    cell = lambda i=0, j=0: F.struct((F.floor(F.col("x") / most) + i).alias("x"), (F.floor(F.col("y") / most) + j).alias("y"))
    own = nodes.select("floor", F.col("node_id").alias("from_id"), F.col("component").alias("ca"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell().alias("cell"))
    around = nodes.select("floor", F.col("node_id").alias("to_id"), F.col("component").alias("cb"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.array(*[cell(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("cell"))
    near = own.join(around, ["floor", "cell"]).filter("from_id < to_id and ca <> cb").withColumn("metres", _distance("a", "b")).filter(F.col("metres") <= most)
    best = F.min(F.struct("metres", "from_id", "to_id", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))).alias("b")
    found = near.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).agg(best)
    return found.select("lo", "hi", "b.from_id", "b.to_id", "b.metres", "b.x1", "b.y1", "b.x2", "b.y2")


def spanning(links: DataFrame) -> DataFrame:
    """The links (lo, hi) between components that are taken when they are gone through in order and each that joins two parts is.

    In each round every part chooses the first link that leads out of it; all chosen ones are taken at once, as the order makes them
    unlike each other, and the parts that they join become one, by pointer doubling.  At least half of the parts go in a round.
    """
    order = F.struct("lo", "hi")
    taken = None
    left = before = cut(links.select(order.alias("k"), F.col("lo").alias("a"), F.col("hi").alias("b")))
    while not left.isEmpty():
        ends = left.select("k", F.col("a").alias("part"), F.col("b").alias("to")).union(left.select("k", F.col("b").alias("part"), F.col("a").alias("to")))
        first = cut(ends.groupBy("part").agg(F.min(F.struct("k", "to")).alias("f")).select("part", F.col("f.k").alias("k"), F.col("f.to").alias("to")))
        chosen = cut(first.select("k").distinct())
        taken = chosen if taken is None else taken.union(chosen)
        # two parts that choose the same link point at each other: the lower one is the root
        back = first.select(F.col("part").alias("to"), F.col("to").alias("back"))
        at = first.join(back, "to").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("root"))
        at = held = cut(at)
        while True:
            ahead = at.select(F.col("part").alias("root"), F.col("root").alias("next"))
            old, held = held, cut(at.join(ahead, "root").select("part", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            drop(old)
            at = held.select("part", "root")
            if held.filter("moved").isEmpty():
                break
        for end in ("a", "b"):
            left = left.join(at.select(F.col("part").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(end, F.coalesce(f"r{end}", end)).drop(f"r{end}")
        left = cut(left.filter("a <> b").select("k", "a", "b"))
        for old in (before, first, held):
            drop(old)
        before = left
    return (links.select(order.alias("k")).limit(0) if taken is None else taken).select("k.lo", "k.hi")


def bridges(nodes: DataFrame, passable: Column | None = None, most: float = BRIDGE_M) -> DataFrame:
    """(from_id, to_id, metres) of the bridges that join components, taken in the order of the components' ids.

    Each two components have one candidate, their closest nodes; ``passable``, over x1, y1, x2, y2, tells whether it may be walked.
    """
    pairs = closest_pairs(nodes, most)
    pairs = cut(pairs if passable is None else pairs.filter(passable))
    return pairs.join(spanning(pairs.select("lo", "hi")), ["lo", "hi"]).select("from_id", "to_id", "metres")


def chain_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_id, to_id, end, metres, steps) of each edge in both directions: where the way over nodes of degree 2 ends that begins with it.

    The rest of each way is known after as many rounds as its length has binary digits: a round goes on from where the way so far
    ends by all that is known of the way from there.  Ways around a ring without any other node have no end.
    """
    place = lambda k: nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    d = edges.select("from_id", "to_id").join(place("from"), "from_id").join(place("to"), "to_id").select("from_id", "to_id", _distance("from", "to").alias("metres"))
    half = cut(d.union(d.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "metres")))
    inner = half.groupBy("from_id").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("from_id").alias("to_id"))
    # the edge that goes on from the end of another, not back
    on = half.join(inner, "to_id").select("from_id", "to_id", "metres")
    after = half.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("then"))
    next_ = on.join(after, "to_id").filter("then <> from_id").select("from_id", "to_id", F.struct(F.col("to_id").alias("a"), F.col("then").alias("b")).alias("next"))
    state = half.join(next_, ["from_id", "to_id"], "left")
    state = cut(state.select("from_id", "to_id", F.col("to_id").alias("end"), "metres", F.lit(1).cast("long").alias("steps"), "next"))
    open_ = -1
    while True:
        now = state.filter("next is not null").count()
        if now in (0, open_):  # those left go around in rings
            return state.select("from_id", "to_id", F.when(F.col("next").isNull(), F.col("end")).alias("end"), "metres", "steps")
        open_ = now
        known = state.select(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")).alias("next"), F.col("end").alias("end2"), F.col("metres").alias("metres2"), F.col("steps").alias("steps2"), F.col("next").alias("next2"))
        new = state.join(known, "next", "left")
        old, state = state, cut(new.select("from_id", "to_id", F.coalesce("end2", "end").alias("end"), (F.col("metres") + F.coalesce("metres2", F.lit(0.0))).alias("metres"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("next2").alias("next")))
        drop(old)


def spurs(nodes: DataFrame, edges: DataFrame, short: float = SPUR_M, wedge: float = WEDGE_M, narrows: float = NARROWS) -> DataFrame:
    """(tip, end, metres, steps, why) of the chains from a leaf that go: ``short`` ones, and ``wedge``s that end at a junction and narrow.

    Nodes carry their ``clearance``, and ``endcap`` where a leaf is the end of a corridor of even width, which is no wedge.
    """
    degree = edges.select(F.col("from_id").alias("id")).union(edges.select(F.col("to_id").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    tips = degree.filter("degree = 1").select(F.col("id").alias("tip"))
    ways = chain_ends(nodes, edges).filter("end is not null").withColumnRenamed("from_id", "tip").join(tips, "tip")
    at = lambda k: nodes.select(F.col("node_id").alias(k), F.col("clearance").alias(f"{k}_clear"), F.col("endcap").alias(f"{k}_cap"))
    d = ways.join(at("tip"), "tip").join(at("end"), "end").join(degree.withColumnRenamed("id", "end"), "end")
    narrow = (F.col("degree") >= 3) & (F.col("metres") < wedge) & (F.col("tip_clear") < F.col("end_clear") * narrows) & ~F.col("tip_cap")
    why = F.when(F.col("metres") < short, "short").when(narrow, "wedge")
    return d.withColumn("why", why).filter("why is not null").select("tip", "end", "metres", "steps", "why")


def pruned(nodes: DataFrame, edges: DataFrame, **limits: float) -> tuple[DataFrame, DataFrame]:
    """The edges without spurs, and the spurs: an edge goes if the way over it, in either direction, ends at the tip of one."""
    gone = cut(spurs(nodes, edges, **limits))
    ways = chain_ends(nodes, edges)
    out = ways.join(gone.select(F.col("tip").alias("end")), "end", "left_semi").select(F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi")).distinct()
    kept = edges.join(out, (F.least("from_id", "to_id") == F.col("lo")) & (F.greatest("from_id", "to_id") == F.col("hi")), "left_anti")
    return kept, gone

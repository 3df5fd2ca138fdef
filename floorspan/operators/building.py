"""Routing graphs from network layers, their export, and what openings and rooms do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspan.functions import floors, geo
from floorspan.operators import graph, ranges
from floorspan.operators.nearest import cells_of, closest_point

#: Keys of edge kinds and of vertical ways, the height of a storey and the speed of walking.
EDGE_KINDS = ("imported", "skeleton", "doorway", "stub", "bridge", "chord", "vertical", "transit_attach")
VERTICALS = ("elevator", "escalator", "stairs")
STOREY_M, WALK_M_PER_S, BOUNDARY_M, ROOM_FACTOR = 4.0, 1.4, 3.0, 3.0


def path_attributes(properties: Column) -> Column:
    """struct(kind, rank, clearance, vertical, direction, barrier, gate, start_minute, end_minute) of a path's JSON properties.

    Values that aren't known count as none.  A path is vertical by kind exactly when it has a vertical category; one
    that breaks this rule has the attributes of an imported path.
    """
    text = lambda k: F.get_json_object(properties, f"$.{k}")
    whole = lambda k: text(k).try_cast("long")
    kind = F.when(text("EDGE_KIND").isin(*EDGE_KINDS), text("EDGE_KIND")).otherwise("imported")
    vertical = F.when(text("TRANSITION_CATEGORY").isin(*VERTICALS), text("TRANSITION_CATEGORY"))
    fits = (kind == "vertical") == vertical.isNotNull()
    rank = F.when(fits & (whole("PATHWAY_RANK") == 2), 2).otherwise(1)
    return F.struct(
        F.when(fits, kind).otherwise("imported").alias("kind"), rank.alias("rank"), F.when(fits, text("CLEARANCE_M").try_cast("double").cast("float").cast("double")).alias("clearance"), F.when(fits, vertical).alias("vertical"),
        F.when(whole("direction") == 1, 1).when(whole("direction") == 2, 2).otherwise(0).alias("direction"), F.coalesce(whole("BARRIER") != 0, F.lit(False)).alias("barrier"), F.coalesce(whole("GATE") != 0, F.lit(False)).alias("gate"),
        F.coalesce(whole("STARTTIME"), F.lit(-1)).cast("int").alias("start_minute"), F.coalesce(whole("ENDTIME"), F.lit(-1)).cast("int").alias("end_minute"),
    )


def build(junctions: DataFrame, paths: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings (code, detail) of a network's layers.

    Junctions are (place, node_id, floor, lon, lat), of equal ids the last counts; paths are (place, from_id, to_id, cost, floor,
    path_id, back_id, line, properties); levels have ordinals.  Two paths that run back over the same ends and name each other are one
    edge, the one with the smaller path_id; others that share their two ids are kept, with a warning.
    """
    placed = junctions.filter("node_id is not null and floor is not null and lon is not null and lat is not null").withColumn("ordinal", floors.label_to_ordinal(F.col("floor")))
    unmapped = placed.filter("ordinal is null").select(F.lit("unmapped_floor").alias("code"), F.concat(F.lit("node "), F.col("node_id").cast("string"), F.lit(" floor "), "floor").alias("detail"))
    nodes = placed.filter("ordinal is not null").groupBy("node_id").agg(F.max_by(F.struct("lon", "lat", "ordinal"), "place").alias("n")).select("node_id", "n.*")
    strange = nodes.join(levels.select("ordinal").distinct(), "ordinal", "left_anti").select(F.lit("unmatched_level").alias("code"), F.concat(F.lit("node ordinal "), F.col("ordinal").cast("string")).alias("detail"))

    own = paths.filter("from_id is not null and to_id is not null and cost is not null")
    name = F.concat(F.lit("edge "), F.col("from_id").cast("string"), F.lit("->"), F.col("to_id").cast("string"))
    lost = graph.dangling(own, nodes).select(F.lit("dangling_edge").alias("code"), name.alias("detail"))
    known = graph.attach_nodes(own, nodes)
    weight = F.col("cost").cast("float").cast("double")
    bad = F.isnan(weight) | (F.abs(weight) == float("inf")) | (weight < 0)
    wrong = known.filter(bad).select(F.lit("invalid_cost").alias("code"), name.alias("detail"))
    inner = geo.inner_points(F.col("line"))
    edges = known.filter(~bad).select(
        "place", "from_id", "to_id", weight.alias("cost"), F.coalesce(floors.label_to_ordinal(F.col("floor")), "from_ordinal").alias("ordinal"), "path_id", "back_id", F.coalesce(inner, F.slice("line", 1, 0)).alias("interior"), path_attributes(F.col("properties")).alias("a")
    ).select("*", "a.*").drop("a")

    with_ids = edges.filter("path_id is not null and back_id is not null")
    paired = pair_paths(with_ids.select("place", "path_id", "back_id", "from_id", "to_id"))
    kept = with_ids.join(paired.select("place"), "place").select(edges.columns).union(edges.filter("path_id is null or back_id is null"))
    clash = paired.filter("clash").select(F.lit("reciprocal_conflict").alias("code"), F.concat(F.lit("edge at "), F.col("slot").cast("string"), F.lit(" shares its ids")).alias("detail"))
    warnings = unmapped.union(lost).union(wrong).union(clash).union(strange)
    return nodes, kept.drop("place", "path_id", "back_id"), warnings


def pair_paths(paths: DataFrame) -> DataFrame:
    """(place, slot, partner, clash) of the paths (place, path_id, back_id, from_id, to_id) that stay when those there and back are paired.

    In the order of ``place``, a path takes the last waiting one that runs back over the same ends and names it (path_id
    and back_id, from_id and to_id swapped), else it waits.  Of a pair the one with the smaller path_id stays, the one that waited if they are
    equal, in the ``slot`` of the one that waited.  One that waits while others have waited under the same two ids is a ``clash``.

    Waiting ones are a stack for each signature, and only one of a signature and its reverse has any: so the running number
    of paths there less those back is the stack's height, a path opens or closes a level by whether the height's size grows, and
    the paths of one level open and close it in turn.
    """
    there = F.struct("path_id", "back_id", "from_id", "to_id")
    back = F.struct(F.col("back_id").alias("path_id"), F.col("path_id").alias("back_id"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    step = F.when(there == back, 0).when(there < back, 1).otherwise(-1).cast("long")
    d = paths.withColumns({"_g": F.least(there, back), "_s": step})
    d = ranges.running(d, ["_g"], ["place"], {"_after": F.col("_s")})
    before = F.col("_after") - F.col("_s")
    # a path that is its own reverse is paired with the next such one
    level = F.when(F.col("_s") == 0, 0).when(F.abs("_after") > F.abs(before), F.col("_after")).otherwise(before)
    d = ranges.number_within(d.withColumn("_level", level), ["_g", "_level"], ["place"], "_n")
    row = F.struct("place", "path_id", "back_id")
    pairs = d.groupBy("_g", "_level", F.floor((F.col("_n") - 1) / 2).alias("_k")).agg(F.min(row).alias("first"), F.max(row).alias("second"), F.count("*").alias("_m"))
    second = (F.col("_m") == 2) & (F.col("second.path_id") < F.col("second.back_id"))
    partner = F.when(F.col("_m") == 2, F.when(second, F.col("first.place")).otherwise(F.col("second.place")))
    kept = pairs.select(F.when(second, F.col("second.place")).otherwise(F.col("first.place")).alias("place"), F.col("first.place").alias("slot"), partner.alias("partner"), F.least("first.path_id", "first.back_id").alias("_lo"), F.greatest("first.path_id", "first.back_id").alias("_hi"))
    return ranges.number_within(kept, ["_lo", "_hi"], ["slot"], "_w").select("place", "slot", "partner", (F.col("_w") > 1).alias("clash"))


def export_junctions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, path_count, floor, altitude) of a graph's nodes, floors as labels; node_id counts the edges that end at it."""
    d = nodes.join(graph.degree(nodes, edges), "node_id")
    return d.select("node_id", F.col("degree").alias("path_count"), floors.ordinal_to_label(F.col("ordinal")).alias("floor"), (F.col("ordinal") * STOREY_M).alias("altitude"))


def export_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge (edge_index, from_id, to_id, cost, ordinal, line, direction, barrier) there and back: ids, seconds, floors and flags.

    A path between floors is vertical, and only such a one names the floors of its ends.
    """
    end = lambda k: nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("ordinal").alias(f"{k}_o"))
    d = edges.join(end("from"), "from_id").join(end("to"), "to_id").withColumn("seconds", F.round(geo.polyline_length(F.col("line")) / WALK_M_PER_S).cast("long"))
    d = d.withColumn("vertical", F.col("from_o") != F.col("to_o"))
    label = lambda c: F.when(F.col("vertical"), floors.ordinal_to_label(F.col(c)))
    way = lambda i, j, a, b: F.struct((F.col("edge_index") * 2 + i).alias("path_id"), (F.col("edge_index") * 2 + j).alias("back_id"), F.col(f"{a}_id").alias("from_id"), F.col(f"{b}_id").alias("to_id"), label(f"{a}_o").alias("from_floor"), label(f"{b}_o").alias("to_floor"))
    d = d.select(F.explode(F.array(way(1, 2, "from", "to"), way(2, 1, "to", "from"))).alias("p"), "cost", "seconds", floors.ordinal_to_label(F.col("ordinal")).alias("floor"), "vertical", F.when(F.col("direction") > 0, F.col("direction")).alias("direction"), "barrier")
    return d.select("p.*", "cost", "seconds", "floor", "vertical", "direction", "barrier")


def openings_near_hubs(openings: DataFrame, outlines: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(opening_id, hub_id, distance) of the hubs whose outline is within BOUNDARY_M of an opening on the same floor; and the openings without any.

    Openings are (opening_id, ordinal, x, y) in metres, outlines segments (hub_id, ordinal, x1, y1, x2, y2).  A segment is sent to the grid cells
    that it reaches into, and those around them.
    """
    if cell < BOUNDARY_M:
        raise ValueError(f"cells are at least {BOUNDARY_M} m wide")
    spread = outlines.withColumn("_c", F.explode(cells_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), cell, 1)))
    here = openings.withColumn("_c", F.struct(F.floor(F.col("x") / cell).alias("x"), F.floor(F.col("y") / cell).alias("y")))
    met = here.join(spread, ["ordinal", "_c"]).withColumn("near", closest_point(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))))
    distance = F.sqrt((F.col("x") - F.col("near.x")) * (F.col("x") - F.col("near.x")) + (F.col("y") - F.col("near.y")) * (F.col("y") - F.col("near.y")))
    found = met.groupBy("opening_id", "hub_id").agg(F.min(distance).alias("distance")).filter(F.col("distance") <= BOUNDARY_M)
    return found, openings.join(found, "opening_id", "left_anti").select("opening_id")


def rank_room_crossings(edges: DataFrame, rooms: DataFrame, cell: float) -> DataFrame:
    """(edge_id, rank, cost): edges of open ways whose middle lies inside a room of their floor have rank 2 and cost ROOM_FACTOR times as much.

    Edges are (edge_id, kind, ordinal, x, y, cost) with their middle, rooms boxes (ordinal, west, south, east, north).
    """
    spread = rooms.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))))
    own = edges.filter(F.col("kind").isin("skeleton", "bridge", "chord")).withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    inside = own.join(spread, ["_cx", "_cy", "ordinal"]).filter("x > west and x < east and y > south and y < north").select("edge_id").distinct().withColumn("_in", F.lit(True))
    d = edges.join(inside, "edge_id", "left")
    return d.select("edge_id", F.when(F.col("_in"), 2).otherwise(1).alias("rank"), (F.col("cost") * F.when(F.col("_in"), ROOM_FACTOR).otherwise(1.0)).alias("cost"))

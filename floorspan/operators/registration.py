"""Registration of a tile package against a venue: tile levels, their floors, residuals and activation gates.

Triangles are rows (object_id, document, link, level_key, level_name, elevation, category, x1, y1, z1, x2, ... z3) in metres of
the package's frame; a venue floor is (level_id, plane, labels) and its outlines are segments (level_id, x1, y1, x2, y2)
in local metres.  Nothing is gathered by level but sums, and distances meet through grid cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.functions.lookups import occlusion, role_of_category
from floorspan.operators import ranges
from floorspan.operators.nearest import nearest_segment, segments_in
from floorspan.session import cut

PLANE_BIN_M = 0.01


@dataclass(frozen=True)
class Bands:
    """The sampling parameters and the bands of the default profile."""

    spacing_m: float = 0.5
    carve_out_m: float = 1.0
    p90_max_m: float = 0.5
    floor_p90_max_m: dict[str, float] = field(default_factory=dict)
    median_shift_max_m: float = 0.15
    coherent_residual_max_m: float = 1.0
    cluster_cell_m: float = 40.0
    cluster_least: int = 5
    level_tolerance_m: float = 1.5
    vertical_offset_m: float = 0.0

    def p90_band(self, level: Column) -> Column:
        out = F.lit(self.p90_max_m)
        for name, band in self.floor_p90_max_m.items():
            out = F.when(level == name, band).otherwise(out)
        return out


def transformed(triangles: DataFrame, matrix: list[float]) -> DataFrame:
    """Corners moved by a 4 x 4 matrix in rows; the last row is that of an affine map."""
    moved = {}
    for p in "123":
        x, y, z = (F.col(f"{k}{p}") for k in "xyz")
        for i, k in enumerate("xyz"):
            moved[f"{k}{p}"] = x * matrix[4 * i] + y * matrix[4 * i + 1] + z * matrix[4 * i + 2] + matrix[4 * i + 3]
    return triangles.withColumns(moved)


def with_level(triangles: DataFrame, version: str) -> DataFrame:
    """Adds the composite level id: version, document, link, key and the elevation in decimetres."""
    tenth = F.round(F.col("elevation").cast("float").cast("double") * 10).cast("int")
    return triangles.withColumn("tile_level", F.concat_ws("|", F.lit(version), "document", "link", "level_key", tenth.cast("string")))


def tile_levels(triangles: DataFrame) -> DataFrame:
    """(tile_level, level_key, level_name, elevation, plane, difference, n_triangles) of triangles with their level.

    The plane is the height of the most walkable area, in bins of a centimetre, the lower of equals; a level without
    flat walkable triangles has none.
    """
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x1"))) / 2
    flat = triangles.filter(role_of_category(F.col("category")) == "walkable").withColumn("area", area).filter("area > 0")
    bins = flat.groupBy("tile_level", F.round((F.col("z1") + F.col("z2") + F.col("z3")) / 3 / PLANE_BIN_M).cast("long").alias("bin")).agg(F.round(F.sum("area"), 6).alias("area"), F.count("*").alias("n"))
    planes = bins.groupBy("tile_level").agg(F.max_by("bin", F.struct("area", (-F.col("bin")).alias("low"))).alias("bin"), F.sum("n").alias("n_triangles"))
    first = triangles.groupBy("tile_level").agg(*[F.min(c).alias(c) for c in ("level_key", "level_name")], F.min(F.col("elevation").cast("float").cast("double")).alias("elevation"))
    d = first.join(planes, "tile_level", "left").withColumn("plane", F.col("bin") * PLANE_BIN_M)
    return d.select("tile_level", "level_key", "level_name", "elevation", "plane", (F.col("elevation") - F.col("plane")).alias("difference"), F.coalesce("n_triangles", F.lit(0)).cast("long").alias("n_triangles"))


def match_floors(levels: DataFrame, floors: DataFrame, tile_labels: DataFrame, floor_labels: DataFrame, bands: Bands) -> DataFrame:
    """Each tile level's floor: (tile_level, level_id, floor_plane, n_near, agreement).

    The nearest floor plane (level_id, floor_plane) within the tolerance is taken, found by bands of heights.  Labels
    (tile_level, label) and (level_id, label) only corroborate: a name that fits one floor only, and another one, contradicts.
    """
    width = bands.level_tolerance_m
    spread = levels.filter("plane is not null").withColumn("at", F.col("plane") + bands.vertical_offset_m).withColumn("b", F.explode(F.array(*[F.floor(F.col("at") / width) + i for i in (-1, 0, 1)])))
    near = spread.join(floors.withColumn("b", F.floor(F.col("floor_plane") / width)), "b").withColumn("gap", F.abs(F.col("floor_plane") - F.col("at"))).filter(F.col("gap") <= width)
    best = near.groupBy("tile_level").agg(F.min(F.struct("gap", "level_id", "floor_plane")).alias("m"), F.count("*").alias("n_near"))
    named = tile_labels.join(floor_labels, "label").groupBy("tile_level").agg(F.collect_set("level_id").alias("named"))
    d = levels.select("tile_level").join(best, "tile_level", "left").join(named, "tile_level", "left")
    agreement = F.when(F.col("m").isNull(), "unknown").when(F.array_contains("named", F.col("m.level_id")), "agrees").when(F.size("named") == 1, "contradicts").otherwise("unknown")
    return d.select("tile_level", "m.level_id", "m.floor_plane", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), agreement.alias("agreement"))


def boundary(triangles: DataFrame, *keys: str) -> DataFrame:
    """Sides (x1, y1, x2, y2) that one walkable triangle of the keys alone has, its corners welded to the millimetre."""
    flat = triangles.filter(role_of_category(F.col("category")) == "walkable")
    mm = lambda c: F.round(F.col(c) * 1000).cast("long")
    corner = {p: F.struct(mm(f"x{p}").alias("x"), mm(f"y{p}").alias("y")) for p in "123"}
    side = lambda p, q: F.struct(F.least(corner[p], corner[q]).alias("lo"), F.greatest(corner[p], corner[q]).alias("hi"))
    sides = flat.select(*keys, F.explode(F.array(side("1", "2"), side("2", "3"), side("3", "1"))).alias("s")).filter("s.lo <> s.hi")
    once = sides.groupBy(*keys, "s").agg(F.count("*").alias("n")).filter("n = 1")
    return once.select(*keys, *[(F.col(c) / 1000.0).alias(a) for c, a in (("s.lo.x", "x1"), ("s.lo.y", "y1"), ("s.hi.x", "x2"), ("s.hi.y", "y2"))])


def samples(sides: DataFrame, spacing: float) -> DataFrame:
    """Points (x, y) in the middle of equal parts of each side, parts of about ``spacing``, one at least."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.lit(1), F.floor(F.sqrt(dx * dx + dy * dy) / spacing)).cast("int")
    d = sides.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("i") + 0.5) / F.col("n")
    return d.withColumns({"x": F.col("x1") + dx * t, "y": F.col("y1") + dy * t}).drop("x1", "y1", "x2", "y2", "n")


def residuals(points: DataFrame, outlines: DataFrame, bands: Bands, cell: float = 4.0) -> DataFrame:
    """The samples (level_id, sample_id, x, y) with the nearest outline point of their floor, and whether they are carved out.

    A sample is carved out when it is farther than the carve-out distance from all outlines and inside none, or its floor has none.
    """
    found = nearest_segment(points, outlines, "level_id", "sample_id", cell)
    far = found.filter(F.col("distance") > bands.carve_out_m).select("level_id", "sample_id", "x", "y")
    inside = segments_in(far, outlines, "level_id", "sample_id")
    d = points.join(found.select("sample_id", "near_x", "near_y", "distance"), "sample_id", "left").join(inside.select("sample_id", F.lit(True).alias("in")), "sample_id", "left")
    carved = F.col("distance").isNull() | ((F.col("distance") > bands.carve_out_m) & F.col("in").isNull())
    return d.withColumns({"carved": carved, "dx": F.col("x") - F.col("near_x"), "dy": F.col("y") - F.col("near_y")}).drop("in")


def floor_report(measured: DataFrame) -> DataFrame:
    """(level_id, sampled, carved_out, p50, p90, worst, shift_x, shift_y, shift) of each floor; null statistics where nothing is left."""
    left = lambda c: F.when(~F.col("carved"), F.col(c))
    d = measured.withColumns({c: left(c) for c in ("distance", "dx", "dy")})
    d = cut(d)
    out = d.groupBy("level_id").agg(F.count("*").alias("sampled"), F.count_if("carved").alias("carved_out"), F.max("distance").alias("worst"))
    for c, found in (("distance", {"ranks": {"p50": "0.5", "p90": "0.9"}}), ("dx", {"middle": "shift_x"}), ("dy", {"middle": "shift_y"})):
        out = out.join(ranges.percentiles(d, ["level_id"], c, **found), "level_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("shift_x", "shift_y")})
    return out.withColumn("shift", F.sqrt(F.col("shift_x") * F.col("shift_x") + F.col("shift_y") * F.col("shift_y")))


def coherent(measured: DataFrame, bands: Bands) -> DataFrame:
    """(level_id, east, north, n, distance) of cells whose samples beyond the band agree on a direction."""
    beyond = measured.filter(~F.col("carved")).filter(F.col("distance") > bands.p90_band(F.col("level_id")))
    cell = lambda c: F.floor(F.col(c) / bands.cluster_cell_m)
    d = beyond.groupBy("level_id", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.median("dx").alias("mx"), F.median("dy").alias("my"))
    d = d.filter(F.col("n") >= bands.cluster_least).withColumn("distance", F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))).filter(F.col("distance") > bands.coherent_residual_max_m)
    return d.select("level_id", ((F.col("cx") + 0.5) * bands.cluster_cell_m).alias("east"), ((F.col("cy") + 0.5) * bands.cluster_cell_m).alias("north"), "n", "distance")


#: The gates in the order in which they are reported.
GATES = (
    "integrityUnresolved", "capabilityProfileMissing", "unclassifiedOpaqueContent", "levelPlaneUnresolved", "levelNotMapped", "levelLabelContradiction", "levelMappingAmbiguous",
    "levelMappingScrambled", "levelMappingCollapsed", "registrationOutOfBand", "coherentShiftOutOfBand", "coherentResidual",
)


def gates(version: str, integrity: bool, capabilities: str | None, triangles: DataFrame, levels: DataFrame, matched: DataFrame, report: DataFrame, clusters: DataFrame, context: DataFrame, bands: Bands) -> DataFrame:
    """(gate, subject, measured, band) of every gate that blocks an activation; ``context`` has the object_id of objects classified as context."""
    no = F.lit(None).cast("double")
    row = lambda code, subject, measured=no, band=no: [F.lit(code).alias("gate"), subject.alias("subject"), measured.cast("double").alias("measured"), band.cast("double").alias("band")]
    spark = levels.sparkSession
    package = spark.createDataFrame([(c,) for c, bad in (("integrityUnresolved", not integrity), ("capabilityProfileMissing", capabilities is None)) if bad], "gate string")
    out = package.select("gate", F.lit(version).alias("subject"), no.alias("measured"), no.alias("band"))

    objects = triangles.groupBy("tile_level", "object_id").agg(F.min("level_key").alias("level_key"), F.max(occlusion(role_of_category(F.col("category"))) != "never").alias("opaque"))
    objects = objects.join(context.select("object_id", F.lit(True).alias("is_context")), "object_id", "left")
    out = out.union(objects.filter("level_key = '' and opaque and is_context is null").select(*row("unclassifiedOpaqueContent", F.col("object_id").cast("string"))))
    rendered = objects.filter("level_key <> ''").groupBy("tile_level").agg(F.bool_and(F.col("is_context").isNotNull()).alias("all_context")).filter("not all_context")
    d = levels.join(matched, "tile_level")
    shown = d.join(rendered, "tile_level", "left_semi")
    out = out.union(shown.filter("plane is null").select(*row("levelPlaneUnresolved", F.col("tile_level"))))
    out = out.union(shown.filter("plane is not null and level_id is null").select(*row("levelNotMapped", F.col("tile_level"))))
    out = out.union(shown.filter("plane is not null and agreement = 'contradicts'").select(*row("levelLabelContradiction", F.col("tile_level"))))
    out = out.union(d.filter("n_near > 1").select(*row("levelMappingAmbiguous", F.col("tile_level"), no, F.lit(bands.level_tolerance_m))))
    placed = d.filter("plane is not null and floor_plane is not null")
    out = out.union(ranges.before(placed, [], ["plane", "tile_level"], "floor_plane", "below").filter("floor_plane < below").select(*row("levelMappingScrambled", F.col("tile_level"), F.col("floor_plane"), F.col("below"))))
    spread = placed.groupBy("level_id").agg((F.max("plane") - F.min("plane")).alias("spread")).filter(F.col("spread") > bands.level_tolerance_m)
    out = out.union(spread.select(*row("levelMappingCollapsed", F.col("level_id"), F.col("spread"), F.lit(bands.level_tolerance_m))))
    band = bands.p90_band(F.col("level_id"))
    out = out.union(report.filter(F.col("p90") > band).select(*row("registrationOutOfBand", F.col("level_id"), F.col("p90"), band)))
    out = out.union(report.filter(F.col("shift") > bands.median_shift_max_m).select(*row("coherentShiftOutOfBand", F.col("level_id"), F.col("shift"), F.lit(bands.median_shift_max_m))))
    where = F.concat("level_id", F.lit(" @ "), F.round("east").cast("long").cast("string"), F.lit(","), F.round("north").cast("long").cast("string"))
    return out.union(clusters.select(*row("coherentResidual", where, F.col("distance"), F.lit(bands.coherent_residual_max_m))))

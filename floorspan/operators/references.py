"""References between features resolved step by step: levels, with a warning for each step that fails, and centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.session import cut


def _lookup(features: DataFrame, name: str) -> DataFrame:
    """Every feature by its id, the last of equal ones, with column names of its own."""
    last = F.max_by(F.struct("level_id", "unit_id", "center"), "place").alias(name)
    return features.filter("id is not null").groupBy(F.col("id").alias(f"{name}_key")).agg(last)


def _listed(features: DataFrame) -> DataFrame:
    """(place, at, candidate, found, level_id, center) of each id in the features' lists of units."""
    units = _lookup(features, "u")
    d = features.select("place", F.posexplode("unit_ids").alias("at", "candidate"))
    d = d.join(units, F.col("candidate") == F.col("u_key"), "left")
    return d.select("place", "at", "candidate", F.col("u").isNotNull().alias("found"), F.col("u.level_id").alias("level_id"), F.col("u.center").alias("center"))


def _joined(features: DataFrame) -> DataFrame:
    """Features with the unit u, the anchor a and the anchor's unit v that they name."""
    d = features.join(_lookup(features, "u"), F.col("unit_id") == F.col("u_key"), "left").join(_lookup(features, "a"), F.col("anchor_id") == F.col("a_key"), "left")
    return d.join(_lookup(features, "v"), F.col("a.unit_id") == F.col("v_key"), "left")


def resolve_levels(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(place, id, level_id) of the features, and the warnings (place, id, reference, value) of what they name and isn't there.

    Features are (place, id, level_id, unit_id, anchor_id, unit_ids, center), place unique.  A feature's level is its own, else that of its unit,
    else that of the unit of its anchor, else that of the first of its listed units that has one.  A step is taken only while
    no level is found; it warns of an id that no feature has, and of an anchor without a unit.
    """
    listed = cut(_listed(features))
    first = listed.filter("level_id is not null").groupBy(F.col("place").alias("p")).agg(F.min_by(F.struct("at", "level_id"), "at").alias("l"))
    c = F.col
    by_unit = c("level_id").isNull() & c("unit_id").isNotNull()
    one = F.coalesce("level_id", F.when(by_unit, c("u.level_id")))
    by_anchor = one.isNull() & c("anchor_id").isNotNull()
    two = F.coalesce(one, F.when(by_anchor, c("v.level_id")))
    warn = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("reference"), value.alias("value")))
    failed = F.array_compact(
        F.array(
            warn(by_unit & c("u").isNull(), "unit_id", c("unit_id")),
            warn(by_anchor & c("a").isNull(), "anchor_id", c("anchor_id")),
            warn(by_anchor & c("a").isNotNull() & c("a.unit_id").isNull(), "anchor unit_id", c("anchor_id")),
            warn(by_anchor & c("a.unit_id").isNotNull() & c("v").isNull(), "unit_id", c("a.unit_id")),
        )
    )
    d = cut(_joined(features).join(first, c("place") == c("p"), "left").select("place", "id", two.alias("so_far"), "l", failed.alias("failed")))
    levels = d.select("place", "id", F.coalesce("so_far", "l.level_id").alias("level_id"))
    warnings = d.select("place", "id", F.explode("failed").alias("w")).select("place", "id", "w.*")
    open_ = d.filter("so_far is null").select("place", "id", "l")
    lost = listed.filter("not found").join(open_, "place").filter(c("l").isNull() | (c("at") < c("l.at")))
    return levels, warnings.union(lost.select("place", "id", F.lit("unit_ids").alias("reference"), F.col("candidate").alias("value")))


def resolve_centers(features: DataFrame) -> DataFrame:
    """(place, id, center): the display point, else the geometry's centre, else those of the anchor, the unit, the first listed unit that has one."""
    first = _listed(features).filter("center is not null").groupBy(F.col("place").alias("p")).agg(F.min_by("center", "at").alias("listed"))
    d = _joined(features).join(first, F.col("place") == F.col("p"), "left")
    return d.select("place", "id", F.coalesce("display_point", "center", "a.center", "u.center", "listed").alias("center"))

"""A decoded venue's checks and what is shown of it: features, floors, overlays, facilities, layers and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feature types that every floor shows, and the geometry types of each family.
CONTEXT = ("venue", "building", "footprint")
FAMILIES = {"Point": "point", "MultiPoint": "point", "LineString": "line", "MultiLineString": "line", "Polygon": "polygon", "MultiPolygon": "polygon"}


def hydrate_problems(features: DataFrame, levels: DataFrame, bounds: DataFrame, venue_id: str) -> DataFrame:
    """(code, id) of all that keeps a decoded venue from being used.

    Features are (id, feature_type, level_id), levels and bounds (level_id).  Checked are ids that repeat, the one venue
    feature and its id, levels and level features against each other, and levels that features and bounds name.
    """
    row = lambda code, d, column: d.select(F.lit(code).alias("code"), F.col(column).cast("string").alias("id"))
    twice = lambda d, c: d.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1")
    shown = features.filter("feature_type = 'level'").select(F.col("id").alias("level_id"))
    venues = features.filter("feature_type = 'venue'").agg(F.count("*").alias("n"), F.count_if(F.col("id") == venue_id).alias("same"))
    out = row("duplicate_feature", twice(features, "id"), "id")
    out = out.union(row("venue_count", venues.filter("n <> 1"), "n"))
    out = out.union(venues.filter("same = 0").select(F.lit("venue_id").alias("code"), F.lit(venue_id).alias("id")))
    out = out.union(row("duplicate_level", twice(levels, "level_id"), "level_id"))
    out = out.union(row("level_without_feature", levels.join(shown, "level_id", "left_anti"), "level_id"))
    out = out.union(row("feature_without_level", shown.join(levels, "level_id", "left_anti"), "level_id"))
    out = out.union(row("unknown_level", features.filter("level_id is not null").join(levels, "level_id", "left_anti"), "id"))
    return out.union(row("bounds_unknown_level", bounds.join(levels, "level_id", "left_anti"), "level_id"))


def render_rows(features: DataFrame) -> DataFrame:
    """(level_id, id, feature_type, x, y, kind) of what each level shows: its own feature and those on it, but no anchors.

    Features are (id, feature_type, level_id, has_geometry, x, y); an occupant without geometry is shown as a point at its
    centre (x, y), and any other feature without geometry isn't shown.
    """
    as_point = (F.col("feature_type") == "occupant") & ~F.col("has_geometry") & F.col("x").isNotNull()
    own = F.when(F.col("feature_type") == "level", F.col("id"))
    at = F.array_distinct(F.array_compact(F.array(own, F.col("level_id"))))
    d = features.filter((F.col("feature_type") != "anchor") & (F.col("has_geometry") | as_point)).withColumn("kind", F.when(as_point, "center").otherwise("geometry"))
    return d.select(F.explode(at).alias("level_id"), "id", "feature_type", "x", "y", "kind")


def floor_features(rendered: DataFrame, features: DataFrame, levels: DataFrame, level_id: str) -> DataFrame:
    """(id, feature_type) once each: the context features, and what all levels of the chosen level's ordinal show.

    A level that isn't known is shown alone.
    """
    group = levels.alias("l").join(levels.filter(F.col("level_id") == level_id).select(F.col("ordinal").alias("o")), F.col("l.ordinal") == F.col("o"), "left_semi").select("level_id")
    group = group.union(levels.sparkSession.createDataFrame([(level_id,)], "level_id string")).distinct()
    context = features.filter(F.col("feature_type").isin(*CONTEXT) & F.col("has_geometry")).select("id", "feature_type")
    return context.union(rendered.join(group, "level_id", "left_semi").select("id", "feature_type")).dropDuplicates(["id"])


def network_overlay(paths: DataFrame, junctions: DataFrame, ordinal: float) -> DataFrame:
    """(kind, id, reverse_id, node_id, target_floor, direction) of a floor's network.

    Paths are (path_id, reverse_id, from_id, to_id, ordinal, vertical), junctions (node_id, ordinal).  A path of the floor is a path; a
    vertical pair with an end on the floor is one link at that end, with the other's floor; junctions of the floor are points.
    A vertical path whose ends aren't known, or lie on one floor, is no link.
    """
    no = F.lit(None)
    flat = paths.filter(~F.col("vertical") & (F.col("ordinal") == ordinal)).select(F.lit("path").alias("kind"), F.col("path_id").alias("id"), "reverse_id", no.cast("long").alias("node_id"), no.cast("double").alias("target_floor"), no.cast("string").alias("direction"))
    end = lambda k: junctions.select(F.col("node_id").alias(f"{k}_id"), F.col("ordinal").alias(f"{k}_floor"))
    up = paths.filter("vertical").join(end("from"), "from_id").join(end("to"), "to_id").filter("from_floor <> to_floor").filter((F.col("from_floor") == ordinal) | (F.col("to_floor") == ordinal))
    here = F.col("from_floor") == ordinal
    target = F.when(here, F.col("to_floor")).otherwise(F.col("from_floor"))
    pair = F.struct(F.least("path_id", "reverse_id").alias("lo"), F.greatest("path_id", "reverse_id").alias("hi"))
    node = F.when(here, F.col("from_id")).otherwise(F.col("to_id"))
    links = up.groupBy(pair.alias("pair")).agg(F.min(F.struct("path_id", node.alias("node_id"), target.alias("target"))).alias("m"))
    links = links.select(F.lit("vertical-link").alias("kind"), F.col("pair.lo").alias("id"), F.col("pair.hi").alias("reverse_id"), "m.node_id", F.col("m.target").alias("target_floor"), F.when(F.col("m.target") > ordinal, "up").otherwise("down").alias("direction"))
    points = junctions.filter(F.col("ordinal") == ordinal).select(F.lit("junction").alias("kind"), no.cast("long").alias("id"), no.cast("long").alias("reverse_id"), "node_id", no.cast("double").alias("target_floor"), no.cast("string").alias("direction"))
    return flat.union(links).union(points)


def conveyance_links(features: DataFrame, links: DataFrame, cell: float) -> DataFrame:
    """(id, path_id, far) of the link behind each conveyance of a floor: of the links with an end inside its outline, the nearest in floors.

    Features are boxes (id, ordinal, west, south, east, north), links (path_id, near, far, x, y) once for each end; ties go to the lower far floor, then
    the lower path.
    """
    spread = features.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))))
    own = links.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell), "ordinal": F.col("near")})
    inside = own.join(spread, ["_cx", "_cy", "ordinal"]).filter("x > west and x < east and y > south and y < north")
    best = inside.groupBy("id").agg(F.min(F.struct(F.abs(F.col("far") - F.col("ordinal")).alias("gap"), "far", "path_id")).alias("m"))
    return best.select("id", "m.path_id", "m.far")


def floor_pins(issues: DataFrame, floor_levels: DataFrame, statuses: list[str]) -> DataFrame:
    """The pins of a floor's levels, in the order of their numbers: issues (id, pin_number, level_id, status, deleted) that the filter shows."""
    shown = issues.filter(F.col("status").isin(*statuses) & (~F.col("deleted") | F.lit("closed" in statuses)))
    return shown.join(floor_levels, "level_id", "left_semi").select("id", "pin_number", "level_id", "status").orderBy("pin_number", "id")


def facilities(rows: DataFrame, nodes: DataFrame, ordinal: Column, icon: Column) -> tuple[DataFrame, DataFrame]:
    """Facilities (ordinal, lon, lat, name, icon, routable), and warnings (code, detail) of those on floors that have no ordinal.

    Rows are (name, floor, image, lon, lat); ones without a place are left out.  A facility is routable where its floor has a node.
    """
    placed = rows.filter("lon is not null and lat is not null").withColumns({"name": F.trim(F.coalesce("name", F.lit(""))), "ordinal": ordinal})
    warned = placed.filter("ordinal is null").select(F.lit("unmapped_floor").alias("code"), F.concat(F.lit("facility "), "name", F.lit(" floor "), F.coalesce("floor", F.lit(""))).alias("detail"))
    floors = nodes.select("ordinal").distinct().withColumn("routable", F.lit(True))
    d = placed.filter("ordinal is not null").withColumn("icon", icon).join(floors, "ordinal", "left")
    return d.select("ordinal", "lon", "lat", "name", "icon", F.coalesce("routable", F.lit(False)).alias("routable")), warned


def extracted(layers: DataFrame, needed: tuple[str, ...], floor: Column) -> DataFrame:
    """(layer, n, floors) of the needed layers, their sorted distinct floors, with n null for one that is missing."""
    wanted = layers.sparkSession.createDataFrame([(x,) for x in needed], "layer string")
    found = layers.filter(F.col("layer").isin(*needed)).groupBy("layer").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(floor)).alias("floors"))
    return wanted.join(found, "layer", "left")


def of_family(members: DataFrame, key: str, family: str) -> DataFrame:
    """Geometry collections as one geometry of a family: (key, type, n_parts, problem).

    Members are (key, place, type, finite, n_parts).  Members without a finite position are skipped, one of another family is a problem, a single
    member stays as it is, several become the Multi form with all their parts; a collection without members has no geometry.
    """
    kinds = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    usable = members.filter("finite").withColumn("family", F.try_element_at(kinds, F.col("type")))
    d = usable.groupBy(key).agg(
        F.count("*").alias("n"), F.min("type").alias("one"), F.sum(F.when(F.col("type").startswith("Multi"), F.col("n_parts")).otherwise(1)).alias("parts"), F.first("n_parts").alias("single"),
        F.min(F.when(F.coalesce(F.col("family"), F.lit("")) != family, F.struct("place", "type"))).alias("bad"),
    )
    many = {"point": "MultiPoint", "line": "MultiLineString", "polygon": "MultiPolygon"}[family]
    ok = F.col("bad").isNull()
    d = members.select(key).distinct().join(d, key, "left")
    return d.select(
        key, F.when(ok, F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, many)).alias("type"), F.when(ok, F.when(F.col("n") == 1, F.col("single")).when(F.col("n") > 1, F.col("parts"))).cast("long").alias("n_parts"), F.col("bad.type").alias("problem")
    )


def blocking_issues(plan: DataFrame, layer_ordinal: Column) -> DataFrame:
    """(label, issue) of what keeps a mapping plan from being imported.

    Plan rows are (database, layer, included, target, compatible, building_known, rule, rule_label, rule_ordinal, rule_field, has_field, fields_known).  A layer
    that can't become its target has no other issue; the plan as a whole needs a layer that gives levels.
    """
    label = F.concat_ws(" / ", "database", "layer")
    rows = plan.filter("included").withColumns({"label": label, "_o": layer_ordinal})
    bad_type = F.col("target").isNull() | ~F.coalesce("compatible", F.lit(False))
    is_level, rule = F.col("target") == "level", F.col("rule")
    fixed = F.coalesce((rule == "fixed") & (F.trim("rule_label") != "") & F.col("rule_ordinal").isNotNull() & ~F.isnan("rule_ordinal"), F.lit(False))
    by_field = F.coalesce((rule == "property") & (F.trim("rule_field") != ""), F.lit(False))
    no_building = ~F.coalesce("building_known", F.lit(False))
    tests = [
        ("level_no_building", is_level & no_building),
        ("level_no_ordinal", is_level & F.coalesce((rule == "source-reference") | ~(fixed | by_field | F.col("_o").isNotNull() | F.col("has_field")), ~(F.col("_o").isNotNull() | F.col("has_field")))),
        ("no_level_rule", ~is_level & rule.isNull()),
        ("need_building", ~is_level & F.coalesce(rule != "source-reference", F.lit(False)) & no_building),
        ("level_no_ordinal", ~is_level & F.coalesce(rule == "layer-name", F.lit(False)) & F.col("_o").isNull()),
        ("fixed", F.coalesce(rule == "fixed", F.lit(False)) & ~fixed),
        ("field", ~F.coalesce("fields_known", F.lit(False))),
    ]
    issues = F.when(bad_type, F.array(F.lit("incompatible_type"))).otherwise(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests])))
    gives = ~bad_type & (is_level | F.coalesce(rule.isin("fixed", "property"), F.lit(False)))
    none = rows.agg(F.coalesce(F.max(gives.cast("int")), F.lit(0)).alias("g")).filter("g = 0").select(F.lit(None).cast("string").alias("label"), F.lit("no_level").alias("issue"))
    return rows.select("label", F.explode(issues).alias("issue")).union(none)


def latest_published(versions: DataFrame, venue: Column | None = None) -> DataFrame:
    """(venue_id, version_id, seq, bundle_hash): each venue's published version with a bundle and the highest number; of one venue, if given."""
    d = versions.filter("status = 'published' and bundle_hash is not null")
    if venue is not None:
        d = d.filter(venue.isNull() | (F.col("venue_id") == venue))
    best = d.groupBy("venue_id").agg(F.max_by(F.struct(F.col("id").alias("version_id"), "seq", "bundle_hash"), F.struct("seq", "id")).alias("m"))
    return best.select("venue_id", "m.*")


def recovered(jobs: DataFrame, versions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs and versions after a restart: running jobs without a live lease end in an error, draft versions without a live job fail.

    Jobs are (id, version_id, status, lease_expires_at, error), versions (id, status, bundle_hash, error).  A version fails with its interrupted job, else as an orphan.
    """
    lost = (F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    done = jobs.withColumn("_lost", lost)
    out = done.select("id", "version_id", F.when(F.col("_lost"), "error").otherwise(F.col("status")).alias("status"), F.when(~F.col("_lost"), F.col("lease_expires_at")).alias("lease_expires_at"), F.when(F.col("_lost"), "interrupted_by_restart").otherwise(F.col("error")).alias("error"))
    per = done.groupBy(F.col("version_id").alias("id")).agg(F.max(F.col("_lost")).alias("interrupted"), F.max(~F.col("_lost") & F.col("status").isin("queued", "running")).alias("live"))
    v = versions.join(per, "id", "left")
    draft = F.col("status") == "draft"
    cause = F.when(draft & F.coalesce("interrupted", F.lit(False)), "interrupted_by_restart").when(draft & ~F.coalesce("live", F.lit(False)), "orphaned_job")
    v = v.withColumn("_c", cause)
    return out, v.select("id", F.when(F.col("_c").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("_c").isNull(), F.col("bundle_hash")).alias("bundle_hash"), F.coalesce("_c", "error").alias("error"))


def reserved(requests: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(request_id, evaluation_id, won): the first request for an evaluation that is neither activated nor reserved wins."""
    open_ = evaluations.filter("state = 'evaluated' and activating_version_id is null").select("evaluation_id", F.lit(True).alias("open"))
    d = requests.join(open_, "evaluation_id", "left").withColumn("k", F.row_number().over(Window.partitionBy("evaluation_id").orderBy("at", "request_id")))
    return d.select("request_id", "evaluation_id", (F.coalesce("open", F.lit(False)) & (F.col("k") == 1)).alias("won"))

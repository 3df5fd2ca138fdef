"""Queries over order, windows, limits and sets (inventory group E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorspan.operators import graph, relational, spatial
from floorspan.plans.registry import query
from floorspan.session import cut


@query("E1", "v_node", "SELECT node_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS BIGINT) AS node_index FROM v_node")
def e01_dense_index(d: DataFrame) -> DataFrame:
    return graph.dense_index(d.select("node_id"))


@query("E3", "v_level", "SELECT DISTINCT ordinal, lead(ordinal) OVER (ORDER BY ordinal) AS above FROM (SELECT DISTINCT ordinal FROM v_level)")
def e03_adjacent_ordinals(d: DataFrame) -> DataFrame:
    """Each floor and the next one above, by dense indexes."""
    placed = cut(graph.dense_index(d.select("ordinal").distinct(), "ordinal"))
    above = placed.select((F.col("node_index") - 1).alias("node_index"), F.col("ordinal").alias("above"))
    return placed.join(above, "node_index", "left").select("ordinal", "above")


@query("E4", "v_node", "SELECT ordinal, node_id FROM (SELECT ordinal, node_id, altitude, lag(altitude) OVER (PARTITION BY ordinal ORDER BY node_id) AS before FROM v_node) WHERE altitude < before")
def e04_monotonicity(d: DataFrame) -> DataFrame:
    return spatial.monotone(d, "ordinal", "node_id", "altitude").select("ordinal", "node_id")


@query("E5", "orders", """+r AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_orderstatus THEN 0 ELSE 1 END AS b FROM orders),
  n AS (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM r) SELECT o_custkey, CAST(run AS BIGINT) AS run, count(*) AS n, min(o_orderkey) AS first_key FROM n GROUP BY 1, 2 HAVING count(*) >= 2""")
def e05_gaps_and_islands(d: DataFrame) -> DataFrame:
    d = relational.runs(d, "o_custkey", "o_orderkey", "o_orderstatus")
    return d.groupBy("o_custkey", "run").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")).filter("n >= 2")


@query("E6", "lineitem", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS arc FROM lineitem")
def e06_cumulative_length(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("arc"))


@query("E7 E8", "v_level", "SELECT level_id, CAST(row_number() OVER (ORDER BY ordinal DESC, building) AS BIGINT) AS place FROM v_level")
def e07_stable_descending(d: DataFrame) -> DataFrame:
    d = graph.dense_index(d.select("level_id", F.struct(-F.col("ordinal"), F.col("building")).alias("k")), "k")
    return d.select("level_id", (F.col("node_index") + 1).alias("place"))


@query("E9", "v_level", "SELECT level_id, CAST(row_number() OVER (ORDER BY ordinal < 0, abs(ordinal), building) AS BIGINT) AS place FROM v_level")
def e09_bit_pattern_sort(d: DataFrame) -> DataFrame:
    d = graph.dense_index(d.select("level_id", F.struct(F.col("ordinal") < 0, F.abs("ordinal"), F.col("building")).alias("k")), "k")
    return d.select("level_id", (F.col("node_index") + 1).alias("place"))


@query("E8", "v_net", "SELECT from_id, to_id, cost FROM v_net ORDER BY from_id, to_id, cost")
def e08_multi_key_sort(d: DataFrame) -> DataFrame:
    return d.select("from_id", "to_id", "cost").orderBy("from_id", "to_id", "cost")


@query("E12", "v_user", "SELECT id, username FROM v_user WHERE role <> 'viewer' ORDER BY username, id")
def e12_list_reviewers(d: DataFrame) -> DataFrame:
    return d.filter("role <> 'viewer'").orderBy("username", "id").select("id", "username")


@query("E13", "v_job", "SELECT id, created_at FROM v_job ORDER BY created_at DESC, id DESC LIMIT 20")
def e13_recent_twenty(d: DataFrame) -> DataFrame:
    return d.orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "created_at")


@query("E14", "v_level", "SELECT level_id FROM v_level WHERE building % 5 <> 2 ORDER BY abs(ordinal), ordinal DESC, building LIMIT 1")
def e14_initial_level(d: DataFrame) -> DataFrame:
    return d.filter("building % 5 <> 2").orderBy(F.abs("ordinal"), F.desc("ordinal"), "building").limit(1).select("level_id")


@query("E15", "v_level", """SELECT q, first(level_id ORDER BY p, building) AS level_id FROM (SELECT q, level_id, building, CASE WHEN lower(level_id) = q THEN 0 WHEN lower(substr(label, 1, 2)) = q THEN 1 WHEN lower(label) = q THEN 2 END AS p
  FROM v_level, (SELECT unnest(['l7', 'ca', 'china', 'zz']) AS q)) WHERE p IS NOT NULL GROUP BY q""")
def e15_level_match_priority(d: DataFrame) -> DataFrame:
    d = d.withColumn("q", F.explode(F.array(*map(F.lit, ("l7", "ca", "china", "zz")))))
    p = F.when(F.lower("level_id") == F.col("q"), 0).when(F.lower(F.substring("label", 1, 2)) == F.col("q"), 1).when(F.lower("label") == F.col("q"), 2)
    return d.withColumn("p", p).filter("p is not null").groupBy("q").agg(F.min_by("level_id", F.struct("p", "building")).alias("level_id"))


@query("E17", "v_entry", "SELECT level_id, feature_id FROM v_entry QUALIFY row_number() OVER (PARTITION BY level_id ORDER BY CASE feature_type WHEN 'opening' THEN 0 WHEN 'occupant' THEN 1 ELSE 2 END, feature_id) <= 6 OR feature_id % 50 = 0")
def e17_label_cap(d: DataFrame) -> DataFrame:
    """The first six labels of a level by type and id, and the protected ones; no task ranks more than its own first six of a level."""
    tier = F.when(F.col("feature_type") == "opening", 0).when(F.col("feature_type") == "occupant", 1).otherwise(2)
    w = Window.partitionBy("level_id").orderBy(tier, "feature_id")
    first = d.withColumn("k", F.row_number().over(w)).filter("k <= 6").select("level_id", "feature_id")
    return first.union(d.filter("feature_id % 50 = 0").select("level_id", "feature_id")).distinct()


@query("E19", "v_media v_version", "SELECT CAST(original AS VARCHAR) AS hash FROM v_media UNION SELECT CAST(thumbnail AS VARCHAR) FROM v_media UNION SELECT bundle_hash FROM v_version WHERE bundle_hash IS NOT NULL")
def e19_mark_references(m: DataFrame, v: DataFrame) -> DataFrame:
    parts = [m.select(F.col(c).cast("string").alias("hash")) for c in ("original", "thumbnail")] + [v.select(F.col("bundle_hash").alias("hash")).filter("hash is not null")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("E20", "v_stored v_media", "SELECT blob_id FROM v_stored EXCEPT SELECT original FROM v_media WHERE state <> 'detached'")
def e20_sweep(s: DataFrame, m: DataFrame) -> DataFrame:
    return s.select("blob_id").subtract(m.filter("state <> 'detached'").select("original"))


@query("E22", "v_net", "SELECT from_id, to_id + 1000000 AS to_id, 'added' AS change FROM v_net WHERE (from_id + to_id) % 7 = 0 UNION ALL SELECT from_id, to_id, 'deleted' FROM v_net WHERE (from_id + to_id) % 7 = 0 OR to_id % 9 = 4")
def e22_connection_key_diff(d: DataFrame) -> DataFrame:
    """All connections of two versions of the network; the new one lacks some and leads others elsewhere."""
    old = d.select("from_id", "to_id")
    moved = (F.col("from_id") + F.col("to_id")) % 7 == 0
    new = old.filter(moved | (F.col("to_id") % 9 != 4)).withColumn("to_id", F.when(moved, F.col("to_id") + 1_000_000).otherwise(F.col("to_id")))
    return new.exceptAll(old).withColumn("change", F.lit("added")).union(old.exceptAll(new).withColumn("change", F.lit("deleted")))


@query("E23", "v_edge", "SELECT least(from_id, to_id) AS lower, greatest(from_id, to_id) AS upper, min(cost) AS cost FROM v_edge GROUP BY 1, 2")
def e23_keep_shortest(d: DataFrame) -> DataFrame:
    return d.groupBy(F.least("from_id", "to_id").alias("lower"), F.greatest("from_id", "to_id").alias("upper")).agg(F.min("cost").alias("cost"))


@query("E24", "v_version", """+o AS (SELECT id, seq, status FROM v_version), n AS (SELECT CASE WHEN id % 3 = 0 THEN id + 1000000 ELSE id END AS id, seq + 1000 AS seq, 'evaluated' AS status FROM v_version)
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.status = 'draft') THEN n.seq ELSE o.seq END AS seq, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.status = 'draft') THEN n.status ELSE o.status END AS status FROM o FULL JOIN n ON o.id = n.id""")
def e24_keyed_upsert(d: DataFrame) -> DataFrame:
    """All versions evaluated anew: drafts take the new row, others keep theirs, and versions with new ids are added."""
    old = d.select("id", "seq", "status")
    new = d.select(F.when(F.col("id") % 3 == 0, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("id"), (F.col("seq") + 1000).alias("seq"), F.lit("evaluated").alias("status"))
    return relational.upsert(old, new, "id", F.col("status") == "draft")

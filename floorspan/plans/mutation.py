"""Queries over mutations, jobs and revisions as batch rewrites (inventory group H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.operators import changes, ranges
from floorspan.plans.registry import query


@query("H1", "v_issue", "SELECT id, version_id, CAST(100 + row_number() OVER (PARTITION BY version_id ORDER BY created_at, id) AS BIGINT) AS pin FROM v_issue")
def h01_generated_sequence(d: DataFrame) -> DataFrame:
    return changes.number_within(d, "version_id", ["created_at", "id"], F.lit(100)).select("id", "version_id", F.col("number").alias("pin"))


@query("H2", "v_issue", """SELECT i.id, CASE WHEN i.row_version = 1 + i.id % 2 THEN 'closed' ELSE i.status END AS status, CASE WHEN i.row_version = 1 + i.id % 2 THEN i.row_version + 1 ELSE i.row_version END AS row_version, i.row_version <> 1 + i.id % 2 AS stale FROM v_issue i""")
def h02_optimistic_update(d: DataFrame) -> DataFrame:
    wanted = d.select("id", (1 + F.col("id") % 2).alias("expected"), F.lit("closed").alias("new_status"))
    return changes.optimistic(d.select("id", "status", "row_version"), wanted)


@query("H3 H6", "v_issue v_version", "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE priority END AS body, id % 4 = 0 OR deleted AS deleted FROM v_issue WHERE version_id NOT IN (SELECT id FROM v_version WHERE venue_id = 3)")
def h03_soft_delete_and_cascade(d: DataFrame, v: DataFrame) -> DataFrame:
    gone = v.filter("venue_id = 3").select(F.col("id").alias("version_id"))
    kept = d.join(gone, "version_id", "left_anti")
    return changes.tombstone(kept.select("id", F.col("priority").alias("body"), "deleted"), F.col("id") % 4 == 0)


@query("H4", "orders", """+r AS (SELECT o_custkey AS author, o_orderkey % 20 AS request, o_orderstatus AS hash, o_orderkey AS nr FROM orders), f AS (SELECT *, first_value(hash) OVER w AS h0, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY author, request ORDER BY nr))
  SELECT author, request, nr, CASE WHEN k = 1 THEN 'created' WHEN hash = h0 THEN 'replay' ELSE 'conflict' END AS outcome FROM f""")
def h04_idempotent_replay(d: DataFrame) -> DataFrame:
    r = d.select(F.col("o_custkey").alias("author"), (F.col("o_orderkey") % 20).alias("request"), F.col("o_orderstatus").alias("hash"), F.col("o_orderkey").alias("nr"))
    return changes.replay(r, ["author", "request"], "hash", "nr").select("author", "request", "nr", "outcome")


@query("H5", "v_media")
def h05_quota_fold(d: DataFrame) -> DataFrame:
    """Uploads that fit under a version's quota in order of arrival; a rejected one takes no room."""
    return changes.under_quota(d.select("version_id", "id", "bytes"), "version_id", "id", "bytes", 400)


@query("H9 H17 H18", "v_job", "SELECT id, version_id, CAST(count(*) OVER (PARTITION BY version_id ORDER BY created_at, id) AS BIGINT) AS revision, max(value) OVER (PARTITION BY version_id ORDER BY created_at, id) AS seen FROM v_job")
def h09_revision_counter(d: DataFrame) -> DataFrame:
    d = d.select("id", "version_id", "created_at", "value")
    d = ranges.running(d, ["version_id"], ["created_at", "id"], {"revision": F.lit(1).cast("long")}, {"seen": F.col("value")})
    return d.select("id", "version_id", "revision", "seen")


@query("H10", "v_media", "SELECT state, count(*) AS n, CAST(count(*) FILTER (WHERE state = 'staged' AND created_at < TIMESTAMP '1996-01-01') AS BIGINT) AS expired FROM v_media GROUP BY 1")
def h10_attachment_lifecycle(d: DataFrame) -> DataFrame:
    old = (F.col("state") == "staged") & (F.col("created_at") < F.lit("1996-01-01").cast("timestamp"))
    return d.groupBy("state").agg(F.count("*").alias("n"), F.count_if(old).alias("expired"))


@query("H11", "v_job", """SELECT id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '2024-01-10' THEN 'queued' WHEN status = 'queued' AND row_number() OVER (PARTITION BY status ORDER BY created_at, id) <= 5 THEN 'running' ELSE status END AS status FROM v_job""")
def h11_job_queue_step(d: DataFrame) -> DataFrame:
    return changes.queue_step(d, F.lit("2024-01-10").cast("timestamp"), 5).select("id", "status")


@query("", "v_version", "SELECT venue_id, max(seq) AS seq, CAST(count(*) FILTER (WHERE bundle_hash IS NULL) AS BIGINT) AS to_rebuild FROM v_version WHERE status IN ('published', 'draft') GROUP BY 1")
def h13_publish_pointer(d: DataFrame) -> DataFrame:
    return d.filter(F.col("status").isin("published", "draft")).groupBy("venue_id").agg(F.max("seq").alias("seq"), F.count_if(F.col("bundle_hash").isNull()).alias("to_rebuild"))


@query("", "v_job", "SELECT version_id, id AS holder FROM v_job WHERE kind <> 'x' QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY created_at, id) = 1")
def h15_single_reservation(d: DataFrame) -> DataFrame:
    return d.groupBy("version_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("holder"))


@query("", "v_blob", "SELECT version_id, count(*) AS sections, CAST(sum(byte_size) AS BIGINT) AS bytes FROM v_blob GROUP BY 1")
def h19_bundle_sections(d: DataFrame) -> DataFrame:
    return d.groupBy("version_id").agg(F.count("*").alias("sections"), F.sum("byte_size").alias("bytes"))

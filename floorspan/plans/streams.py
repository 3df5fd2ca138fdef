"""Queries over streams (inventory group H, streaming rows), run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.plans.registry import query
from floorspan.session import cut, scratch
from floorspan.streaming import reducer, revisions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)


@query("H16 H17 H18", "", "SELECT CAST(user_id % 60 AS BIGINT) AS version_id, max(event_id) AS revision, count(*) AS events FROM events GROUP BY 1")
def h16_stream_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _events(spark, sf_dir).select((F.col("user_id") % 60).cast("long").alias("version_id"), F.col("event_id").alias("revision"))
    return cut(revisions.run_once(revisions.latest(stream), f"revisions_{uuid.uuid4().hex}", "complete", scratch(spark)))


@query("H4", "", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def h04_stream_idempotent_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = revisions.created_once(_events(spark, sf_dir).select("user_id", "event_type"), "user_id", "event_type")
    folder = scratch(spark)
    revisions.run_to_parquet(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("H18 H16", "", """+a AS (SELECT CAST(user_id % 60 AS BIGINT) AS version_id, CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'observed' ELSE 'fetched' END AS action, event_id * 7919 % 1000 AS revision FROM events),
  s AS (SELECT version_id, max(revision) AS observed, max(revision) FILTER (WHERE action = 'fetched') AS fetched FROM a GROUP BY 1)
  SELECT version_id, observed, coalesce(fetched, 0) AS applied, fetched IS NOT NULL AND observed > fetched AS stale FROM s""")
def h18_stream_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end states of all versions, kept by a stateful processor over the stream of actions."""
    action = F.when((F.col("event_type") == "view") | (F.col("event_id") % 3 == 0), "observed").otherwise("fetched")
    stream = _events(spark, sf_dir).select((F.col("user_id") % 60).cast("long").alias("version_id"), action.alias("action"), (F.col("event_id") * 7919 % 1000).alias("revision"))
    folder = scratch(spark)
    reducer.reduce(stream, folder)
    return reducer.last_states(spark.read.parquet(f"{folder}/out"))

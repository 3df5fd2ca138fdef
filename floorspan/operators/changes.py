"""Mutations as rewrites of DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspan.operators import ranges
from floorspan.session import ship


def number_within(df: DataFrame, key: str, order: list[str], base: Column) -> DataFrame:
    """Consecutive numbers after ``base`` within each key, which may hold any number of rows."""
    return ranges.number_within(df, [key], order).withColumn("number", (base + F.col("number")).cast("long"))


def optimistic(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, status, row_version, stale): an update applies only where the version is the expected one."""
    d = rows.join(wanted, "id", "left")
    fits = F.coalesce(F.col("row_version") == F.col("expected"), F.lit(False))
    return d.select(
        "id", F.when(fits, F.col("new_status")).otherwise(F.col("status")).alias("status"), F.when(fits, F.col("row_version") + 1).otherwise(F.col("row_version")).alias("row_version"), (F.col("expected").isNotNull() & ~fits).alias("stale")
    )


def tombstone(rows: DataFrame, gone: Column) -> DataFrame:
    """Deleted rows stay without their body."""
    return rows.withColumns({"body": F.when(gone, F.lit(None)).otherwise(F.col("body")), "deleted": gone | F.col("deleted")})


def replay(requests: DataFrame, key: list[str], content: str, order: str) -> DataFrame:
    """created for a key's first request, replay for equal ones after it, conflict for others."""
    first = requests.groupBy(*key).agg(F.min(F.struct(order, content)).alias("_f"))
    d = requests.join(first, key)
    outcome = F.when(F.col(order) == F.col(f"_f.{order}"), "created").when(F.col(content) == F.col(f"_f.{content}"), "replay").otherwise("conflict")
    return d.withColumn("outcome", outcome).drop("_f")


def under_quota(uploads: DataFrame, key: str, order: str, size: str, quota: int) -> DataFrame:
    """(key, order, accepted): a fold in order that keeps one number for each key; rows stream through, none is gathered.

    A key's uploads are one sequence by nature, so they run through one task.
    """
    ship(uploads.sparkSession)
    rows = uploads.select(key, order, size).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = object(), 0
        for batch in batches:
            accepted = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != at:
                    at, used = k, 0
                fits = used + (n or 0) <= quota
                used += (n or 0) if fits else 0
                accepted.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(accepted, pa.bool_())], [key, order, "accepted"])

    kind = lambda c: uploads.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind(key)}, {order} {kind(order)}, accepted boolean")


def queue_step(jobs: DataFrame, expired_before: Column, slots: int) -> DataFrame:
    """One turn of a job queue: jobs with an expired lease wait again, the oldest waiting ones run."""
    oldest = jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(slots).select("id", F.lit(True).alias("_start"))
    d = jobs.join(oldest, "id", "left")
    status = F.when((F.col("status") == "running") & (F.col("created_at") < expired_before), "queued").when(F.col("_start"), "running").otherwise(F.col("status"))
    return d.withColumn("status", status).drop("_start")


def undo(history: list[object], steps: int) -> object:
    """The value ``steps`` edits back; an edit history is small and belongs to one user."""
    return history[max(0, len(history) - 1 - steps)]


def publish(versions: DataFrame, compiled: DataFrame, identity: list[str]) -> DataFrame:
    """(id, status, bundle_hash): drafts become published with the bundle of their last job whose identity is still the version's.

    Compiled jobs are (version_id, job_id, created_at, bundle) and the identity columns as the job read them.
    """
    same = compiled.join(versions.select(F.col("id").alias("version_id"), *[F.col(c).alias(f"_{c}") for c in identity]), "version_id")
    for c in identity:
        same = same.filter(F.col(c).eqNullSafe(F.col(f"_{c}")))
    last = same.groupBy(F.col("version_id").alias("id")).agg(F.max_by("bundle", F.struct("created_at", "job_id")).alias("_bundle"))
    d = versions.join(last, "id", "left")
    goes = (F.col("status") == "draft") & F.col("_bundle").isNotNull()
    return d.select("id", F.when(goes, "published").otherwise(F.col("status")).alias("status"), F.when(goes, F.col("_bundle")).otherwise(F.col("bundle_hash")).alias("bundle_hash"))


def recompiled(versions: DataFrame, bundle: Column) -> DataFrame:
    """Published versions whose bundle is still their source get a compiled one."""
    legacy = (F.col("status") == "published") & F.coalesce(F.col("bundle_hash") == F.col("source_hash"), F.lit(False))
    return versions.withColumn("bundle_hash", F.when(legacy, bundle).otherwise(F.col("bundle_hash")))


def first_events(subscribers: DataFrame, events: DataFrame) -> DataFrame:
    """(version_id, first_event, superseded) for subscribers (version_id, last_id, current): the highest known revision, and how many buffered ones it stands for."""
    top = events.groupBy("version_id").agg(F.max("revision").alias("top"))
    d = subscribers.join(top, "version_id", "left").withColumn("first_event", F.greatest(F.col("current"), F.coalesce("top", F.lit(0))))
    between = d.join(events, "version_id").filter("revision > last_id and revision < first_event").groupBy("version_id").agg(F.count("*").alias("superseded"))
    return d.join(between, "version_id", "left").select("version_id", F.col("first_event").cast("long").alias("first_event"), F.coalesce("superseded", F.lit(0)).cast("long").alias("superseded"))


def reduced(actions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, observed, applied, stale, accepted) after each action observed or fetched with a revision."""
    w = Window.partitionBy(key).orderBy(order)
    fetched = F.when(F.col("action") == "fetched", F.col("revision"))
    d = actions.withColumns({"observed": F.max("revision").over(w), "_applied": F.max(fetched).over(w)})
    stale = F.col("_applied").isNotNull() & (F.col("observed") > F.col("_applied"))
    return d.select(key, order, F.col("observed").cast("long").alias("observed"), F.coalesce("_applied", F.lit(0)).cast("long").alias("applied"), stale.alias("stale"), F.when(F.col("action") == "fetched", F.col("revision") >= F.col("_applied")).alias("accepted"))


#: Fixed value: states that an editor remembers.
HISTORY = 50


def histories(actions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, present, past, future) after each action edit, undo or redo; rows stream through in order, one editor's last states are held."""
    ship(actions.sparkSession)
    rows = actions.select(key, order, "action", value).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, past, present, future = object(), [], None, []
        for batch in batches:
            out: list[tuple] = []
            for k, action, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != at:
                    at, past, present, future = k, [], None, []
                if action == "edit":
                    past, present, future = [*past, present][-HISTORY:], v, []
                elif action == "undo" and past:
                    past, present, future = past[:-1], past[-1], [present, *future]
                elif action == "redo" and future:
                    past, present, future = [*past, present][-HISTORY:], future[0], future[1:]
                out.append((present, len(past), len(future)))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((batch.column(3).type, pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [key, order, "present", "past", "future"])

    kind = lambda c: actions.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind(key)}, {order} {kind(order)}, present {kind(value)}, past int, future int")

"""Review revisions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(stream: DataFrame, key: str = "version_id", revision: str = "revision") -> DataFrame:
    """The highest revision of each version.  A maximum takes late and repeated events without harm, so no watermark drops any."""
    return stream.groupBy(key).agg(F.max(revision).alias("revision"), F.count("*").alias("events"))


def created_once(stream: DataFrame, *key: str) -> DataFrame:
    """The first event of each request id; the ids stay in the state store, as a late retry has to be known."""
    return stream.dropDuplicates(list(key))


def windowed(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Events by window of event time; windows close once the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("events"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all that is there into a memory table and return it."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append all that is there to Parquet files, each row once."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

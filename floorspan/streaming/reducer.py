"""Applied and observed revisions of each version as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from floorspan.session import ship

#: The state store that stateful processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = "spark.sql.streaming.stateStore.providerClass"


class Revisions(StatefulProcessor):
    """One value for each version: the highest revisions observed and applied, whether a collection was applied, and the actions so far.

    An action (action, revision) observes its revision, and a fetched collection is applied unless a newer one has been.  Maxima
    take actions late, repeated and in any order to the same end.  Each batch returns a version's new state once.
    """

    def init(self, handle) -> None:
        self._held = handle.getValueState("revisions", "observed long, applied long, fetched boolean, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        observed, applied, fetched, n = self._held.get() or (0, 0, False, 0)
        for r in rows:
            observed, n = max(observed, r.revision), n + 1
            if r.action == "fetched":
                applied, fetched = max(applied, r.revision), True
        self._held.update((observed, applied, fetched, n))
        yield Row(version_id=key[0], observed=observed, applied=applied, stale=fetched and observed > applied, n=n)

    def close(self) -> None:
        pass


def reduce(actions: DataFrame, folder: str) -> None:
    """Run a stream of actions (version_id, action, revision) to the end of what is there; states are appended under ``folder``/out.

    The checkpoint under the same folder holds the state, so that a later run goes on where this one ended.
    """
    spark = actions.sparkSession
    ship(spark)
    before = spark.conf.get(KEY, None)
    spark.conf.set(KEY, PROVIDER)
    try:
        kind = actions.schema["version_id"].dataType.simpleString()
        states = actions.groupBy("version_id").transformWithState(Revisions(), f"version_id {kind}, observed long, applied long, stale boolean, n long", "Append", "None")
        q = states.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(KEY)
        else:
            spark.conf.set(KEY, before)


def last_states(states: DataFrame) -> DataFrame:
    """(version_id, observed, applied, stale): each version's state after the most actions."""
    last = F.max_by(F.struct("observed", "applied", "stale"), "n").alias("x")
    return states.groupBy("version_id").agg(last).select("version_id", "x.*")

"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.llm._common import Stored, give_back, id_remainder, small
from floorspan.session import ship


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn, id_col: str = "doc_id", text_col: str = "text") -> tuple[Stored | None, dict[int, int]]:
    """A stored table (i, y, t) of labelled rows of each class 0 and 1, the first by a hash of the id, and the classes' sizes.

    The bound is ``per_class`` and a quarter more ids of each class (some may have no document), on whole texts of
    any length; the texts stay on the workers.  The ids are drawn from the narrow label table, so that the bounded
    id list is broadcast and only drawn texts are shuffled.  A label that is null or neither 0 nor 1 is ignored, an id
    labelled both ways counts as 1, and of the texts of a repeated id the largest is taken.  Without labelled ids
    the table is None.
    """
    known = (
        labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
        .filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & learn(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(11)), "i").limit(per_class + per_class // 4).collect()]
    if not drawn:
        return None, sizes
    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame(drawn, "i " + kind + ", y int")
    rows = (
        docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
        .join(F.broadcast(ids), "i")  # at most 2.5 * per_class rows
        .groupBy("i", "y")
        .agg(F.max("t").alias("t"))
    )
    return Stored(rows), sizes


def from_texts(rows: DataFrame, schema: str, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> pa.Table:
    """What ``step`` yields for slices of the sampled rows, brought to the driver; it has to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield from step(batch)
        give_back()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema).toArrow()


def not_fifth(col):
    """Rows that labels may be learned from: crc32 of the id modulo 5 is not 0."""
    return id_remainder(col, 5) != 0

"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.session import checkpoint_ready, ship

#: Words between ASCII white space.  ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


#: Rows that are worked on at a time; a batch comes with up to 10,000.
SLICE = 1024


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what is made of a batch stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def give_back() -> None:
    """At the end of a task, return freed memory to the system: workers live on, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """Map Arrow batches; ``make`` builds the batch function once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in small(batches):
            if (out := step(batch)) is not None:
                yield out
        del step
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """Rows whose text a batch predicate accepts, with all their columns; names of columns can't clash."""
    at = df.columns.index(text_col)

    def build():
        keep = make()
        return lambda batch: batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return by_batch(df, df.schema, build)


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lowered and nothing else; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class Stored:
    """A DataFrame written as Parquet to the shared checkpoint folder; ``drop`` deletes the files once nothing needs them."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        checkpoint_ready(spark)
        self._spark = spark
        self.path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Stored tables of one piece of work: at its end they are deleted but for those kept, and after an error all are."""

    def __init__(self):
        self._stored: list[tuple[Stored, bool]] = []

    def store(self, df: DataFrame, keep: bool = False) -> DataFrame:
        self._stored.append((Stored(df), keep))
        return self._stored[-1][0].df

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing needs any more."""
        for s, _ in self._stored:
            if s.df is df:
                s.drop()

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, error, *rest) -> None:
        for s, keep in self._stored:
            if error is not None or not keep:
                s.drop()


def frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, at most ``most`` of them; rows that tie at the border are left out together.

    The border comes from two histograms (by powers of two, then 1024 steps inside one), so nothing is sorted
    and no task gathers candidates.
    """
    c = F.col(count)
    steps = 1024

    def border(bins: list[tuple[int, int]], left: int) -> tuple[int | None, int]:
        """The lowest bin down to which all bins fit, and what is left after them."""
        fits = None
        for b, n in sorted(bins, reverse=True):
            if n > left:
                return b, left
            left, fits = left - n, b
        return None, left

    power = F.floor(F.log2(c.cast("double"))).cast("int")
    at, left = border([(r.b, r.n) for r in counts.groupBy(power.alias("b")).agg(F.count("*").alias("n")).collect()], most)
    if at is None:
        return counts
    low, width = 1 << at, max(1, (1 << at) // steps)
    inside = counts.filter(power == at).groupBy(((c - low) / width).cast("long").alias("b")).agg(F.count("*").alias("n"))
    step, _ = border([(r.b, r.n) for r in inside.collect()], left)
    return counts.filter(c >= (low if step is None else low + (step + 1) * width))


#: Rows of a few short values each that a size-checked broadcast may have.
MOST_SENT = 500_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """a checkpointed table of a few short columns, marked for broadcast when it has at most MOST_SENT rows; else as it is."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df

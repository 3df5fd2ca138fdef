"""Importance resampling of documents towards a target by hashed n-grams, over an integer word dictionary.

A feature is a run of 1 to ``most`` consecutive words; its bucket is the CRC-32 of its words, joined by a space,
modulo ``buckets``.  The work on texts goes by blocks of about ``BLOCK_BYTES``: the block's distinct words get
integer ids, an n-gram is the tuple of the id of the n-gram before its last word and of that word's id, the
distinct tuples are found by sorting these numbers, the bytes of each distinct tuple are hashed once (going on from
the hash of the tuple's beginning, which is the hash of all its bytes), and the buckets are joined back to the places
of the tuples in the texts.  A dictionary over the whole corpus would have to shuffle each block's distinct tuples,
more bytes than the texts themselves; blocks hash a tuple again in each block that has it and shuffle nothing.

Texts are read once: a stored table holds the sorted buckets of each document, two bytes each.  From it come the
corpus's histogram (``buckets`` rows of each task, summed by Spark) and, with the gains (a row for each bucket, sent
to the tasks), the weights.  The draw adds Gumbel noise of the id's hash and takes the highest scores, ranked over
ranges of the scores, so that no task holds all documents.

Defined cases: null, empty and wordless texts have no features and weight 0, and are not drawn where ``least_words`` is
over 0; a null id hashes as the empty text and comes first among equal scores; repeated rows are drawn and ranked
each by itself, in any order among rows equal in score and id; an empty corpus gives an empty result, an empty target
is a histogram of zeros; a text of any length is split in pieces; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorspan.llm._common import Tables, cut, give_back, small, table
from floorspan.llm._pieces import pieces, to_spaces
from floorspan.session import ship

BUCKETS = 10_000
MOST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that share a dictionary.
BLOCK_BYTES = 1 << 22
#: Digits, a-z and all beyond ASCII make words; A-Z are lowered first.
_TABLE = to_spaces(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


class Dictionary(dict):
    """Ids of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Documents whose words share a dictionary; ``take`` gives the sorted buckets of each document."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets = most, buckets
        self.ids, self.texts, self.size = Dictionary(), [], 0

    def add(self, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = [np.fromiter(map(self.ids.__getitem__, p.split()), dtype=np.int64) for p in pieces(raw, _TABLE)]
        self.texts.append(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64))
        self.size += len(raw)

    def take(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of words, buckets of all features in order) of each document."""
        words = list(self.ids)
        n = np.array([len(t) for t in self.texts], dtype=np.int64)
        token = np.concatenate(self.texts) if self.texts else np.empty(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(token))  # words from each place to its document's end
        spaced = [b" " + w for w in words]
        # level 1: a word is a tuple by itself; the tuples of a level go on from those of the level before
        at, tuples = token, np.array([crc32(w) for w in words], dtype=np.int64)
        found, owner = [], []
        for level in range(1, self.most + 1):
            if level > 1:
                begins = np.flatnonzero(left >= level)
                key = at[np.searchsorted(starts, begins)] * len(words) + token[begins + level - 1]
                distinct, at = np.unique(key, return_inverse=True)
                before, last = np.divmod(distinct, max(1, len(words)))
                tuples = np.array([crc32(spaced[w], c) for w, c in zip(last.tolist(), tuples[before].tolist(), strict=True)], dtype=np.int64)
                starts = begins
            else:
                starts = np.arange(len(token))
            found.append((tuples % self.buckets)[at])
            owner.append(doc[starts])
        bucket, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner * self.buckets + bucket, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(n))) if len(n) else n
        bucket = bucket[order]
        for k in range(len(n)):
            yield int(n[k]), bucket[ends[k - 1] if k else 0 : ends[k]]
        self.ids, self.texts, self.size = Dictionary(), [], 0


def _number(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, b) of every row; ``b`` holds the sorted buckets of its features, repeats counted."""
    kind = docs.schema[id_col].dataType.simpleString()
    number = _number(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids = Block(most, buckets), []

        def flush() -> pa.RecordBatch:
            rows = list(block.take())
            n_words = pa.array([n for n, _ in rows], pa.int64())
            n_features = pa.array([len(b) for _, b in rows], pa.int64())
            held = pa.array([b.astype(number).tobytes() for _, b in rows], pa.binary())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), n_words, n_features, held], names=["id", "n_words", "n_features", "b"])

        for batch in small(batches):
            text, done = batch.column(1), 0
            for i in range(batch.num_rows):
                block.add(text[i].as_py())
                if block.size >= BLOCK_BYTES:
                    ids.append(batch.column(0).slice(done, i + 1 - done))
                    done = i + 1
                    yield flush()
                    ids = []
            if done < batch.num_rows:
                ids.append(batch.column(0).slice(done))
        if ids:
            yield flush()
        give_back()

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_features long, b binary")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``features``."""
    number = _number(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in small(batches):
            for b in batch.column(0):
                sums += np.bincount(np.frombuffer(b.as_py(), dtype=number), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["bucket", "n"])

    ship(rows.sparkSession)
    got = rows.filter("n_features > 0").select("b").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the source, rounded down."""
    k = len(source)
    s_all, t_all = int(source.sum()), int(target.sum())
    up, down = (target + 1).astype(float) * float(s_all + k), (source + 1).astype(float) * float(t_all + k)
    return np.array([math.floor(1000 * math.log(x / y)) for x, y in zip(up.tolist(), down.tolist(), strict=True)], dtype=np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains over a row's features, 0 without any."""
    kind = rows.schema["id"].dataType.simpleString()
    number = _number(len(gain))
    sent = rows.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            own = (np.frombuffer(b, dtype=number) for b in batch.column(3).to_pylist())
            weight = pa.array([int(sent.value[b].sum()) // len(b) if len(b) else 0 for b in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), weight], names=["id", "n_words", "n_features", "weight"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the SHA-256 of seed and id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows (id, n_words, score, ...) with ``rank``: 1, 2, 3... of the drawn by falling score and rising id, else null.

    Rows are dealt by ranges of (score, id) and counted by range; a drawn row's rank is its place in its range after
    the counts of the ranges before.  Rows of one score lie in one range only as far as their ids do.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    fits = F.col("n_words") >= least_words
    ranges = cut(scored.filter(fits).repartitionByRange(*order).withColumn("p", F.spark_partition_id()))
    before, start = [], 0
    for row in sorted(ranges.groupBy("p").count().collect()):  # a row for each range
        before.append((row.p, start))
        start += row["count"]
    most = start * percent // 100
    offsets = scored.sparkSession.createDataFrame(before, "p int, before long")
    place = F.row_number().over(Window.partitionBy("p").orderBy(*order)) + F.col("before")
    ranked = ranges.join(F.broadcast(offsets), "p").withColumn("rank", place.cast("long")).drop("p", "before")  # a row for each range
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.union(scored.filter(~fits).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", most: int = MOST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``."""
    with Tables() as tables:
        goal = target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("t"))
        wanted = histogram(features(goal, "id", "t", most, buckets), buckets)
        rows = tables.store(features(docs, id_col, text_col, most, buckets))
        weighed = weigh(rows, gains(histogram(rows, buckets), wanted))
        scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    return draw(scored, least_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def keep_drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns: rows whose id has been drawn."""
    drawn = resample(docs, target, id_col, **options).filter("rank is not null").select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col].eqNullSafe(drawn["__drawn"]), "left_semi")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

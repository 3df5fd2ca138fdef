"""Language ID: multinomial naive Bayes over hashed character n-grams.

Every training row's 1- to 3-character n-grams are counted by language and bucket inside the tasks, and the
counts are added up by Spark, so that all training texts count and no text leaves its task.  A language's prior is
its share of the training rows.  The matrix of log probabilities (languages x ``2 ** BITS``) is broadcast in blocks of
at most ``BLOCK`` languages, which is 64 MB; texts are scored in batches, by adding up the matrix's columns over the
sparse counts of each text's buckets.  Where there are several blocks, they are held against all texts one after the
other, and the best language and the sum of all likelihoods are carried along.

Defined cases: a text that is null or without a letter is ``und`` with score 0; rows with a null language
teach nothing; languages that tie go to the smallest name; without any training row every text is ``und``;
repeated rows are predicted alike; an empty table gives an empty result; extra columns are ignored by
``predict`` and carried along by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floorspan.llm._chars import codes, grams, groups
from floorspan.llm._common import Stored, by_batch, has_letter, id_remainder, small, table
from floorspan.session import ship

BITS = 14
SIZES = (1, 2, 3)
#: Languages whose log probabilities are broadcast together, and whose counts a task holds together.
BLOCK = 1000
HELD = 256
#: Texts whose counts are taken together, and dense cells for each character up to which that is done without a sort.
ROWS, DENSE = 128, 16
UNKNOWN = "und"


def not_held_out(col):
    """Rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    return id_remainder(col, 4) != 2


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the (lang, text) rows given; a task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, count in held.items():
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(count[used], pa.int64())], ["lang", "bucket", "n"])
            held.clear()

        for batch in small(batches):
            langs = batch.column(0).to_pylist()
            for at, own in groups(batch.column(1).to_pylist()):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(langs[at : at + len(own)], own, strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    c, offsets = codes(texts)
                    count = held.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                    for n, b in grams(c, SIZES, BITS):
                        ok = np.ones(len(b), dtype=bool)
                        for j in range(1, n):  # n-grams that span two texts
                            ok[(offsets[1:-1] - j)[offsets[1:-1] - j < len(b)]] = False
                        count += np.bincount(b[ok], minlength=1 << BITS)
                if len(held) > HELD:
                    yield from out()
        yield from out()

    ship(rows.sparkSession)
    parts = rows.mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def sparse_counts(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the buckets that each text's n-grams fall into, by text."""
    c, offsets = codes(own)
    owner = np.repeat(np.arange(len(own), dtype=np.int64) << BITS, np.diff(offsets))
    keys = []
    for n, b in grams(c, SIZES, BITS):
        key = owner[: len(b)] + b
        keys.append(key if n == 1 else key[owner[: len(b)] == owner[n - 1 :]])  # n-grams that span two texts don't count
    keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
    if len(own) << BITS <= DENSE * len(keys):
        count = np.bincount(keys)
        used = np.flatnonzero(count)
        count = count[used]
    else:
        used, count = np.unique(keys, return_counts=True)
    return used >> BITS, used & ((1 << BITS) - 1), count


class Block:
    """Log probabilities of some languages, in the order of their names: (languages, buckets), and log priors."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.langs, self.by_bucket, self.prior = langs, np.ascontiguousarray(log_prob.T, dtype=np.float32), prior

    def totals(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The log likelihood and prior of each language, for one text after the other."""
        for _, group in groups(texts):
            for lo in range(0, len(group), ROWS):
                own = group[lo : lo + ROWS]
                row, bucket, count = sparse_counts(own)
                edges = np.searchsorted(row, np.arange(len(own) + 1))
                for k in range(len(own)):
                    a, b = edges[k], edges[k + 1]
                    yield count[a:b].astype(np.float64) @ self.by_bucket[bucket[a:b]].astype(np.float64) + self.prior


class Model:
    """Blocks of languages, which are sent out one by one."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    @property
    def langs(self) -> list[str]:
        return [lang for b in self.blocks for lang in b.langs]


def best_of(block: Block, texts: list[str | None], names: list[str | None], tops: list[float | None], sums: list[float | None]) -> tuple[list[str | None], list[float | None], list[float | None]]:
    """The best language so far of each text, its log likelihood, and the log of the sum of all likelihoods; None without letters."""
    out = [], [], []
    for text, name, top, all_, total in zip(texts, names, tops, sums, block.totals(texts), strict=True):
        if has_letter(text):
            k = int(total.argmax())
            peak = float(total[k])
            every = peak + float(np.log(np.exp(total - peak).sum()))
            if name is None or peak > top:
                name, top = block.langs[k], peak
            all_ = every if all_ is None else float(np.logaddexp(all_, every))
        for column, x in zip(out, (name, top, all_), strict=True):
            column.append(x)
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all given rows with a language and a text."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = Stored(count_grams(rows))
    try:
        sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a short row for each language
        langs, n_rows, blocks = sorted(sizes), sum(sizes.values()), []
        for lo in range(0, len(langs), BLOCK):
            own = langs[lo : lo + BLOCK]
            place = {lang: k for k, lang in enumerate(own)}
            found = counts.df.filter((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])).toArrow()  # 2 ** BITS rows a language at most
            count = np.zeros((len(own), 1 << BITS))
            names = found["lang"].combine_chunks().dictionary_encode()
            index = np.array([place[x] for x in names.dictionary.to_pylist()], dtype=np.int64)
            if len(found):
                count[index[names.indices.to_numpy()], found["bucket"].to_numpy()] = found["n"].to_numpy()
            total = count.sum(axis=1, keepdims=True)
            blocks.append(Block(own, np.log((count + 0.5) / (total + 0.5 * (1 << BITS))), np.log(np.array([sizes[x] for x in own]) / n_rows)))
        return Model(blocks)
    finally:
        counts.drop()


def _judged(df: DataFrame, text_col: str, model: Model, with_text: bool) -> tuple[DataFrame, str, str]:
    """The rows, with or without their texts, and two columns more: the language and its posterior probability; and the names of the two.

    A block but the last leaves a stored table of the rows, as the next one goes over them again.
    """
    mark = "__"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    names = [mark + x for x in ("name", "top", "every")]
    kinds, n = ("string", "double", "double"), len(df.columns)
    at, last = df.columns.index(text_col), len(model.blocks) - 1
    out, before = df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in zip(names, kinds, strict=True)]), None
    for i, block in enumerate(model.blocks):
        left = [k for k in range(n) if with_text or i < last or k != at]
        sent = df.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent, left=left):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = best_of(sent.value, batch.column(at).to_pylist(), *[c.to_pylist() for c in batch.columns[n:]])
                columns = [batch.column(k) for k in left] + [pa.array(x, pa.string() if k == "string" else pa.float64()) for x, k in zip(found, kinds, strict=True)]
                return pa.RecordBatch.from_arrays(columns, [batch.schema.names[k] for k in left] + names)

            return step

        fields = out.schema.fields
        out = by_batch(out, StructType([fields[k] for k in left] + fields[n:]), make)
        if i < last:
            stored = Stored(out)
            if before is not None:
                before.drop()
            out, before = stored.df, stored
    name, top, every = (F.col(f"`{c}`") for c in names)
    score = F.least(F.coalesce(F.exp(top - every), F.lit(0.0)), F.lit(1.0))
    return out.withColumns({names[0]: F.coalesce(name, F.lit(UNKNOWN)), names[1]: score}), names[0], names[1]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the score is the posterior probability of the language."""
    out, name, score = _judged(docs.select(id_col, text_col), text_col, model, not model.blocks)
    return out.select(id_col, F.col(name).alias("lang_pred"), F.col(score).alias("score"))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """Rows whose text has a language with a posterior of ``least`` or more, with all their columns."""
    out, name, score = _judged(docs, text_col, model, True)
    return out.filter((F.col(name) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(not_held_out("doc_id")))
    return predict(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

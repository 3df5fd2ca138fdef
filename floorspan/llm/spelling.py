"""Spelling variants grouped by full neighbourhood generation.

Words are counted over all texts (a task sums its own words before they are shuffled, so a hot word is a row for each
task).  Each word of the vocabulary generates its whole neighbourhood at distance one over the vocabulary's alphabet:
every distinct deletion, replacement and insertion.  What equals another word of the vocabulary is a near word; the
join on equality is the proof, no distances are computed.

A word of n letters has about 2 * n * alphabet neighbours, nearly all of them no words.  Their 64-bit hashes come from
the word's own prefix and suffix sums, and only candidates that a Bloom table of the vocabulary seems to hold are spelled
out and joined; the table lets none go that is a word, and the join drops what it lets through in error.  A table is at
most 64 MB, so a vocabulary over ``TABLE_WORDS`` is dealt by hash into several, which take their turns.

A word's form is its near word of most occurrences if that has ``times`` as many as the word; forms are followed to the
root by pointer doubling.  Occurrences at least double from form to form, so the rounds are bounded by the logarithm
of the logarithm of the largest count, and no cycle exists.

Defined cases: null and empty texts and texts without letters have no words; a null id hashes as the empty text;
repeated rows count each; of near words with equal counts the first in code-point order is the form; an empty table
or vocabulary gives an empty result; a text of any length is split in pieces; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.llm._bloom import bloom, may_hold
from floorspan.llm._common import Tables, cut, give_back, small, table
from floorspan.llm._pieces import pieces, to_spaces
from floorspan.llm._words import mix
from floorspan.session import ship

#: A letter goes from a run whose hash this number divides.
LOSES = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
TIMES = 2
#: Words that a task counts before it hands them on.
HELD = 1 << 18
#: Words of one Bloom table, and bits for each.
TABLE_WORDS, TABLE_BITS = 1 << 23, 64
#: Words whose neighbourhoods a task makes.
TASK_WORDS = 1 << 14
#: Candidates that are made at a time.
AT_ONCE = 1 << 20
_TABLE = to_spaces(lambda b: 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0xC0)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loses: int = LOSES, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of all runs of Latin letters with at least ``least_letters``, after the loss of a letter in some.

    Runs are cut from the Latin-1 form of the text, in which all other letters are no part of a run, so that a
    byte is a code point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in small(batches):
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                own = f"{batch.column(0)[i].as_py()}:".encode()
                for piece in pieces(text.encode("latin-1", "replace"), _TABLE):
                    for w, n in Counter(piece.split()).items():
                        if len(w) < least_letters:
                            continue
                        h = crc32(own + (w if w.isascii() else w.decode("latin-1").encode()))
                        if not h % loses:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < least_letters:
                                continue
                        counts[w] = counts.get(w, 0) + n
                    if len(counts) >= HELD:
                        yield flush()
        if counts:
            yield flush()
        give_back()

    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def _code(letters: np.ndarray) -> np.ndarray:
    return mix((letters.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, _BASE, dtype=np.uint64))))


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words: the mixed sum of the letters' codes times powers of a base."""
    out = np.zeros(len(words), dtype=np.int64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        code = _code(_letters([words[i] for i in at])) if n else np.zeros((len(at), 0), dtype=np.uint64)
        out[at] = mix((code * _powers(int(n))[: int(n)]).sum(axis=1, dtype=np.uint64)).view(np.int64)
    return out


def neighbours(words: list[str], alphabet: str, keep) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places of the words, their candidates) of all distinct deletions, replacements and insertions that ``keep`` passes.

    ``words`` have one length.  ``keep`` tests an array of hashes; only what passes is spelled out.
    """
    n = len(words[0])
    letters, extra = _letters(words), np.frombuffer(alphabet.encode("utf-32-le"), dtype=np.uint32)
    code, new, power = _code(letters), _code(extra), _powers(n + 1)
    term = code * power[:n]
    prefix = np.concatenate((np.zeros((len(words), 1), dtype=np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)), axis=1)
    total = prefix[:, -1:]

    # a deletion inside a run of equal letters is the same wherever it is, and so is an insertion: the last place counts
    deleted = prefix[:, :n] + (total - prefix[:, 1:]) * np.uint64(_BACK)
    distinct = np.concatenate((letters[:, 1:] != letters[:, :-1], np.ones((len(words), 1), dtype=bool)), axis=1)
    w, i = np.nonzero(distinct)
    ok = keep(mix(deleted[w, i]).view(np.int64))
    if ok.any():
        yield w[ok], [words[a][:b] + words[a][b + 1 :] for a, b in zip(w[ok].tolist(), i[ok].tolist(), strict=True)]

    step = max(1, AT_ONCE // max(1, len(words) * len(extra)))
    for lo in range(0, n + 1, step):
        at = np.arange(lo, min(lo + step, n + 1))
        inside = at[at < n]
        if len(inside):
            made = (total - term[:, inside])[:, :, None] + power[inside][None, :, None] * new
            yield from _spelled(words, extra, made, letters[:, inside, None] != extra, lo, 1, keep)
        made = (prefix[:, at] + (total - prefix[:, at]) * np.uint64(_BASE))[:, :, None] + power[at][None, :, None] * new
        fresh = np.ones(made.shape, dtype=bool)
        fresh[:, : len(inside)] = letters[:, inside, None] != extra
        yield from _spelled(words, extra, made, fresh, lo, 0, keep)


def _spelled(words: list[str], extra: np.ndarray, made: np.ndarray, fresh: np.ndarray, lo: int, skip: int, keep) -> Iterator[tuple[np.ndarray, list[str]]]:
    w, i, c = np.nonzero(fresh)
    ok = keep(mix(made[fresh]).view(np.int64))
    if ok.any():
        w, i, c = w[ok], (i[ok] + lo).tolist(), extra[c[ok]].tolist()
        yield w, [words[a][:b] + chr(x) + words[a][b + skip :] for a, b, x in zip(w.tolist(), i, c, strict=True)]


def candidates(vocabulary: DataFrame, alphabet: str, keep_maker) -> DataFrame:
    """(word, n, near): each word with its neighbours that a test of hashes passes; ``keep_maker`` makes it in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keep_maker()
        for batch in small(batches):
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                group = max(1, AT_ONCE // (64 * (int(n) + 1)))
                for lo in range(0, len(at), group):
                    part = at[lo : lo + group]
                    own = [words[k] for k in part]
                    for w, near in neighbours(own, alphabet, keep):
                        yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in w.tolist()], pa.string()), pa.array(counts[part[w]], pa.int64()), pa.array(near, pa.string())], names=["word", "n", "near"])
        give_back()

    ship(vocabulary.sparkSession)
    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, near string")


def near_words(vocabulary: DataFrame, tables: Tables) -> DataFrame:
    """(word, n, near, near_n): all pairs of words of a vocabulary (word, n) that differ by exactly one letter."""
    spark = vocabulary.sparkSession
    size = vocabulary.count()
    # the alphabet is bounded by the letters that runs are made of
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()
    alphabet = "".join(sorted(r.c for r in letters))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column(0).to_pylist()), pa.int64())], names=["key"])

    ship(spark)
    turns = max(1, -(-size // TABLE_WORDS))
    keys = tables.store(vocabulary.select("word").mapInArrow(hashed, "key long"))
    found = None
    for turn in range(turns):
        sent = spark.sparkContext.broadcast(bloom(keys.filter(F.pmod("key", F.lit(turns)) == turn), "key", TABLE_BITS))

        def maker(sent=sent, turn=turn):
            return lambda h: may_hold(sent.value, h) & (h % turns == turn) if turns > 1 else may_hold(sent.value, h)

        one = candidates(vocabulary.repartition(max(1, -(-size // TASK_WORDS)), "word"), alphabet, maker)
        found = one if found is None else found.union(one)
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def forms(vocabulary: DataFrame, tables: Tables, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of the words with near words."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    rows = near_words(vocabulary, tables).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b"))
    fits = -F.col("b.m") >= F.col("n") * times
    return rows.select("word", "n", "n_near", F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n"))


def roots(links: DataFrame, largest: int, times: int = TIMES) -> DataFrame:
    """(word, root) of every word with a form, from (word, form); ``largest`` is the largest count of a word."""
    at = cut(links.select("word", F.col("form").alias("root")))
    longest = max(1, math.ceil(math.log(max(2, largest), times)))  # links of a way, as counts grow ``times`` times
    for _ in range(math.ceil(math.log2(longest))):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return at


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loses: int = LOSES, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    with Tables() as tables:
        vocabulary = tables.store(word_counts(docs, id_col, text_col, loses, least_letters).filter(F.col("n") >= least_count), keep=True)
        largest = vocabulary.agg(F.max("n")).first()[0] or 1
        near = cut(forms(vocabulary, tables, times))
        ends = roots(near.filter("form is not null"), largest, times)
    all_ = vocabulary.select("word", "n").join(near.drop("n"), "word", "left").join(ends, "word", "left")
    return all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")

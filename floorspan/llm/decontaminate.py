"""Benchmark decontamination: a broadcast hash set of the test items' n-grams, scanned over document windows.

Texts are lower-cased (A-Z only) and cut into words of digits, letters a-z and everything beyond ASCII.  An
item's windows are its runs of ``n`` words; an item of fewer words is one window.  The workers cut the items into windows,
and equal windows meet in a sum with the ids of their items.  Windows go out in blocks of at most ``block_windows``, numbered by
counted ranges (the size bound of what is broadcast; a longer item is in several); a larger benchmark is a stated query set that is held against all documents block by block.  A block is
read, sent and turned into tables once a task, its hits are carried along with the rows, which a stored table holds
until the next block is done, and then it is dropped.  Every hash hit is verified against the words themselves.

Defined cases: null, empty and wordless texts have no words and no hits; items without words have no
window; items with a null id mark hits and are named by no id; items that share a window are all named;
repeated document rows give a row each; an empty benchmark gives rows without hits; extra columns are
ignored by ``scan`` and carried along by ``drop_contaminated`` and ``remove_spans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floorspan.llm._common import Stored, ascii_lower, by_batch, cut, table
from floorspan.llm._words import ALNUM, joined, windows, words

N = 10
BLOCK_WINDOWS = 1 << 19
#: Documents are hashed in groups of about so many bytes.
GROUP_BYTES = 1 << 19


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self) -> None:
        self.items: dict[tuple[int, bytes], set[str]] = {}

    def __len__(self) -> int:
        return len(self.items)


def windows_of(text: str | None, n: int) -> Iterator[tuple[int, bytes]]:
    """(number of words, words) of each window of an item."""
    buf = ascii_lower(text)
    starts, ends, _ = words(buf, ALNUM)
    own = [buf[s:e] for s, e in zip(starts, ends, strict=True)]
    size = min(n, len(own))
    for i in range(len(own) - size + 1 if own else 0):
        yield size, b" ".join(own[i : i + size])


def all_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(size, w, items) of the distinct windows of all items; ``items`` are the ids as texts of those that have it."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, found, items = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(windows_of(text, n))
                sizes += [size for size, _ in own]
                found += [w for _, w in own]
                items += [item] * len(own)
            return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(found, pa.binary()), pa.array(items, pa.string())], ["size", "w", "item"])

        return step

    rows = by_batch(benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")), "size int, w binary, item string", make)
    return rows.groupBy("size", "w").agg(F.collect_set("item").alias("items"))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, most: int) -> Iterator[Windows]:
    """Blocks of at most ``most`` windows, one at least."""
    rows = cut(all_windows(benchmark, id_col, text_col, n))
    count = rows.count()
    if count > most:
        from floorspan.operators.graph import dense_index  # for the driver alone: workers need no pandas

        rows = cut(dense_index(rows.withColumn("key", F.struct("size", "w")), "key"))
    for lo in range(0, max(1, count), most):
        block = Windows()
        for r in (rows.filter(F.col("node_index").between(lo, lo + most - 1)) if count > most else rows).select("size", "w", "items").collect():
            block.items[r["size"], bytes(r["w"])] = set(r["items"])
        yield block


class Matcher:
    def __init__(self, block: Windows):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[bytes, set[str]]]]]] = {}
        for (size, text), ids in block.items.items():
            _, _, h = words(text, ALNUM)
            key = int(windows(h, size)[0])
            self.by_size.setdefault(size, (None, None, {}))[2].setdefault(key, []).append((text, ids))
        for size, (_, _, own) in self.by_size.items():
            keys = np.array(sorted(own), dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[size] = (keys, seen, own)

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Number of words, flat (start, end) word ranges that are hit, and ids of the items found, of each text."""
        n_words, spans, items = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        group: list[bytes] = []
        at, held = 0, 0
        for i, text in enumerate(texts):
            group.append(ascii_lower(text))
            held += len(group[-1])
            if held >= GROUP_BYTES or i == len(texts) - 1:
                self._group(group, at, n_words, spans, items)
                at, held, group = i + 1, 0, []
        return n_words, spans, items

    def _group(self, group, at, n_words, spans, items) -> None:
        buf, offsets = joined(group)
        starts, ends, hashes = words(buf, ALNUM)
        first = np.searchsorted(starts, offsets)  # the first word of each text
        for k in range(len(group)):
            n_words[at + k] = int(first[k + 1] - first[k])
        owner = np.repeat(np.arange(len(group)), np.diff(first))
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for size, (keys, seen, own) in self.by_size.items():
            w = windows(hashes, size)
            if not len(w):
                continue
            maybe = np.flatnonzero(seen[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
            maybe = maybe[owner[maybe] == owner[maybe + size - 1]]
            found = np.searchsorted(keys, w[maybe])
            maybe = maybe[keys[np.minimum(found, len(keys) - 1)] == w[maybe]]
            for p in maybe.tolist():
                text = b" ".join(buf[starts[j] : ends[j]] for j in range(p, p + size))
                for known, ids in own[int(w[p])]:
                    if known == text:
                        k = int(owner[p])
                        mine = hits.setdefault(k, ([], set()))
                        mine[0].append((p - int(first[k]), p - int(first[k]) + size))
                        mine[1].update(ids)
        for k, (ranges, ids) in hits.items():
            spans[at + k] = _union(ranges)
            items[at + k] = sorted(ids)


def _union(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, with_text: bool, item_col: str, item_text_col: str, n: int, block_windows: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """The rows, with or without their texts, and their numbers of words, hit word ranges and items found; and these columns' names."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    names = [mark + x for x in ("words", "spans", "items")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    width, at = len(docs.columns), docs.columns.index(text_col)
    out, before = docs.select("*", F.lit(None).cast("long").alias(names[0]), F.lit(None).cast("array<long>").alias(names[1]), F.lit(None).cast("array<string>").alias(names[2])), None
    more = blocks(benchmark, item_col, item_text_col, n, block_windows)
    block = next(more)
    while block is not None:
        following = next(more, None)
        left = [k for k in range(width) if with_text or following is not None or k != at]
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent, left=left):
            matcher = Matcher(sent.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                n_words, spans, items = matcher.scan(batch.column(at).to_pylist())
                for k, (old, ids) in enumerate(zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True)):
                    if old:  # hits of earlier blocks
                        spans[k] = _union([*zip(old[::2], old[1::2], strict=True), *zip(spans[k][::2], spans[k][1::2], strict=True)])
                    if ids:
                        items[k] = sorted({*ids, *items[k]})
                found = [pa.array(x, t) for x, t in zip((n_words, spans, items), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(k) for k in left] + found, [batch.schema.names[k] for k in left] + names)

            return step

        fields = out.schema.fields
        out = by_batch(out, StructType([fields[k] for k in left] + fields[width:]), make)
        if following is not None:
            stored = Stored(out)
            sent.unpersist()
            if before is not None:
                before.drop()
            out, before = stored.df, stored
        block = following
    return out, tuple(names)


def scan(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """(id, n_words, spans, items) of every document row: hit word ranges as flat starts and ends, and the items found."""
    out, names = _scanned(docs.select(id_col, text_col), benchmark, text_col, False, item_col, item_text_col, n, block_windows)
    return out.select(id_col, *[F.col(c).alias(a) for c, a in zip(names, ("n_words", "spans", "items"), strict=True)])


def n_hit(spans: str) -> Column:
    """The number of words in flat starts and ends: ends minus starts, as they alternate."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: x - acc)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_hit: int = 0, item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """Rows of documents with at most ``most_hit`` hit words, with all their columns."""
    out, (_, spans, _) = _scanned(docs, benchmark, text_col, True, item_col, item_text_col, n, block_windows)
    return out.filter(n_hit(spans) <= most_hit).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All rows, with the hit words' stretches cut out of the text; other columns stay as they are."""
    out, (_, spans, _) = _scanned(docs, benchmark, text_col, True, item_col, item_text_col, n, block_windows)
    at, spans_at = out.columns.index(text_col), out.columns.index(spans)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            texts = [cut_out(t, s) if s else t for t, s in zip(columns[at].to_pylist(), columns[spans_at].to_pylist(), strict=True)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return step

    return by_batch(out, out.schema, make).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_out(text: str, spans: list[int]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, _ = words(raw.lower(), ALNUM)
    out, lo = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[lo : starts[s]])
        lo = int(ends[e - 1])
    return (b"".join(out) + raw[lo:]).decode("utf-8", "surrogatepass")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit("spans") > 0).alias("contaminated")
    )

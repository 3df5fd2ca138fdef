"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's bag holds the 3- to 5-character n-grams of its words with their ends marked, hashed into
``2 ** BITS`` buckets; misspellings share most of their n-grams with known words.  The mean of the bag's
embeddings goes into a softmax over the two classes.  Embeddings and softmax weights are trained together
by full-batch gradient steps over a bounded, class-balanced sample of labelled rows (``per_class`` rows of
each class, documented in ``_labelled.sample``); the steps of an embedding are scaled by the mean square of its
share, so that rare n-grams learn as fast as common ones.

Sparsity regularizes the fit: embeddings stay zero for n-grams (they still count in the mean) that occur in about
as many documents of one class as of the other.  How many standard errors apart the two must be is chosen from
``STRENGTHS``, and the border between the classes is set, by the errors on folds left out of both the choice of
n-grams and the training, so that both follow the size of the sample.  Calling nothing toxic is one of the borders.

Sampled texts stay on the workers, whatever their length: these count the documents with each n-gram by class and
fold, and then send the shares of all n-grams that some fold may choose, as a sparse matrix.  For scoring, embeddings and weights collapse into
one number for each bucket, which is broadcast (1 MB).

Defined cases: null and empty texts, and texts without n-grams, score the softmax of the bias; without
labelled rows of both classes, or without an n-gram that tells them apart, every text scores 0; where calling nothing
toxic makes the fewest errors, all texts score next to 0; texts that score alike lie on the same side of the border; repeated rows
score alike; an empty table gives an empty result; extra columns are ignored by ``score`` and carried along by
``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.llm._chars import SPACE, codes, grams, groups, sums
from floorspan.llm._common import by_batch, give_back, id_remainder, keep_rows, small, table
from floorspan.llm._labelled import from_texts, not_fifth, sample
from floorspan.session import ship

BITS = 18
SIZES = (3, 4, 5)
DIM = 8
PER_CLASS = 3000
FOLDS = 5
#: Standard errors between the classes' shares of documents that an n-gram needs for an embedding; one is chosen.
STRENGTHS = (3.0, 4.0, 5.0, 6.0, 8.0)
#: N-grams in fewer sampled documents have none.
LEAST_DOCS = 3
#: The bias where nothing is to be called toxic.
NEVER = -40.0


def _inside(space: np.ndarray, n: int) -> np.ndarray:
    """Places whose n characters have no space but at their ends."""
    m = len(space) - n + 1
    bad = np.zeros(m, dtype=bool)
    for j in range(1, n - 1):
        bad |= space[j : j + m]
    return ~bad


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text's n-grams, and each bucket's share of them."""
    for _, own in groups(texts):
        c, offsets = codes(own)
        space = c == SPACE
        found = [(n, b, _inside(space, n)) for n, b in grams(c, SIZES, BITS)]
        for k in range(len(own)):
            lo, hi = int(offsets[k]), int(offsets[k + 1])
            mine = [b[lo : max(lo, hi - n + 1)][ok[lo : max(lo, hi - n + 1)]] for n, b, ok in found]
            mine = np.concatenate(mine) if mine else np.empty(0, dtype=np.int32)
            b, count = np.unique(mine, return_counts=True)
            yield b, count / max(1, len(mine))


class Model:
    """One weight for each bucket, and a bias: the log odds of class 1 are the bag's mean weight plus the bias."""

    def __init__(self, weight: np.ndarray | None, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weight is None:
            return np.zeros(len(texts))
        out = np.zeros(len(texts))
        for at, own in groups(texts):
            c, offsets = codes(own)
            space = c == SPACE
            total, count = np.zeros(len(own)), np.zeros(len(own))
            for n, b in grams(c, SIZES, BITS):
                ok = _inside(space, n)
                # texts begin and end with a space, so no n-gram with only inner letters spans two texts,
                # but one may begin with a text's last space: it is left out
                ok[offsets[1:-1][offsets[1:-1] - 1 < len(ok)] - 1] = False
                total += sums(self.weight[b] * ok, offsets)
                count += sums(ok, offsets)
            out[at : at + len(own)] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def presence(bags_: Iterator[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """How many documents of each (fold, label) have each bucket; and, one place beyond the buckets, how many there are."""
    out = np.zeros((FOLDS, 2, (1 << BITS) + 1), dtype=np.int32)
    for b, y, f in zip(bags_, labels, folds, strict=True):
        out[f, y, b] += 1
        out[f, y, -1] += 1
    return out


def apart(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Standard errors between the shares of documents, (label, bucket), that have each bucket; 0 for rare ones."""
    both = found.sum(axis=0)
    share = both / size.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / size).sum())
    return np.where(both >= LEAST_DOCS, np.abs(found[1] / size[1] - found[0] / size[0]) / spread, 0.0)


def strengths(found: np.ndarray) -> np.ndarray:
    """``apart`` of each bucket, first over all folds and then with each fold left out; 0 where a class is empty."""
    total = found.sum(axis=0)
    out = []
    for left_out in [0, *found]:
        rest = total - left_out
        out.append(apart(rest[:, :-1], rest[:, -1]) if rest[:, -1].all() else np.zeros(found.shape[2] - 1))
    return np.array(out)


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.empty(0, dtype=np.int64)


class Shares:
    """A sparse matrix of shares: the entries' rows (in order), columns and values, held in the order of the columns as well."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape
        self._rows = _edges(row)
        by = np.argsort(column, kind="stable")
        self._row_by, self._value_by = row[by], value[by]
        ends = np.cumsum(np.bincount(column, minlength=1))
        used = np.flatnonzero(np.diff(ends, prepend=0))
        self._columns, self._column_ids = (ends - np.diff(ends, prepend=0))[used], used
        self._row_ids = row[self._rows]

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Shares:
        """From each row's columns and values."""
        sizes = [len(c) for c, _ in rows]
        stack = lambda k, kind: np.concatenate([np.asarray(r[k], dtype=kind) for r in rows]) if rows else np.empty(0, dtype=kind)
        return cls(np.repeat(np.arange(len(rows), dtype=np.int32), sizes), stack(0, np.int32), stack(1, np.float32), (len(rows), width))

    def part(self, rows: np.ndarray, columns: np.ndarray) -> Shares:
        """The given rows and columns alone, numbered in their order."""
        new_row, new_column = np.full(self.shape[0], -1, dtype=np.int32), np.full(self.shape[1], -1, dtype=np.int32)
        new_row[rows], new_column[columns] = np.arange(len(rows)), np.arange(len(columns))
        ok = (new_row[self.row] >= 0) & (new_column[self.column] >= 0)
        return Shares(new_row[self.row[ok]], new_column[self.column[ok]], self.value[ok], (len(rows), len(columns)))

    def times(self, v: np.ndarray) -> np.ndarray:
        """A sum for each row."""
        out = np.zeros(self.shape[0])
        if len(self.row):
            out[self._row_ids] = np.add.reduceat(self.value * v.astype(np.float32)[self.column], self._rows)
        return out

    def under(self, v: np.ndarray, squared: bool = False) -> np.ndarray:
        """A sum for each column, of the values or of their squares."""
        out = np.zeros(self.shape[1])
        if len(self.row):
            value = self._value_by * self._value_by if squared else self._value_by
            out[self._column_ids] = np.add.reduceat(value * v.astype(np.float32)[self._row_by], self._columns)
        return out


def train_jointly(x: Shares, y: np.ndarray, dim: int = DIM, steps: int = 200, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """The difference of the classes' logits that each column's trained embedding adds for each unit of its share."""
    size = np.bincount(y, minlength=2)
    weight = (0.5 / size)[y]  # classes weigh alike
    scale = 1 / np.maximum(x.under(weight, squared=True), 1e-12)
    rng = np.random.default_rng(seed)
    emb, soft, bias = np.zeros((x.shape[1], dim)), rng.normal(0, 1 / np.sqrt(dim), (dim, 2)), 0.0
    for _ in range(steps):
        line = emb @ (soft[:, 1] - soft[:, 0])
        wrong = weight * (1 / (1 + np.exp(-np.clip(x.times(line) + bias, -60, 60))) - y)  # of the softmax of two classes
        down = x.under(wrong)
        to_soft = emb.T @ down
        emb -= rate * (scale * down)[:, None] * (soft[:, 1] - soft[:, 0])[None, :] / np.sqrt(x.shape[1])
        soft += 0.05 * np.outer(to_soft, [1, -1]) / max(1.0, np.abs(to_soft).max())
        bias -= 2 * rate * wrong.sum()
    return emb @ (soft[:, 1] - soft[:, 0])


def border(z: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> tuple[float | None, float]:
    """The border of the fewest errors above which texts are toxic, its errors, the classes weighed by their true sizes; None: nothing is toxic."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    one, zero = (y == 1).sum(), (y == 0).sum()
    missed = (one - np.concatenate(([0], np.cumsum(y == 1)))) / one * sizes[1]
    false = np.concatenate(([0], np.cumsum(y == 0))) / zero * sizes[0]
    cost = missed + false
    cost[1:-1][np.diff(z) == 0] = np.inf  # texts that score alike stay together
    k = int(cost.argmin())
    if k == 0:
        return None, float(cost[0])
    return float((z[k - 1] + z[k]) / 2 if k < len(z) else z[-1] - 1), float(cost[k])


def fit_shares(x: Shares, y: np.ndarray, fold: np.ndarray, strength: np.ndarray, sizes: dict[int, int]) -> tuple[np.ndarray, float] | None:
    """Weights of the columns and the bias; ``strength`` as from ``strengths``, for the columns of the shares x."""

    def fitted(on: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = train_jointly(x.part(on, columns), y[on])
        full = np.zeros(x.shape[1])
        full[columns] = line
        z = x.times(full)
        unit = max(float(np.abs(z[on]).mean()), 1e-12)
        return line / unit, z / unit

    best = None
    for least in STRENGTHS:
        if not (strength[0] >= least).any():
            continue
        z = np.zeros(len(y))
        for f in range(FOLDS):
            columns, on = np.flatnonzero(strength[1 + f] >= least), np.flatnonzero(fold != f)
            if len(columns) and len(on) < len(y):
                z[fold == f] = fitted(on, columns)[1][fold == f]
        at, cost = border(z, y, sizes)
        if best is None or cost <= best[0]:
            best = cost, least, at
    if best is None:
        return None
    _, least, at = best
    columns = np.flatnonzero(strength[0] >= least)
    out = np.zeros(x.shape[1])
    out[columns] = fitted(np.arange(len(y)), columns)[0]
    return out, NEVER if at is None else -at


def chosen_grams(strength: np.ndarray) -> np.ndarray:
    """The buckets that some fold may choose."""
    return np.flatnonzero(strength.max(axis=0) >= min(STRENGTHS))


def shares(texts: list[str | None], place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The columns of each text's chosen buckets and their shares."""
    for b, share in bags(texts):
        at = place[b]
        yield at[at >= 0], share[at >= 0].astype(np.float32)


def as_model(buckets: np.ndarray, fitted: tuple[np.ndarray, float] | None) -> Model:
    if fitted is None:
        return Model(None, 0.0)
    out = np.zeros(1 << BITS, dtype=np.float32)
    out[buckets] = fitted[0]
    return Model(out, fitted[1])


def _place(buckets: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1)
    place[buckets] = np.arange(len(buckets))
    return place


def train(docs: DataFrame, labels: DataFrame, learn=not_fifth, per_class: int = PER_CLASS, **columns) -> Model:
    rows, sizes = sample(docs, labels, "toxic", per_class, learn, **columns)
    if rows is None or len(sizes) < 2:
        if rows is not None:
            rows.drop()
        return Model(None, 0.0)
    try:
        return _fit_rows(rows.df.select("y", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(FOLDS)).cast("int").alias("f"), "t"), sizes)
    finally:
        rows.drop()


def _fit_rows(rows: DataFrame, sizes: dict[int, int]) -> Model:
    wide = (1 << BITS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((FOLDS, 2, wide), dtype=np.int32)
        for batch in small(batches):
            found += presence((b for b, _ in bags(batch.column(2).to_pylist())), batch.column(0).to_numpy(), batch.column(1).to_numpy())
        flat = found.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used].astype(np.int64))], ["k", "n"])
        del found, flat, used
        give_back()

    ship(rows.sparkSession)
    # one row for each bucket that LEAST_DOCS documents have, at most 2 ** BITS + 1
    cells = [F.sum(F.when(F.floor(F.col("k") / wide) == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    counts = rows.mapInArrow(count, "k long, n long").groupBy((F.col("k") % wide).alias("b")).agg(F.sum("n").alias("n"), *cells).filter(F.col("n") >= LEAST_DOCS).toArrow()
    found = np.zeros((2 * FOLDS, wide), dtype=np.int32)  # 10 MB
    at = counts["b"].to_numpy()
    for c in range(2 * FOLDS):
        found[c, at] = counts[f"c{c}"].to_numpy()
    found = found.reshape(FOLDS, 2, wide)
    if not found[:, :, -1].sum(axis=0).all():
        return Model(None, 0.0)
    strength = strengths(found)
    buckets = chosen_grams(strength)
    if not len(buckets):
        return Model(None, 0.0)
    sent = rows.sparkSession.sparkContext.broadcast(_place(buckets))

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = list(shares(batch.column(2).to_pylist(), sent.value))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in own], pa.list_(pa.int32())), pa.array([s for _, s in own], pa.list_(pa.float32()))], ["y", "f", "at", "share"]
        )

    got = from_texts(rows, "y int, f int, at array<int>, share array<float>", send)
    y, fold = got["y"].to_numpy(), got["f"].to_numpy()
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.concatenate([c.value_lengths().to_numpy() for c in got["at"].chunks] or [np.empty(0, dtype=np.int32)]))
    flat = lambda c, kind: np.concatenate([x.flatten().to_numpy() for x in got[c].chunks] or [np.empty(0, dtype=kind)])
    x = Shares(row, flat("at", np.int32), flat("share", np.float32), (len(y), len(buckets)))
    del got, row
    return as_model(buckets, fit_shares(x, y, fold, strength[:, buckets], sizes))


def fit(texts: list[str | None], labels: list[int], sizes: dict[int, int] | None = None) -> Model:
    """The model of texts in memory; their folds go by turns."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0)
    order = np.argsort(y, kind="stable")
    fold = np.empty(len(y), dtype=np.int64)
    fold[order] = np.arange(len(y)) % FOLDS
    strength = strengths(presence((b for b, _ in bags(texts)), y, fold))
    buckets = chosen_grams(strength)
    if not len(buckets):
        return Model(None, 0.0)
    x = Shares.of(list(shares(texts, _place(buckets))), len(buckets))
    zero, one = np.bincount(y, minlength=2)
    return as_model(buckets, fit_shares(x, y, fold, strength[:, buckets], sizes or {0: int(zero), 1: int(one)}))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1).to_pylist()))], [id_col, "score"])

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, score double", make)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows whose text scores under ``limit``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda: lambda texts: (sent.value.scores(texts) < limit).tolist())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

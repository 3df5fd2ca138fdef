"""Quality classifier: Bradley-Terry pairwise ranking.

A text's features are shares of its characters, words and lines (``features``); no id, language or label is
among them.  A score linear in the standardized features is learned by logistic loss over all pairs of a good and a bad
text, from every labelled row that may be learned from (``train``).  The features of those rows are a stored table; each step
is one pass over it, in which Spark adds up the rows' features by class and by bins of the score, 1/32 wide or a little more.
Two bins stand for all pairs of their rows by their mean scores, so that all pairs count and only sums come to the driver; the
curvature for the next step comes from the same sums and from products of features in wider bins.
The threshold is the quantile of all labelled rows' scores, exact, that leaves the share of bad labels below.  What is returned
is a logistic of the distance to that quantile, moved so that a text on the quantile scores ``AT`` (0.3).

Defined cases: null and empty texts have features 0 and are scored like others; a label that is null or neither 0 nor 1 is
ignored, an id labelled both ways counts as 1, and all rows of a repeated id are learned from; without labelled rows of
both classes every text scores 0.5; repeated rows score alike; an empty table gives an empty result; extra
columns are ignored by ``score`` and carried along by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.llm._common import Tables, by_batch, give_back, id_remainder, keep_rows, table
from floorspan.llm._labelled import not_fifth, sample  # noqa: F401 (sample: for callers who have it from here)
from floorspan.llm._words import joined, windows, words
from floorspan.session import ship

AT = 0.3
GROUP_BYTES = 1 << 19

#: Classes of bytes whose shares are features.
_CLASSES = {
    "upper": lambda b: 0x41 <= b <= 0x5A,
    "lower": lambda b: 0x61 <= b <= 0x7A,
    "digit": lambda b: 0x30 <= b <= 0x39,
    "stop": lambda b: b in b".,;:",
    "shout": lambda b: b in b"!?",
    "symbol": lambda b: b in b"#*$%&<>@^~=+_\\/",
    "bar": lambda b: b in b"|",
    "bracket": lambda b: b in b"()[]{}\"'`-",
    "space": lambda b: b in b" \t",
    "line": lambda b: b == 10,
    "far": lambda b: b >= 0x80,
}
_CODE = np.zeros(256, dtype=np.uint8)
for _k, _is in enumerate(_CLASSES.values()):
    for _b in range(256):
        if _is(_b):
            _CODE[_b] = _k + 1
N_FEATURES = len(_CLASSES) + 9


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES))
    group: list[bytes] = []
    at = held = 0
    for i, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(group[-1])
        if held >= GROUP_BYTES or i == len(texts) - 1:
            out[at : i + 1] = _group(group)
            at, held, group = i + 1, 0, []
    return out


def _group(group: list[bytes]) -> np.ndarray:
    out = np.zeros((len(group), N_FEATURES))
    raw, offsets = joined(group)
    kinds = _CODE[np.frombuffer(raw, dtype=np.uint8)]
    starts, ends, hashes = words(raw.lower())
    first = np.searchsorted(starts, offsets)
    n = len(_CLASSES)
    for k, text in enumerate(group):
        if not text:
            continue
        out[k, :n] = np.bincount(kinds[offsets[k] : offsets[k + 1] - 1], minlength=n + 1)[1:] / len(text)
        lo, hi = int(first[k]), int(first[k + 1])
        if hi == lo:
            continue
        h = hashes[lo:hi]
        size = (ends[lo:hi] - starts[lo:hi]).astype(np.float64)
        _, count = np.unique(h, return_counts=True)
        out[k, n] = np.log1p(hi - lo)
        out[k, n + 1] = size.mean()
        out[k, n + 2] = size.std()
        out[k, n + 3] = len(count) / (hi - lo)
        out[k, n + 4] = count.max() / (hi - lo)
        runs = windows(h, 3)
        out[k, n + 5] = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[k, n + 6] = 1 - len(set(lines)) / max(1, len(lines))
        out[k, n + 7] = np.log1p((hi - lo) / max(1, len(lines)))
        out[k, n + 8] = np.mean(h[1:] == h[:-1]) if hi - lo > 1 else 0
    return out


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray, threshold: float, unit: float):
        self.mean, self.spread, self.weight, self.threshold, self.unit = mean, spread, weight, threshold, unit

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weight

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(texts), 0.5)
        z = (self.raw(features(texts)) - self.threshold) / self.unit + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


#: Keys and sums of values by key, over the rows of one or more batches of classes and features.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
BIN, MOST_BINS = 1 / 32, 8192
#: Bins to a wide one, and how far wide ones go from a score of 0; the last holds all beyond.
WIDE, FAR = 16, 48
PASS_ROWS = 1 << 16


def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    return keys[at], np.add.reduceat(values[order], at, axis=0) if len(keys) else values


def pair_loss(n: dict[int, np.ndarray], s: dict[int, np.ndarray], z: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Mean logistic loss of all pairs of a good and a bad row, its gradient, the part of its curvature between bins, and the curvature of a row
    of each bin, from each class's bins: rows, mean score and sums of features."""
    loss, cross = 0.0, np.zeros((N_FEATURES, N_FEATURES))
    slope, bend = ({c: np.zeros(len(n[c])) for c in (0, 1)} for _ in range(2))
    for lo in range(0, len(n[1]), 256):
        part, own = slice(lo, lo + 256), n[1][lo : lo + 256]
        gap = np.clip(s[1][part, None] - s[0][None, :], -60, 60)
        loss += float(own @ np.log1p(np.exp(-gap)) @ n[0])
        wrong = 1 / (1 + np.exp(gap))  # the probability given to the wrong order
        slope[1][part] = wrong @ n[0]
        slope[0] += own @ wrong
        wrong *= 1 - wrong
        bend[1][part] = wrong @ n[0]
        bend[0] += own @ wrong
        cross += z[1][part].T @ (wrong @ z[0])
    pairs = n[1].sum() * n[0].sum()
    between = sum((z[c] * (bend[c] / n[c])[:, None]).T @ z[c] for c in (0, 1)) - cross - cross.T
    return loss / pairs, (slope[0] @ z[0] - slope[1] @ z[1]) / pairs, between / pairs, {c: bend[c] / pairs for c in (0, 1)}


def learn_weights(add: Callable[[Step, int], tuple[np.ndarray, np.ndarray]], decay: float = 1e-3, most: int = 30) -> Model:
    """The ranking of all rows that ``add`` adds up, its threshold and unit left at 0 and 1; without rows of both classes it is empty."""
    k, sums = add(lambda y, x: by_key(y, np.hstack([np.ones((len(y), 1)), x, x * x])), 1 + 2 * N_FEATURES)
    if k.tolist() != [0, 1]:
        return Model(np.empty(0), np.empty(0), np.empty(0), 0.0, 1.0)
    total = sums.sum(axis=0) / sums[:, 0].sum()
    mean = total[1 : 1 + N_FEATURES]
    spread = np.sqrt(np.maximum(total[1 + N_FEATURES :] - mean * mean, 0)) + 1e-9
    standard = lambda x: np.clip((x - mean) / spread, -8, 8)
    wide = lambda bin_: np.clip(bin_ // WIDE, -FAR, FAR)
    products = 1 << 40  # keys from here on are of products

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Loss, gradient and curvature at given weights, and the deviation of the scores."""
        width = max(BIN, 16 * float(np.abs(w).sum()) / MOST_BINS)

        def bins(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = standard(x)
            s = z @ w
            bin_ = np.floor(s / width).astype(np.int64)
            keys, sums = by_key(bin_ * 2 + y, np.hstack([np.ones((len(y), 1)), s[:, None], z, (s * s)[:, None]]))
            group = (wide(bin_) + FAR) * 2 + y
            order = np.argsort(group, kind="stable")
            found, first = np.unique(group[order], return_index=True)
            zz = [part.T @ part for part in np.split(z[order], first[1:])]
            more = np.zeros((len(found) * N_FEATURES, sums.shape[1]))
            more[:, 2:-1] = np.concatenate(zz)
            own = products + found[:, None] * N_FEATURES + np.arange(N_FEATURES)
            return np.concatenate([keys, own.reshape(-1)]), np.vstack([sums, more])

        keys, v = add(bins, 3 + N_FEATURES)
        fine, zz = keys < products, v[keys >= products, 2:-1].reshape(-1, N_FEATURES, N_FEATURES)
        of = [fine & (keys % 2 == c) for c in (0, 1)]
        n, s, z = ({c: f(v[of[c]]) for c in (0, 1)} for f in (lambda v: v[:, 0], lambda v: v[:, 1] / v[:, 0], lambda v: v[:, 2:-1]))
        loss, slope, curve, bend = pair_loss(n, s, z)
        for i, group in enumerate(((keys[keys >= products] - products) // N_FEATURES)[::N_FEATURES].tolist()):
            c = group % 2
            own = wide(keys[of[c]] // 2) + FAR == group // 2
            within = zz[i] - (z[c][own] / n[c][own, None]).T @ z[c][own]
            curve += within * float(np.average(bend[c][own], weights=n[c][own]))
        everything = v[fine].sum(axis=0)
        deviation = np.sqrt(max(everything[-1] / everything[0] - (everything[1] / everything[0]) ** 2, 0.0))
        return loss + decay / 2 * float(w @ w), slope + decay * w, curve + decay * np.eye(N_FEATURES), float(deviation)

    w = np.zeros(N_FEATURES)
    loss, slope, curve, deviation = at(w)
    for _ in range(most):  # Newton's method; the loss is convex, so that the start doesn't matter
        if np.abs(slope).max() < 1e-5:
            break
        move, long = -np.linalg.solve(curve, slope), 1.0
        new = at(w + move)
        while new[0] > loss + 1e-4 * long * float(slope @ move) + 1e-9 and long > 1e-3:
            long /= 2
            new = at(w + long * move)
        if new[0] > loss + 1e-9:
            break  # as low as sums in bins can tell
        w, (loss, slope, curve, deviation) = w + long * move, new
    return Model(mean, spread, w, 0.0, max(deviation, 1e-9) / 2)


def last_below(n: int, sizes: dict[int, int]) -> int:
    """The place, from 0, of the last of n scores that the share of class 0 leaves below the threshold."""
    return min(max(int(np.ceil(n * (sizes[0] / (sizes[0] + sizes[1]) - 1e-12))) - 1, 0), n - 2)


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> Model:
    """The same over features in memory; ``sizes`` of the classes give the share below the threshold."""
    y = np.asarray(y, dtype=np.int64)
    model = learn_weights(lambda step, width: step(y, x) if len(y) else (y, np.empty((0, width))))
    if len(model.weight):
        scores, k = np.sort(model.raw(x)), last_below(len(y), sizes)
        model.threshold = float(scores[k] + scores[k + 1]) / 2  # between the last below the quantile and the next
    return model


def between(scores: DataFrame, k: int) -> float:
    """The middle between the k-th value of the column s, from 0, and the next, exactly: by counts in ever narrower steps."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    before, after = 0, hi
    while hi > lo:
        step = F.least(F.floor((F.col("s") - lo) / (hi - lo) * 4096), F.lit(4095))
        rows = scores.filter(F.col("s").between(lo, hi)).groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("b").collect()
        for i, r in enumerate(rows):
            if before + r.n > k:
                break
            before += r.n
        after = rows[i + 1].lo if i + 1 < len(rows) else after
        lo, hi, n = r.lo, r.hi, r.n
        if lo == hi:
            return lo if before + n > k + 1 else (lo + after) / 2
    return lo


def adder(rows: DataFrame) -> Callable[[Step, int], tuple[np.ndarray, np.ndarray]]:
    """Adds up by key over a table (y, x): in the tasks first, then by Spark."""
    ship(rows.sparkSession)

    def add(step: Step, width: int) -> tuple[np.ndarray, np.ndarray]:
        names = [f"v{i}" for i in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def out() -> pa.RecordBatch:
                y = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
                keys, values = step(y, np.concatenate([_matrix(b.column(1)) for b in held]))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, np.ascontiguousarray(values.T, dtype=np.float64))], ["k", *names])

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= PASS_ROWS:
                    yield out()
            if held:
                yield out()

        parts = rows.select("y", "x").mapInArrow(run, "k long, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in names)).toArrow().sort_by("k")
        return got["k"].to_numpy(), np.column_stack([got[c].to_numpy() for c in names])

    return add


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, learn=not_fifth, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learned from all labelled rows that ``learn`` lets through; the texts stay where they are, only their features meet the labels."""
    known = (
        labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
        .filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & learn(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    texts = docs.filter(F.col(id_col).isNotNull() & learn(F.col(id_col))).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    lists = pa.list_(pa.float64())

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1).to_pylist())), lists)], ["i", "x"])

    with Tables() as tables:
        rows = tables.store(by_batch(texts, f"i {kind}, x array<double>", make).join(known, "i").select("y", "x"))
        model = learn_weights(adder(rows))
        if not len(model.weight):
            return model
        sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0))))], ["s"])
            give_back()

        scores = tables.store(rows.select("x").mapInArrow(raw, "s double"))
        model.threshold = between(scores, last_below(sum(sizes.values()), sizes))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1).to_pylist()))], [id_col, "score"])

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, score double", make)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = AT) -> DataFrame:
    """Rows whose text scores ``least`` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda: lambda texts: (sent.value.scores(texts) >= least).tolist())


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))

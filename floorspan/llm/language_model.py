"""LM scoring: a gated recurrent language model with a class-factored output softmax.

Events are the words of the training texts, one end of text, and for each tail class one unseen word.  The
``HEAD`` most frequent words stand in classes of ``WIDTH`` by rank; all others fall into ``TAILS`` tail classes by
the hash of their first bytes.  P(word | state) is the softmax probability of its class times, in a head
class, the softmax probability within the class, and in a tail class (c + 1) / Z, with c the word's training
count and Z the sum of c + 1 over the class's words plus 1 for an unseen one.  So the probabilities of all
events sum to 1, and any text has a probability.

Word counts cover all training texts and are added up by Spark.  The network (a GRU, numpy) reads every
training text once, in ``ROUNDS`` of growing disjoint shares: in a round each task trains on its own texts from
the same weights, by back-propagation truncated to windows of ``STEPS`` words with the state carried from
window to window, and the tasks' weights are averaged in two levels by Spark, weighed by words (a fixed number
of floats for each task, never gathered in one place).  Scoring carries the state of every text across windows
from its first word to its end, many texts side by side.  As tasks train alone within a round, the weights depend on how the
rows are dealt to tasks: the same files read with the same settings give the same weights, another split gives others (about
0.09 decimal logarithms a token apart at 200 texts, less with more).

Counts of the ``KNOWN`` most frequent words (of at most 40 bytes) are broadcast; all other words leave the
scoring pass as (row, word, times) and meet the full count table in a join.

Defined cases: null and empty texts are the end alone; repeated rows are each scored; without training texts
all words are unseen and the network is untrained; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.llm._common import ascii_lower, cut, frequent, id_remainder, table
from floorspan.llm._words import mix
from floorspan.session import ship

HEAD, WIDTH, TAILS, HIDDEN = 2048, 64, 32, 24
KNOWN, KNOWN_BYTES = 3 << 17, 40
STEPS, LANES = 16, 512
#: Softmax rows at a time, so that they stay in the processor's cache.
BLOCK = 512
#: Each round trains on the rows whose hash of the id, modulo 16, is in its share.
ROUNDS = ((0, 1), (1, 4), (4, 16))
POOL_TOKENS = 3 << 20
END = b""  # no word is empty
PREFIX = 3
COUNTER_ENTRIES = 800_000
#: Bytes of texts whose words are looked up at a time.
TEXT_BYTES = 1 << 20


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:PREFIX]) % TAILS


# -- counts ----------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the column text: the words' counts, and the number of texts for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(ascii_lower(text).split())
                held[END] += 1
                if len(held) > COUNTER_ENTRIES:
                    yield out()
        if held:
            yield out()

    ship(texts.sparkSession)
    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# -- words -----------------------------------------------------------------------------------------


class Words:
    """Where the words of some texts lie in one buffer, without a Python step for each word."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n" + b"\n".join(texts) + b"\n" * 9  # eight bytes can be read from any place of a word
        a = np.frombuffer(self.buf, dtype=np.uint8)
        inside = ((a - np.uint8(9)) > 4) & (a != 32)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.length = self.end - self.start
        #: how many words each text has
        self.per_text = np.diff(np.searchsorted(self.start, np.cumsum([1, *(len(t) + 1 for t in texts)])))

    def eight(self, which: np.ndarray | slice, block: int) -> np.ndarray:
        """The block-th eight bytes of words that reach into it, as numbers; zeros fill them up."""
        at = self.start[which] + 8 * block
        got = np.ndarray((len(self.buf) - 7,), dtype="V8", buffer=self.buf, strides=(1,))[at].view("<u8")
        return got & _FIRST_BYTES[np.minimum(self.end[which] - at, 8)]

    def hashes(self, most: int) -> np.ndarray:
        """Hashes of the words by their first ``most`` bytes and their lengths."""
        out = mix(self.eight(slice(None), 0) + self.length.astype(np.uint64) * _ODD)
        for block in range(1, -(-most // 8)):
            which = np.flatnonzero(self.length > 8 * block)
            if not len(which):
                break
            out[which] = mix(out[which] * _ODD + self.eight(which, block))
        return out

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        return [self.buf[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """The place of each word in a list of distinct words of at most KNOWN_BYTES: a table by hash whose hits are compared byte for byte."""

    BITS = 20

    def __init__(self, listed: list[bytes]):
        words, named = Words(listed), np.flatnonzero([len(w) > 0 for w in listed])
        hashes = words.hashes(KNOWN_BYTES)
        order = np.argsort(hashes, kind="stable")
        self.sorted = np.append(hashes[order], np.uint64(2**64 - 1))
        self.place = np.append(named[order], -1).astype(np.int32)
        self.first = np.searchsorted(self.sorted[:-1], np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)).astype(np.int32)
        self.length = np.array([len(w) for w in listed] or [-1], dtype=np.int32)
        self.blocks = [np.zeros(len(self.length), dtype=np.uint64) for _ in range(-(-KNOWN_BYTES // 8))]
        for b, block in enumerate(self.blocks):
            which = np.flatnonzero(words.length > 8 * b)
            block[named[which]] = words.eight(which, b)
        #: words of equal hashes, of which the table finds one
        self.twins = {w: i for i, w in enumerate(listed)} if (self.sorted[1:-1] == self.sorted[:-2]).any() else {}

    def find(self, words: Words) -> np.ndarray:
        """The place of each word, -1 for words that aren't listed."""
        h = words.hashes(KNOWN_BYTES)
        at = self.first[h >> np.uint64(64 - self.BITS)]
        behind = np.flatnonzero(self.sorted[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.sorted[at[behind]] < h[behind]]
        out = self.place[at]
        same = (self.sorted[at] == h) & (self.length[out] == words.length) & (self.blocks[0][out] == words.eight(slice(None), 0))
        for b, block in enumerate(self.blocks[1:], 1):
            reach = np.flatnonzero(same & (words.length > 8 * b))
            if not len(reach):
                break
            same[reach] = words.eight(reach, b) == block[out[reach]]
        out[~same] = -1
        if self.twins:
            lost = np.flatnonzero(out < 0)
            out[lost] = [self.twins.get(w, -1) for w in words.bytes_of(lost)]
        return out


class Vocabulary:
    """What every task needs of the counts; its size is bounded by KNOWN and TAILS."""

    def __init__(self, known: list[tuple[bytes, int]], n: int, v: int, z: list[int]):
        self.n, self.v, self.z = n, v, z
        self.count = np.array([c for _, c in known], dtype=np.int64)
        head = [w for w, _ in known[:HEAD]]
        if END not in head:  # the end is always a head word
            head = [*head[: HEAD - 1], END]
        self.head_size = len(head)
        place = {w: i for i, w in enumerate(head)}
        #: the symbol of each known word: a head word, or a tail class after them
        self.symbol = np.array([place[w] if w in place else HEAD + tail_class(w) for w, _ in known], dtype=np.int32)
        self.index = {w: i for i, (w, _) in enumerate(known)}
        self.places = Places([w for w, _ in known])
        self.end = place[END]
        counts = np.zeros(HEAD)
        for w, c in known:
            if w in place:
                counts[place[w]] = c
        self.head_count = counts


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts.filter(F.length("word") <= KNOWN_BYTES), "c", KNOWN)
    known = sorted(((bytes(r.word), r.c) for r in top.toLocalIterator()), key=lambda x: (-x[1], x[0]))
    head = {w for w, _ in known[:HEAD]} | {END}
    # the sums of tail classes: over all words, less the head's
    group = F.crc32(F.substring("word", 1, PREFIX)) % TAILS
    z = [1] * TAILS
    for r in counts.groupBy(group.alias("t")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        z[r.t] += r.s
    for w, c in known:
        if w in head:
            z[tail_class(w)] -= c + 1
    return Vocabulary(known, total.n or 0, total.v, [max(1, x) for x in z])


# -- network ---------------------------------------------------------------------------------------

N_CLASSES = HEAD // WIDTH + TAILS
SHAPES = {
    "x": (HEAD + TAILS, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "k": (HIDDEN, N_CLASSES), "kb": (N_CLASSES,),
    "w": (HEAD // WIDTH, HIDDEN, WIDTH), "wb": (HEAD // WIDTH, WIDTH),
}
N_FLOATS = sum(math.prod(s) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + math.prod(s)].reshape(s)
        at += math.prod(s)
    return out


def initial(vocab: Vocabulary, seed: int = 3) -> np.ndarray:
    """Small random weights, and biases that give the counts' own probabilities."""
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, N_FLOATS).astype(np.float32)
    p = unpack(flat)
    p["b"][:] = 0
    p["u"] *= 2
    per = (vocab.head_count + 0.5).reshape(-1, WIDTH)
    p["wb"][:] = np.log(per / per.sum(axis=1, keepdims=True))
    share = np.concatenate((per.sum(axis=1), np.array(vocab.z, dtype=np.float64)))
    p["kb"][:] = np.log(share / share.sum())
    return flat


#: Factors of the gates' inputs: the sigmoid is 1 / (1 + exp(-x)), tanh is 1 - 2 / (1 + exp(2 x)).
_FACTORS = np.array([-1, -1, 2], dtype=np.float32)[:, None, None]


def by_gate(a: np.ndarray) -> np.ndarray:
    """Rows of all gates' values as an array for each gate, by its factor."""
    return np.multiply(a.reshape(len(a), 3, HIDDEN).swapaxes(0, 1), _FACTORS, order="C")


def gated(u: np.ndarray, x: np.ndarray, h: np.ndarray):
    """One step of the gated unit from states h; recurrent weights and input gates (with bias) by gate.  exp may overflow: 1 / (1 + inf) is 0."""
    g = np.matmul(h, u)
    rz, gn = g[:2], g[2]
    rz += x[:2]
    np.exp(rz, out=rz)
    rz += 1
    r, z = np.reciprocal(rz, out=rz)
    n = r * gn
    n += x[2]
    np.exp(n, out=n)
    n += 1
    np.divide(-2, n, out=n)
    n += 1
    out = h - n
    out *= z
    out += n
    return out, r, z, n, gn


def step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray):
    """One step of the gated unit from input gates x (with bias) and states h."""
    with np.errstate(over="ignore"):
        return gated(by_gate(p["u"]), by_gate(x), h)


_ONES = np.ones((max(WIDTH, HEAD // WIDTH + TAILS), 1), dtype=np.float32)


def with_one(h: np.ndarray) -> np.ndarray:
    """States with a column of ones, which the bias is multiplied with."""
    return np.concatenate((h, np.ones((len(h), 1), dtype=h.dtype)), axis=1)


class Output:
    """The output weights with their biases as a last row, and whether any states (all in -1 to 1) can make a logit that exp doesn't bear."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.k = np.concatenate((p["k"], p["kb"][None]))
        self.w = np.concatenate((p["w"], p["wb"][:, None]), axis=1)
        self.safe = max(float(np.abs(self.k).sum(axis=0).max()), float(np.abs(self.w).sum(axis=1).max())) < 60

    def exp_and_sum(self, h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits and their sums by row; both up to a factor of the row."""
        a = h @ weights
        if not self.safe:
            a -= a.max(axis=1, keepdims=True)
        e = np.exp(a, out=a)
        return e, (e @ _ONES[: e.shape[1]])[:, 0]


def symbol_class(y: np.ndarray) -> np.ndarray:
    return np.where(y < HEAD, y // WIDTH, y - (HEAD - HEAD // WIDTH)).astype(np.uint8)


def by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts classes together, and where each head class begins in it; one more entry at the end."""
    order = np.argsort(group, kind="stable")  # of bytes: a counting sort
    return order, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=N_CLASSES)[: HEAD // WIDTH])))


def log_prob(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, out: Output | None = None) -> np.ndarray:
    """Natural log probability of each symbol given its state; a tail class's own, without the word in it."""
    out = out or Output(p)
    h = h if h.shape[1] > HIDDEN else with_one(h)
    group = symbol_class(y)
    chance = np.empty(len(y))
    for lo in range(0, len(y), BLOCK):
        e, total = out.exp_and_sum(h[lo : lo + BLOCK], out.k)
        chance[lo : lo + BLOCK] = e[np.arange(len(e)), group[lo : lo + BLOCK]] / total
    order, edges = by_class(group)
    order = order[: edges[-1]]
    hs, ys, inner, rows = h[order], y[order] % WIDTH, np.empty(len(order)), np.arange(len(order))
    for c in range(HEAD // WIDTH):
        for lo in range(edges[c], edges[c + 1], BLOCK):
            hi = min(lo + BLOCK, edges[c + 1])
            e, total = out.exp_and_sum(hs[lo:hi], out.w[c])
            inner[lo:hi] = e[rows[: hi - lo], ys[lo:hi]] / total
    chance[order] *= inner
    return np.log(np.maximum(chance, 1e-300))


def _ones(n: int) -> np.ndarray:
    return np.ones((1, n), dtype=np.float32)


class Trainer:
    """Truncated back-propagation over lanes of a stream of symbols."""

    def __init__(self, flat: np.ndarray, rate: float = 0.01):
        self.flat = flat.astype(np.float32).copy()
        self.p, self.rate, self.t = unpack(self.flat), rate, 0
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.pm, self.pv = unpack(self.m), unpack(self.v)
        self.words = 0

    def train(self, stream: np.ndarray, end: int) -> None:
        """Read a stream of texts, each closed by the end; its lanes are stretches of it, the first ones a word longer if need be."""
        if not len(stream):
            return
        lanes = int(max(1, min(LANES, max(8, len(stream) // 1500), len(stream) // 2)))
        length, more = divmod(len(stream), lanes)
        y = np.full((length + (more > 0), lanes), end, dtype=stream.dtype)
        if more:
            y[:, :more] = stream[: more * (length + 1)].reshape(more, length + 1).T
        y[:length, more:] = stream[more * (length + 1) :].reshape(lanes - more, length).T
        x = np.vstack([np.full((1, lanes), end, dtype=y.dtype), y[:-1]])
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for lo in range(0, length, STEPS):
            hi = lo + STEPS if lo + STEPS < length else len(y)
            h = self._window(x[lo:hi], y[lo:hi], h, end, min(hi * lanes, len(stream)) - lo * lanes)
        self.words += len(stream)

    def _window(self, x, y, h, end, live: int | None = None):
        """``live``: so many words count, in the order of steps and lanes; the rest fills the last step up."""
        p, (steps, lanes) = self.p, x.shape
        keep = (x != end).astype(np.float32)[:, :, None]  # a text begins from the zero state
        xg, u = np.take(by_gate(p["x"] + p["b"]), x, axis=1), by_gate(p["u"])
        hs, before, saved, out = np.ones((steps, lanes, HIDDEN + 1), dtype=np.float32), np.empty((steps, lanes, HIDDEN), dtype=np.float32), [], Output(p)
        with np.errstate(over="ignore"):
            for t in range(steps):
                h0 = np.multiply(h, keep[t], out=before[t])
                h, *gates = gated(u, xg[:, t], h0)
                hs[t, :, :HIDDEN] = h
                saved.append(gates)
        flat_h, flat_y = hs.reshape(-1, HIDDEN + 1), y.reshape(-1)
        total = len(flat_y) if live is None else live
        flat_h, flat_y = flat_h[:total], flat_y[:total]
        grad = {k: np.zeros(SHAPES[k], dtype=np.float32) for k in SHAPES if k != "x"}
        group, rows = symbol_class(flat_y), np.arange(total)
        dh_full = np.zeros((steps * lanes, HIDDEN), dtype=np.float32)
        dh_out = dh_full[:total]
        for lo in range(0, total, BLOCK):
            h_part, g_part = flat_h[lo : lo + BLOCK], group[lo : lo + BLOCK]
            d, sums = out.exp_and_sum(h_part, out.k)
            d *= (1 / sums)[:, None]
            d[rows[: len(d)], g_part] -= 1
            both = h_part.T @ d
            grad["k"] += both[:-1]
            grad["kb"] += both[-1]
            dh_out[lo : lo + BLOCK] = d @ p["k"].T
        grad["k"] /= total
        grad["kb"] /= total
        order, edges = by_class(group)
        order = order[: edges[-1]]
        hc, yc, inner = flat_h[order], flat_y[order] % WIDTH, np.empty((len(order), HIDDEN), dtype=np.float32)
        for c in range(HEAD // WIDTH):
            for lo in range(edges[c], edges[c + 1], BLOCK):
                hi = min(lo + BLOCK, edges[c + 1])
                d, sums = out.exp_and_sum(hc[lo:hi], out.w[c])
                d *= (1 / sums)[:, None]
                d[rows[: hi - lo], yc[lo:hi]] -= 1
                both = hc[lo:hi].T @ d
                grad["w"][c] += both[:-1]
                grad["wb"][c] += both[-1]
                inner[lo:hi] = d @ p["w"][c].T
        grad["w"] /= total
        grad["wb"] /= total
        dh_out[order] += inner
        dh_out *= np.float32(1 / total)
        dh_out = dh_full.reshape(steps, lanes, HIDDEN)
        # by what the gates' inputs were: the state's part of n, r, z, and all of n
        d = np.empty((4, steps, lanes, HIDDEN), dtype=np.float32)
        back = np.ascontiguousarray(p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0)[[2, 0, 1]])
        dh = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            r, z, n, gn = saved[t]
            d_state, dr, dz, dn = d[:, t]
            dh += dh_out[t]
            through = dh * z
            dh -= through
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh
            np.multiply(dn, r, out=d_state)
            np.subtract(0.5, np.multiply(r, 0.5, out=r), out=dr)  # gn came with the factor 2
            dr *= gn
            dr *= d_state
            np.subtract(before[t], n, out=dz)
            dz *= z
            dz *= dh
            parts = np.matmul(d[:3, t], back)
            dh = through
            for part in parts:
                dh += part
            dh *= keep[t]
        d = d.reshape(4, steps * lanes, HIDDEN)
        of_state = np.matmul(before.reshape(-1, HIDDEN).T, d[:3])
        grad["u"] = np.concatenate((of_state[1], of_state[2], of_state[0]), axis=1)
        grad["b"] = np.matmul(_ones(steps * lanes), d[1:]).reshape(-1)
        self._update(grad, x.reshape(-1), d[1:])
        return h

    def _update(self, grad, x, dx) -> None:
        self.t += 1
        rate = self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        size = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip = min(1.0, 1.0 / (size + 1e-9))
        for k, g in grad.items():
            g = g * clip
            self.pm[k] *= 0.9
            self.pm[k] += 0.1 * g
            self.pv[k] *= 0.99
            self.pv[k] += 0.01 * g * g
            self.p[k] -= rate * self.pm[k] / (np.sqrt(self.pv[k]) + 1e-6)
        # the input table: only the rows met move, each by the root of its squares so far
        used, g = sums_by_symbol(x, dx)
        squares = self.pv["x"][used]
        squares += g * g
        self.pv["x"][used] = squares
        self.p["x"][used] -= 5 * self.rate * g / (np.sqrt(squares) + 1e-7)


#: A symbol met more often in a window is summed by itself, the others together.
OFTEN = 16


def sums_by_symbol(x: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols met, and the sums of their rows of all gates; dx has an array for each gate."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    met = x[order]
    at = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
    times = np.diff(at, append=len(x))
    at, times = (v[np.argsort(-times, kind="stable")] for v in (at, times))
    rows, sums = np.take(np.concatenate(dx, axis=1), order, axis=0), np.zeros((len(at), 3 * HIDDEN), dtype=np.float32)
    often = int(np.searchsorted(-times, -OFTEN, side="left"))
    ones = _ones(int(times[0]))
    for i in range(often):
        sums[i] = ones[:, : times[i]] @ rows[at[i] : at[i] + times[i]]
    for k in range(int(times[often]) if often < len(at) else 0):
        more = int(np.searchsorted(-times, -k, side="left"))  # so many are met more than k times
        sums[often:more] += np.take(rows, at[often:more] + k, axis=0)
    return met[at], sums


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in blocks of about TEXT_BYTES, each with the number of its first text."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(ascii_lower(text))
        size += len(held[-1])
        if size >= TEXT_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _symbols(words: Words, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts' words, each text closed by its end; where texts begin among them; and the words' places among the known ones, -1 for others."""
    at = vocab.places.find(words)
    sizes = words.per_text + 1
    ends = np.cumsum(sizes) - 1
    of_words = vocab.symbol[at] if len(vocab.symbol) else np.empty(len(at), dtype=np.int32)
    rest = np.flatnonzero(at < 0)
    if len(rest):
        length = np.minimum(words.length[rest], PREFIX)
        begin, back = np.unique((words.eight(rest, 0) & _FIRST_BYTES[length]) | (length.astype(np.uint64) << np.uint64(8 * PREFIX)), return_inverse=True)
        of_words[rest] = np.array([HEAD + tail_class(int(b).to_bytes(PREFIX + 1, "little")[: int(b) >> 8 * PREFIX]) for b in begin], dtype=np.int32)[back]
    out = np.full(len(at) + len(sizes), vocab.end, dtype=np.int32)
    is_word = np.ones(len(out), dtype=bool)
    is_word[ends] = False
    out[is_word] = of_words
    return out, ends - words.per_text, at


BLOCKS = 32


def train_round(texts: DataFrame, sent_vocab, flat: np.ndarray, rate: float) -> np.ndarray:
    """Weights after each task has trained on its texts from ``flat``, averaged by words."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(flat)
    block = -(-N_FLOATS // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, trainer = sent_vocab.value, Trainer(sent.value, rate)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, block_texts in text_blocks(batch.column(0).to_pylist()):
                held.append(_symbols(Words(block_texts), vocab)[0])
                size += len(held[-1])
                if size >= POOL_TOKENS:
                    trainer.train(np.concatenate(held), vocab.end)
                    held, size = [], 0
        if held:
            trainer.train(np.concatenate(held), vocab.end)
        if trainer.words:
            if not np.isfinite(trainer.flat).all():
                raise FloatingPointError("training left the weights of a task without finite values")
            task = TaskContext.get().partitionId()
            vectors = [trainer.flat[i * block : (i + 1) * block].astype(np.float64) * trainer.words for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array([float(trainer.words)] * BLOCKS), pa.array([v.tobytes() for v in vectors], pa.binary())],
                ["task", "block", "words", "v"],
            )

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), dtype=np.float64) for v in t["v"])
        return pa.table({"block": t["block"].slice(0, 1), "words": pa.array([float(np.sum(t["words"].to_numpy()))]), "v": pa.array([total.tobytes()], pa.binary())})

    ship(spark)
    parts = texts.mapInArrow(run, "task long, block int, words double, v binary")
    salts = max(1, math.isqrt(max(1, texts.rdd.getNumPartitions())))
    half = parts.withColumn("salt", F.col("task") % salts).groupBy("block", "salt").applyInArrow(add, "block int, words double, v binary")
    rows = half.groupBy("block").applyInArrow(add, "block int, words double, v binary").collect()  # BLOCKS rows
    if len(rows) < BLOCKS:
        return flat
    return np.concatenate([np.frombuffer(r.v, dtype=np.float64) / r.words for r in sorted(rows, key=lambda r: r.block)]).astype(np.float32)


# -- scoring ---------------------------------------------------------------------------------------


def score_pool(p: dict[str, np.ndarray], pool: list[np.ndarray], end: int, lanes: int = 1024, steps: int = 16) -> np.ndarray:
    """Natural log probability of each symbol sequence; its state runs from its first to its last symbol."""
    out = np.zeros(len(pool))
    order = np.argsort([-len(s) for s in pool], kind="stable")
    gates, u, output = by_gate(p["x"] + p["b"]), by_gate(p["u"]), Output(p)
    for lo in range(0, len(order), lanes):
        own = order[lo : lo + lanes]
        lengths = np.array([len(pool[i]) for i in own])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        flat = np.concatenate([*(pool[i] for i in own), np.full(steps, end, dtype=np.int32)])
        h = np.zeros((len(own), HIDDEN), dtype=np.float32)
        last = np.full((1, len(own)), end, dtype=np.int32)
        at = 0
        while at < lengths[0]:
            live = int(np.searchsorted(-lengths, -at, side="left"))  # lengths fall, so the live lanes come first
            left = lengths[:live] - at
            # few lanes take more steps at once, up to the end of the first that ends
            width = int(min(left[0], max(steps, min(left[-1], lanes * steps // live))))
            y = flat[(starts[:live] + at)[None, :] + np.arange(width)[:, None]]  # what follows a lane's end counts nothing
            xg = np.take(gates, np.concatenate((last[:, :live], y[:-1])), axis=1)
            hs = np.ones((width, live, HIDDEN + 1), dtype=np.float32)
            h = h[:live]
            with np.errstate(over="ignore"):
                for t in range(width):
                    h = gated(u, xg[:, t], h)[0]
                    hs[t, :, :HIDDEN] = h
            last = y[-1:]
            got = log_prob(p, hs.reshape(-1, HIDDEN + 1), y.reshape(-1), output).reshape(width, live)
            if left[-1] < width:
                got[np.arange(width)[:, None] >= left[None, :]] = 0
            out[own[:live]] += got.sum(axis=0)
            at += width
    return out


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    sent_vocab, sent = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(flat)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["uid", "id", "n_tokens", "n_known", "logs", "score", "word", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = sent_vocab.value, unpack(sent.value)
        counted, end = np.log10(vocab.count + 1.0), vocab.end
        tail_z = np.log10(np.array(vocab.z, dtype=np.float64))
        end_at = vocab.index.get(END)
        first = TaskContext.get().partitionId() << 40
        ids, pool, known, logs, tails, id_type, size = [], [], [], [], [], None, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal first, size
            symbols = np.concatenate(pool)
            starts = np.concatenate(([0], np.cumsum([len(s) for s in pool])))
            in_tail = np.where(symbols >= HEAD, tail_z[np.maximum(symbols - HEAD, 0)], 0.0)
            head_log = np.where(symbols < HEAD, np.log10(vocab.head_count[np.minimum(symbols, HEAD - 1)] + 1), 0.0)
            less = np.add.reduceat(in_tail, starts[:-1])
            heads = np.add.reduceat(head_log, starts[:-1])
            s = score_pool(p, pool, end) / math.log(10) - less + np.array(logs) - heads
            uid = first + np.arange(len(ids))
            n = len(ids)
            nothing = pa.nulls(n, pa.int64())
            # a row's own line meets no word: no word has a space
            marks = pa.array([b" %d" % u for u in uid.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array(ids, id_type), pa.array([len(x) for x in pool], pa.int64()), pa.array(known, pa.int64()), pa.array(np.array(logs)), pa.array(s), marks, nothing], names
            )
            u = np.repeat(uid, [len(t) for t in tails])
            words = [w for t in tails for w in t]
            times = [c for t in tails for c in t.values()]
            m = len(words)
            for lo in range(0, m, 100_000):
                k = min(100_000, m - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[lo : lo + k]), pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                     pa.array(words[lo : lo + k], pa.binary()), pa.array(times[lo : lo + k], pa.int64())], names,
                )
            first += n
            size = 0
            for x in (ids, pool, known, logs, tails):
                x.clear()

        for batch in batches:
            id_type = batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            for at, texts in text_blocks(batch.column(1).to_pylist()):
                words = Words(texts)
                symbols, starts, found = _symbols(words, vocab)
                n = len(texts)
                of_text = np.repeat(np.arange(n), words.per_text)
                inside = found >= 0
                log = np.bincount(of_text, np.where(inside, counted[found], 0.0), minlength=n) if len(counted) else np.zeros(n)
                seen = np.bincount(of_text[inside], minlength=n)
                if end_at is not None:
                    log, seen = log + counted[end_at], seen + 1
                rest = np.flatnonzero(~inside)
                others, edges = words.bytes_of(rest), np.searchsorted(of_text[rest], np.arange(n + 1)).tolist()
                ids += doc_ids[at : at + n]
                pool += np.split(symbols, starts[1:])
                known += seen.tolist()
                logs += log.tolist()
                tails += [Counter(others[a:b]) if b > a else {} for a, b in zip(edges, edges[1:], strict=False)]
                size += len(symbols)
                if size >= POOL_TOKENS:
                    yield from out()
        if ids:
            yield from out()

    ship(spark)
    rows = docs.select(id_col, text_col).mapInArrow(run, f"uid long, id {kind}, n_tokens long, n_known long, logs double, score double, word binary, times long")
    joined = rows.join(counts, "word", "left")
    log = F.when(F.col("c").isNotNull(), F.log10(F.col("c") + 1.0) * F.col("times"))
    out = joined.groupBy("uid").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("logs") + F.coalesce(F.sum(log), F.lit(0.0))).alias("logs"),
        (F.max("score") + F.coalesce(F.sum(log), F.lit(0.0))).alias("score"),
    )
    per = math.log10(vocab.n + vocab.v + 1)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * per).alias("base_score"), "score"
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: tuple[float, ...] = (0.01, 0.007, 0.004)) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts, vocabulary and network weights from all given rows."""
    counts = cut(count_words(docs.select(text_col)))
    vocab = vocabulary(counts)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    flat = initial(vocab)
    share: Column = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(16))
    for (lo, hi), rate in zip(ROUNDS, rates, strict=True):
        flat = train_round(docs.filter((share >= lo) & (share < hi)).select(text_col), sent, flat, rate)
    return counts, vocab, flat


def not_held_out(col):
    """Rows that may be learned from: crc32 of the id modulo 7 is not 2."""
    return id_remainder(col, 7) != 2


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts, vocab, flat = fit(docs.filter(not_held_out("doc_id")))
    out = score(docs, counts, vocab, flat)
    return out.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

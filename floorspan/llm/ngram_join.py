"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct word shingles; documents with equal sets form a class, and
all work is on classes.  Shingles are ordered by a hint (the most frequent ones last, at most ``HINT`` of them are
broadcast; any order is right, it only changes the cost) and else by hash.  Two sets of Jaccard ``num / den`` or
more share at least l of the first ``n - ceil(n * num / den) + l`` shingles of each, for every l up to the
larger overlap needed, so each class emits its prefix for l up to ``MOST_MATCH``, and each chooses the l of
the least estimated cost: the rows of its prefix's buckets to read, and the candidates (at most those rows
over l) to verify.  A pair is a candidate when it shares l of its l-prefixes' shingles, l being the smaller of its two.

No bucket is expanded into all pairs:
* shingles of one class only are dropped by a count;
* first every class is verified against one leader, the class with the most copies in its buckets; what links
  joins a component;
* then only buckets with several components are joined, classes outside a bucket's largest component against
  all others of another component, behind exact bounds on size and on the overlap by parity sketches.  Links
  inside a component add nothing to it, so none that matters is lost.  In crowded buckets only classes of
  neighbouring bands of sizes meet, each band by itself.
Candidates are verified exactly on their sets, which are rebuilt from the texts for the classes that pass a
Bloom table of bounded size (a join keeps the exact ones).  All joins are left to Spark, which chooses their sides by
size and splits hot keys; no text is shuffled but those that both Bloom tables of ``keep_one`` seem to hold.

Sets are told apart by 64-bit hashes of shingles and of sets.

Defined cases: a text of fewer words than a shingle has its whole word sequence as its one element; a text
that is null or without words has an empty set, is linked with nothing and is its own component; exact copies
and repeated rows are one class; a component's id is its smallest non-null document id; an empty table gives
an empty result; extra columns are ignored by ``join`` and carried along by ``keep_one``, which keeps any one of
the rows that repeat both id and text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorspan.llm._bloom import bloom, may_hold
from floorspan.llm._common import Tables, ascii_lower, by_batch, frequent, give_back, small, table
from floorspan.llm._components import components
from floorspan.llm._words import joined, mix, windows, words
from floorspan.session import ship

N = 3
NUM, DEN = 90, 100
MOST_MATCH = 4
HINT = 1 << 19
#: Shingles seen more often than this in a task are candidates for the hint.
HINT_LEAST = 2
HINT_HELD = 1 << 19
GROUP_BYTES = 1 << 18
_SKETCH = np.uint64(0xA0761D6478BD642F)
#: Sets of more shingles get 512 parities, as 256 are too few to tell them apart.
LARGE = 256


def sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    group: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        group.append(ascii_lower(text))
        held += len(group[-1])
        if held >= GROUP_BYTES or i == len(texts) - 1:
            buf, offsets = joined(group)
            starts, _, hashes = words(buf)
            first = np.searchsorted(starts, offsets)
            full = windows(hashes, n)
            for k in range(len(group)):
                lo, hi = int(first[k]), int(first[k + 1])
                yield np.unique(full[lo : hi - n + 1] if hi - lo >= n else windows(hashes[lo:hi], hi - lo) if hi > lo else full[:0])
            group, held = [], 0


def set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ _SKETCH).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """2 ** bits parities: a bit is set when an odd number of the shingles fall on it."""
    odd = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def need(n: int | np.ndarray, num: int, den: int):
    """The overlap that a set of n elements needs with any set that it links with."""
    return -(-n * num // den)


def profiles(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, tid, n, sid, p0..p3) of each row, and (hint, seen) rows of the shingles that a task has seen often."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "tid", "n", "sid", "p0", "p1", "p2", "p3", "q", "hint", "seen"]
    wide = pa.list_(pa.int64())

    def squeeze(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        keys, c = keys[order], np.concatenate(counts)[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.add.reduceat(c, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        id_type = None
        for batch in small(batches):
            id_type = batch.column(0).type
            own = list(sets(batch.column(2).to_pylist(), n))
            m = np.array([len(s) for s in own], dtype=np.int64)
            some = m > 0
            sid = pa.array(np.array([set_id(s) for s in own], dtype=np.int64), mask=~some)
            p = np.array([sketch(s, 8) for s in own], dtype=np.int64).reshape(-1, 4)
            large = m > LARGE
            q = pa.array([sketch(s, 9) if len(s) > LARGE else None for s in own], wide)
            nothing = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m), sid, *[pa.array(np.ascontiguousarray(p[:, j]), mask=large) for j in range(4)], q, nothing, nothing], names)
            held += own
            counts += [np.ones(len(s), dtype=np.int64) for s in own]
            size += int(m.sum())
            if size >= HINT_HELD:  # shingles met once so far are forgotten: this is a hint only
                keys, c = squeeze(held, counts)
                held, counts = [keys[c > 1]], [c[c > 1]]
                size = len(held[0])
        if held and size:
            keys, c = squeeze(held, counts)
            often = c >= HINT_LEAST
            keys, c = keys[often], c[often]
            top = np.argsort(-c, kind="stable")[:HINT]
            nothing = pa.nulls(len(top), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(top), id_type), *[nothing] * 7, pa.nulls(len(top), wide), pa.array(keys[top].view(np.int64)), pa.array(c[top])], names)
            del keys, c, often, top
        del held, counts
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("t"))
    ship(docs.sparkSession)
    return rows.mapInArrow(run, f"id {kind}, tid long, n long, sid long, p0 long, p1 long, p2 long, p3 long, q array<long>, hint long, seen long")


def prefixes(docs: DataFrame, text_col: str, n: int, num: int, den: int, hint: np.ndarray) -> DataFrame:
    """(token, sid, level): the shingles of each class's longest prefix; level is the least l whose prefix holds it.

    ``hint`` holds frequent shingles, the most frequent first.
    """
    order = np.argsort(hint, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((hint[order], order))

    def make():
        frequent, rank = sent.value
        done: set[int] = set()  # classes of this task

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, sids, levels = [], [], []
            for s in sets(batch.column(0).to_pylist(), n):
                m = len(s)
                if not m or (sid := set_id(s)) in done:
                    continue
                done.add(sid)
                most = min(MOST_MATCH, int(need(m, num, den)))
                first = m - int(need(m, num, den)) + 1
                size = first + most - 1
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    # frequent shingles come last, the most frequent at the very end
                    s = np.concatenate((s[~late], s[late][np.argsort(-rank[at[late]], kind="stable")]))
                tokens.append(s[:size])
                sids.append(np.full(size, sid, dtype=np.int64))
                levels.append(np.maximum(np.arange(size) - first + 2, 1).astype(np.int8))
            if not tokens:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int8())], ["token", "sid", "level"])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(levels))], ["token", "sid", "level"])

        return step

    return by_batch(docs.select(text_col), "token long, sid long, level byte", make)


def verified(pairs: DataFrame, sets_of: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = pairs.join(sets_of.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets_of.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return shared.filter(F.col("i") * den >= (F.col("n") - F.col("i")) * num).select("a", "b")


PARITIES = ("p0", "p1", "p2", "p3")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Bounds that every linked pair meets, over the columns with these prefixes: on the sizes, and on the overlap.

    Linked sets share i >= (na + nb) * num / (num + den), and at least as many elements differ as parities do.
    """
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    small_ones = sum((F.coalesce(F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))), F.lit(0)) for p in PARITIES), F.lit(0))
    wide = F.aggregate(F.zip_with(f"{a}q", f"{b}q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    enough = lambda differ: (na + nb - differ) * (num + den) >= (na + nb) * (2 * num)
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & enough(small_ones) & enough(F.coalesce(wide, F.lit(0)))


#: Classes in a bucket from which its rows meet by bands of sizes.
CROWD = 256


def _by_band(rows: DataFrame, num: int, den: int, neighbours: bool) -> DataFrame:
    """Rows with the band of their size in crowded buckets, 0 in others; ``neighbours`` adds the bands next to it.

    The sizes of linked sets are at most den / num apart, and a band is as wide, so their bands are the same or next to each other.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int") if num < den else F.col("n").cast("int")
    crowded = F.col("df") > CROWD
    if not neighbours:
        return rows.withColumn("band", F.when(crowded, band).otherwise(0))
    return rows.withColumn("band", F.explode(F.when(crowded, F.array(band - 1, band, band + 1)).otherwise(F.array(F.lit(0)))))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(id, tid, n, sid) of the rows, and (sid, root, first) of the classes of non-empty sets; the row ``first`` (id, tid) has the component's least id.

    Both are read from tables in the shared checkpoint folder; all others are deleted there.
    """
    with Tables() as tables:
        return _classes(docs, id_col, text_col, n, num, den, tables)


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    table_ = tables.store(profiles(docs, id_col, text_col, n), keep=True)
    rows = table_.filter("n is not null").select("id", "tid", "n", "sid")
    often = tables.store(table_.filter("hint is not null").groupBy("hint").agg(F.sum("seen").alias("seen")))
    top = frequent(often, "seen", HINT).toArrow()  # at most HINT rows
    hints, seen = top["hint"].to_numpy(), top["seen"].to_numpy()
    hint = np.ascontiguousarray(hints[np.lexsort((hints, seen))[::-1]]).view(np.uint64)

    parities = PARITIES
    least = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "tid")).alias("first")
    owners = tables.store(table_.filter("n > 0").groupBy("sid").agg(least, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", *parities, "q")]))
    emitted = tables.store(prefixes(docs, text_col, n, num, den, hint))
    buckets = emitted.groupBy("token").agg(F.min("sid").alias("x"), F.max("sid").alias("y"), F.count("*").alias("df")).filter("x <> y").select("token", "df")
    shared = emitted.join(buckets, "token").dropDuplicates(["token", "sid"])

    # each class chooses how many shingles a partner has to share; its rows meet once, as many as its prefix has shingles
    own = Window.partitionBy("sid")
    costs = shared.join(owners.select("sid", "n", "copies"), "sid").select("*", *[F.sum(F.when(F.col("level") <= k, F.col("df")).otherwise(0)).over(own).alias(f"r{k}") for k in range(1, MOST_MATCH + 1)])
    best = F.array_min(F.array(*[F.struct((F.col(f"r{k}") * (1 + F.col("n") / k)).alias("cost"), F.lit(k).alias("l")) for k in range(1, MOST_MATCH + 1)]))["l"]
    chosen = costs.withColumn("l", F.least(best, F.ceil(F.col("n") * num / den)).cast("byte"))
    rows_of = tables.store(chosen.filter("level <= l").select("token", "sid", F.col("copies").cast("int").alias("copies"), F.col("df").cast("int").alias("df"), "l"))
    tables.drop(emitted)

    # one leader for each class: of its buckets' most copied classes, the most copied
    leaders = rows_of.groupBy("token").agg(F.max_by("sid", F.struct("copies", "sid")).alias("leader"), F.max("copies").alias("fame"))
    met = rows_of.select("token", "sid").join(leaders, "token").filter("sid <> leader").groupBy("sid", "leader").agg(F.count("*").alias("c"), F.first("fame").alias("fame"))
    star = tables.store(met.groupBy("sid").agg(F.max_by("leader", F.struct("fame", "c", "leader")).alias("leader")))
    a, b = (owners.select(F.col("sid").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *parities, "q")]) for k in ("sid", "leader"))
    led = star.join(a, "sid").join(b, "leader").filter(_may_link("sid_", "leader_", num, den))
    links = _verify(docs, text_col, n, num, den, led.select(F.col("sid").alias("a"), F.col("leader").alias("b")), tables)
    roots = tables.store(components(links))

    # the rest: buckets with several components.  Rows stay narrow until only these are left.
    placed = rows_of.join(roots.select(F.col("id").alias("sid"), "root"), "sid", "left").select("token", "sid", "df", "l", F.coalesce("root", "sid").alias("comp"))
    in_bucket = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    several = in_bucket.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k")).filter("k > 1").select("token", "main")
    narrow = tables.store(placed.join(several, "token"))
    tables.drop(rows_of)
    live = narrow.join(owners.select("sid", "n", *parities, "q"), "sid")
    a, b = _by_band(live.filter("comp <> main"), num, den, True).alias("a"), _by_band(live, num, den, False).alias("b")
    wanted = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.band") == F.col("b.band"))
        & (F.col("a.comp") != F.col("b.comp"))
        & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.sid") < F.col("b.sid")))
        & _may_link("a.", "b.", num, den)
    )
    pairs = a.join(b, wanted).select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"), F.least("a.l", "b.l").alias("l"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("l").alias("l")).filter("c >= l").select("a", "b")
    more = _verify(docs, text_col, n, num, den, pairs, tables)

    # all links together; a component is told by its least class, and has the row with the least id that isn't null
    every = tables.store(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)))
    named = tables.store(owners.select("sid", "first").join(every.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root")))
    first = tables.store(named.groupBy("root").agg(F.min("first").alias("first")))  # stored, so that Spark can split the join with a large component
    return rows, tables.store(named.select("sid", "root").join(first, "root").select("sid", "root", "first"), keep=True)


def _verify(docs: DataFrame, text_col: str, n: int, num: int, den: int, pairs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) that link by their sets, which are built again from the texts."""
    pairs = tables.store(pairs)
    ids = tables.store(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct())
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids, "sid"))

    def make():
        table_ = sent.value
        done: set[int] = set()
        return lambda batch: _chosen(batch, n, table_, done)

    built = by_batch(docs.select(text_col), "sid long, s array<long>", make).join(ids, "sid", "left_semi").groupBy("sid").agg(F.first("s").alias("s"))
    return tables.store(verified(pairs, tables.store(built), num, den))  # the sets are stored, so that Spark can split the joins with a hot class


def _chosen(batch: pa.RecordBatch, n: int, table_: np.ndarray, done: set[int]) -> pa.RecordBatch:
    """The sets of the batch's classes that the table may hold, each once a task."""
    own = [s for s in sets(batch.column(0).to_pylist(), n) if len(s)]
    sids = np.array([set_id(s) for s in own], dtype=np.int64)
    fresh = []
    for k in np.flatnonzero(may_hold(table_, sids)).tolist():
        if (sid := int(sids[k])) not in done:
            done.add(sid)
            fresh.append(k)
    values = np.concatenate([own[k] for k in fresh]).view(np.int64) if fresh else np.empty(0, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum([len(own[k]) for k in fresh]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(sids[fresh]), pa.ListArray.from_arrays(pa.array(starts), pa.array(values))], ["sid", "s"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows, named = classes(docs, id_col, text_col, n, num, den)
    full = rows.filter("n > 0").join(named, "sid").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first")["id"].alias("component_id"))
    return full.union(rows.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component, one with its smallest id, and all rows with empty sets; with all their columns.

    Rows go by a key, a hash of id and text.  One Bloom table holds the keys of rows that go, and of rows with
    words that are there repeatedly, of which one stays.  A second one holds the keys of all staying rows that the
    first seems to hold.  So a row that is not in the first stays and one that is in the first alone goes, right
    where it is, and only the few in both are shuffled and joined with the exact list of such keys.
    """
    spark = docs.sparkSession
    rows, named = classes(docs, id_col, text_col, n, num, den)
    key = F.xxhash64("id", "tid").alias("key")
    goes = ~(F.col("id").eqNullSafe(F.col("first")["id"]) & (F.col("tid") == F.col("first")["tid"]))
    of_words = rows.filter("n > 0").join(named, "sid").select(key, goes.alias("goes")).groupBy("key").agg(F.max("goes").alias("goes"), (F.count("*") > 1).alias("again"))
    with Tables() as tables:
        keys = tables.store(of_words.union(rows.filter("n = 0").select(key, F.lit(False), F.lit(False)).distinct()))
        first = spark.sparkContext.broadcast(bloom(keys.filter("goes or again"), "key"))
        seeming = tables.store(_where(keys, lambda k: may_hold(first.value, k)))
        second = spark.sparkContext.broadcast(bloom(seeming.filter("not goes"), "key"))
        unsure = tables.store(_where(seeming, lambda k: may_hold(second.value, k)), keep=True)

    name = "__key"
    while name in docs.columns or f"{name}again" in docs.columns:
        name += "_"
    own = docs.withColumn(name, F.xxhash64(id_col, F.xxhash64(text_col)))
    sure = _where(own, lambda k: ~may_hold(first.value, k), name)
    open_ = _where(own, lambda k: may_hold(first.value, k) & may_hold(second.value, k), name).join(unsure.filter("not goes").select(F.col("key").alias(name), F.col("again").alias(name + "again")), name)
    once, again = open_.filter(~F.col(name + "again")), open_.filter(name + "again").dropDuplicates([name])
    return sure.select(docs.columns).union(once.select(docs.columns)).union(again.select(docs.columns))


def _where(df: DataFrame, test: Callable[[np.ndarray], np.ndarray], key: str = "key") -> DataFrame:
    """Rows whose key passes a test."""
    at = df.columns.index(key)
    return by_batch(df, df.schema, lambda: lambda batch: batch.filter(pa.array(test(batch.column(at).to_numpy()))))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

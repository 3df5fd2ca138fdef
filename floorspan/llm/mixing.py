"""Mixing sources to target weights with hash-threshold histograms.

A source's target is its share by weight of all words (``water_fill``); documents are first taken whole as many
times as the target holds the source, and the rest of the target, less than the source, is a nested budget
that a threshold on the documents' hash fills: words are summed by source and hash bucket, the bucket at
which the running sum crosses the budget is the boundary, and only its rows are dealt into finer buckets,
``LEVELS`` times.  Documents below the threshold are taken once more.  No documents are sorted, the largest
state is sources x 2 ** BITS sums, and a hot source only adds to its own sums.  A lower budget gives a subset
of a higher one's documents, and reruns agree as the hash depends on id and text alone.

Sources are ranked over ranges of their names, so that no task holds all sources.  Thresholds (a row for
each source) are broadcast after a check of their number, else joined by a shuffle.

Defined cases: a null or empty text has size 0 and takes 0; the null source comes last in the order of weights;
sources of size 0 have target 0; rows with the same id and text hash alike and are taken or left together;
empty tables give empty results; extra columns are ignored by ``plan_mix`` and carried along by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorspan.llm._common import WORD, cut, sent_if_small, table

WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source.
MOST_TIMES = 3
BITS, LEVELS = 12, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A text that tells null from all sources and orders after none of them."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _hash(doc_id: Column, text: Column) -> Column:
    """The BITS * LEVELS leading bits of the row's MD5, over id and text with a unit separator between them."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """The sources (k, source, source_size) with their 0-based rank ``r`` in code-point order, null last."""
    ranges = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()))
    before, start = {}, 0
    for row in sorted(ranges.groupBy("p").count().collect()):  # a row for each partition
        before[row.p], start = start, start + row["count"]
    spark = sizes.sparkSession
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "p int, n long")
    within = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("w", within).join(offsets, "p").select("k", "source", "source_size", (F.col("n") + F.col("w") - 1).alias("r"))


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES, total: float | None = None) -> DataFrame:
    """(k, source, source_size, target) of the sources: shares by weight that stop at ``most_times`` the source's
    size, the excess shared again by weight until no target is above."""
    w = F.lit(float(weights[0]))
    for i, x in enumerate(weights):
        w = F.when(F.col("r") % len(weights) == i, F.lit(float(x))).otherwise(w)
    rows = cut(ranked(sizes).withColumn("weight", w).withColumn("most", F.col("source_size") * float(most_times)))
    if total is None:
        total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:  # ends: the level only rises, and each round but the last stops another source
        stopped = F.col("most") < level * F.col("weight")
        s = rows.agg(F.sum(F.when(stopped, F.col("most"))).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("free")).first()
        new = (total - (s.held or 0.0)) / s.free if s.free else float("inf")
        if new <= level or s.free is None:
            break
        level = new
    target = F.when(F.col("most") < level * F.col("weight"), F.col("most")).otherwise(level * F.col("weight")) if level != float("inf") else F.col("most")
    return rows.select("k", "source", "source_size", F.greatest(F.lit(0.0), F.least(target, F.col("most"))).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(k, threshold): rows (k, h, size) of a source with h under its threshold sum to about its budget.

    Each level sums the rows of the boundary buckets only.  In the last level the boundary bucket counts as
    below when that comes nearer to the budget.
    """
    state = budgets.select("k", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    mask = (1 << BITS) - 1
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            inside = rows.join(sent_if_small(state.select("k", "prefix", "left")), (rows["k"] == state["k"]) & (F.shiftright("h", shift + BITS) == F.col("prefix"))).drop(state["k"])
        else:
            inside = rows
        sums = inside.groupBy("k", F.shiftright("h", shift).bitwiseAND(mask).alias("b")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("k").orderBy("b")  # at most 2 ** BITS sums of a source
        running = sums.withColumn("upto", F.sum("n").over(w)).join(state.select("k", "left", "prefix"), "k")
        at = running.filter(F.col("upto") > F.col("left")).groupBy("k").agg(F.min_by(F.struct("b", "n", "upto"), "b").alias("x"))
        state = state.join(at, "k").select(
            "k", (F.col("left") - (F.col("x.upto") - F.col("x.n"))).alias("left"), (F.col("prefix") * (1 << BITS) + F.col("x.b")).alias("prefix"), F.col("x.n").alias("n")
        )
        state = cut(state)  # a row for each source
    return state.select("k", (F.col("prefix") + (F.col("left") * 2 >= F.col("n")).cast("long")).alias("threshold"))


def plan_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """(k, source_size, target, times, threshold) of each source from rows (k, source, h, size)."""
    sizes = rows.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = cut(water_fill(sizes, weights, most_times))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    found = thresholds(rows.filter("size > 0"), plan.filter("budget > 0"))
    return cut(plan.join(found, "k", "left").select("k", "source_size", "target", "times", F.coalesce("threshold", F.lit(0)).alias("threshold")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow rows (id, k, source, h, size) that planning works on; texts are read once for them."""
    rows = docs.select(
        F.col(id_col).alias("id"), _key(F.col(source_col)).alias("k"), F.col(source_col).cast("string").alias("source"), _hash(F.col(id_col), F.col(text_col)).alias("h"), n_words(F.col(text_col)).alias("size")
    )
    return cut(rows)


def copies(h: Column) -> Column:
    return F.col("times") + (h < F.col("threshold")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    rows = sized(docs, id_col, text_col, source_col)
    plan = plan_mix(rows, weights, most_times)
    return rows.join(sent_if_small(plan), "k").select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies(F.col("h"))).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", times_col: str = "copies", weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """The rows that the mix takes, with all their columns, and how many times it takes each in ``times_col``.

    Where the rows have a column of that name already, underscores are put after it.
    """
    while times_col in docs.columns:
        times_col += "_"
    plan_col = "__plan"
    while plan_col in docs.columns:
        plan_col += "_"
    plan = plan_mix(sized(docs, id_col, text_col, source_col), weights, most_times)
    plan = plan.select(F.struct("k", "times", "threshold").alias(plan_col))
    joined = docs.join(sent_if_small(plan), _key(F.col(source_col)) == F.col(f"{plan_col}.k"))  # a row for each source
    n = F.col(f"{plan_col}.times") + (_hash(F.col(id_col), F.col(text_col)) < F.col(f"{plan_col}.threshold")).cast("long")
    return joined.withColumn(plan_col, n).filter(F.col(plan_col) > 0).withColumnRenamed(plan_col, times_col)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

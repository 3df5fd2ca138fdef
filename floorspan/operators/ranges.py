"""Numbers, running values and percentiles within groups, by counted ranges, so that no group has to fit into one task.

Rows are dealt by ranges of group and order.  What a range holds of a group is summed up in one row; only those of a
group that spans several ranges (two groups for each range at most) are added up over ranges, and each range goes on from there.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspan.session import cut


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and maxima up to each row, itself included, within the keys; rows that tie in the order go in any order."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    made = {**{n: (F.sum, F.coalesce(c, F.lit(0))) for n, c in (sums or {}).items()}, **{n: (F.max, c) for n, c in (maxima or {}).items()}}
    ranges = cut(df.withColumns({f"_v_{n}": c for n, (_, c) in made.items()}).repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    held = ranges.groupBy(*keys, "_p").agg(*[f(f"_v_{n}").alias(f"_h_{n}") for n, (f, _) in made.items()])
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    before = held.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_p").alias("_q"), *[f(f"_h_{n}").over(w).alias(f"_b_{n}") for n, (f, _) in made.items()])
    met = F.col("_p") == F.col("_q")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = ranges.withColumns({n: f(f"_v_{n}").over(own) for n, (f, _) in made.items()}).join(before, met)
    add = lambda n, f: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) if f is F.sum else F.greatest(n, f"_b_{n}")
    return d.select(*df.columns, *[add(n, f).alias(n) for n, (f, _) in made.items()])


def number_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """Adds consecutive numbers from 1 within the keys."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def before(df: DataFrame, keys: list[str], order: list[str | Column], column: str, name: str) -> DataFrame:
    """Adds the value of a column in the row before, within the keys."""
    d = cut(number_within(df, keys, order, "_n"))
    last = d.select(*[F.col(k).alias(f"_l_{k}") for k in keys], (F.col("_n") + 1).alias("_m"), F.col(column).alias(name))
    met = F.col("_n") == F.col("_m")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_l_{k}"))
    return d.join(last, met, "left").select(*df.columns, name)


def percentiles(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str] | None = None, middle: str | None = None) -> DataFrame:
    """(keys, percentiles) of the values that aren't null: nearest-rank ones by name ("0.9"), and the interpolated median.

    Equal values are counted first, then the counts are added up in order.  Groups without values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    summed = running(counts, keys, ["_x"], {"_upto": F.col("_c")})
    all_ = counts.groupBy(*keys).agg(F.sum("_c").alias("_all"))
    for k in keys:
        all_ = all_.withColumnRenamed(k, f"_a_{k}")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_a_{k}"))
    d = summed.join(all_, met)
    whole = F.col("_all").cast("decimal(20,0)")
    first = lambda ok: F.min(F.when(ok, F.col("_x")))
    out = [first(F.col("_upto") >= whole * F.lit(Decimal(q))).alias(n) for n, q in (ranks or {}).items()]
    if middle is not None:
        low, high = (first(F.col("_upto") >= F.floor((F.col("_all") + k) / 2)) for k in (1, 2))
        out.append((low * 0.5 + high * 0.5).alias(middle))
    return d.groupBy(*keys).agg(*out)

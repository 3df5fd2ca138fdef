"""Bloom tables of 64-bit keys, of bounded size, made by Spark and sent to the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.session import ship

#: Least and most bits of a table: 128 KB and 64 MB.
BITS = (1 << 20, 1 << 29)
PER_KEY = 16
#: Words of 64 bits that come to the driver as one value.
BLOCK = 1 << 13


def bloom(keys: DataFrame, key: str, per_key: int = PER_KEY) -> np.ndarray:
    """A bit table of a column of hashes: ``per_key`` bits a key, within BITS.  At most 1024 rows of 64 KB come to the driver."""
    count, bits = keys.count(), BITS[0]
    while bits < min(per_key * count, BITS[1]):
        bits *= 2
    places = keys.select(F.explode(F.array(F.col(key).bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1))).alias("b"))
    words = places.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x"))

    def pack(t: pa.Table) -> pa.Table:
        w, out = t["w"].to_numpy(), np.zeros(BLOCK, dtype=np.int64)
        out[w % BLOCK] = t["x"].to_numpy()
        return pa.table({"block": pa.array([int(w[0]) // BLOCK], pa.int64()), "v": pa.array([out.tobytes()], pa.binary())})

    ship(keys.sparkSession)
    blocks = words.withColumn("at", F.shiftright("w", BLOCK.bit_length() - 1)).groupBy("at").applyInArrow(pack, "block long, v binary").toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    for at, v in zip(blocks["block"].to_pylist(), blocks["v"], strict=True):
        part = out[at * BLOCK : (at + 1) * BLOCK]
        part[:] = np.frombuffer(v.as_py(), dtype=np.uint64)[: len(part)]
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the table may hold each of the keys (int64); never False for one that it holds."""
    u, mask = keys.view(np.uint64), np.uint64(len(table) * 64 - 1)
    found = np.ones(len(u), dtype=bool)
    for place in (u & mask, (u >> np.uint64(32)) & mask):
        found &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found

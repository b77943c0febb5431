"""Joins with a side that is mostly small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 20_000
#: Copies of the rows of a larger side, over which each key's rows spread.
SALTS = 16


def lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join stored table small to big on keys, null keys being equal. small is broadcast if it has BROADCAST_ROWS rows at
    most, counted; else both are shuffled by the keys and a salt, which is a hash of spread. The hint holds Spark to that:
    its estimate of the copies is the size of small's compressed files, by which it would send them all through the driver."""
    right = small.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        big = big.withColumn("__spread", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
        on.append(F.col("__spread") == F.col("__salt"))
    joined = big.join(right, reduce(lambda a, b: a & b, on), how)
    return joined.drop("__spread", "__salt", *[f"__{k}" for k in keys])

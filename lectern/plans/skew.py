"""Joins against a keyed lookup table when a few keys hold much of the probe side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 200
SALTS = 64


def salted_lookup(
    probe: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, spread: Column, share: float = HOT_SHARE, salts: int = SALTS
) -> DataFrame:
    """Left join of `probe` to `lookup` (unique in `key`) that spreads hot keys over `salts` tasks.

    `weight` is the lookup column with the number of probe rows of the key, `total` their sum. Hot keys
    are those with at least `share` of `total`: at most 1 / share of them, which bounds the broadcast.
    Their lookup rows are repeated once a salt, and probe rows take a salt from `spread`, any column
    that differs among rows of one key. Null keys match nothing. `weight` isn't returned.
    """
    hot = lookup.where(F.col(weight) >= max(2, total * share)).select(F.col(key).alias("_hot"))
    sides = lookup.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    sides = sides.withColumn("_salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))))
    sides = sides.drop("_hot", weight)
    marked = probe.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))).drop("_hot")
    return marked.join(sides, [key, "_salt"], "left").drop("_salt")

"""Books as tables: lookups with fallbacks, keyed merges and edits as new snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written


def lookup_first(df: DataFrame, dim: DataFrame, keys: list[tuple[str, str]], value: str, default: Column | None = None) -> DataFrame:
    """`value` from the first of several lookups that finds one: pairs of a column of `df` and a unique one of `dim`."""
    out, found = df, []
    for k, (left, right) in enumerate(keys):
        side = dim.where(F.col(right).isNotNull()).groupBy(F.col(right).alias(f"_key{k}")).agg(F.min(value).alias(f"_value{k}"))
        out = out.join(side, F.col(left) == F.col(f"_key{k}"), "left")
        found.append(F.col(f"_value{k}"))
    if default is not None:
        found.append(default)
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_key{k}" for k in range(len(keys))), *(f"_value{k}" for k in range(len(keys))))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null or empty key are left out."""
    rows = reduce(lambda d, k: d.where(F.col(k).isNotNull() & (F.col(k).cast("string") != "")), keys, df)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_last_wins(low: DataFrame, high: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The union of two ordered tables: the last row of a key wins, at the place of the key's first."""
    both = low.withColumn("_side", F.lit(0)).unionByName(high.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys)
    place = F.min(F.struct("_side", order)).over(w)
    last = F.row_number().over(w.orderBy(F.desc("_side"), F.desc(order)))
    kept = both.withColumn("_place", place).withColumn("_last", last).where("_last = 1")
    return kept.withColumn("position", F.struct("_place._side", f"_place.{order}")).drop("_side", "_last", "_place")


def drop_rows(df: DataFrame, gone: DataFrame, keys: list[str], book: str, order: list[str], index: str = "index") -> DataFrame:
    """A snapshot without the rows of `gone`, counted anew from 1 in each book."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti").withColumn(index, F.row_number().over(Window.partitionBy(book).orderBy(*order)))


def insert_rows(df: DataFrame, new: DataFrame, book: str, source: str, index: str = "index") -> DataFrame:
    """A snapshot with `new` rows each before the first row whose source position isn't smaller, counted anew from 1."""
    both = df.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return both.withColumn(index, F.row_number().over(Window.partitionBy(book).orderBy(source, "_new"))).drop("_new")


def upsert(current: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """`current` with the fields that `edits` sets: `<field>_set` tells a null that clears from an absent one; new keys are added."""
    left, right = current.alias("c"), edits.alias("e")
    joined = left.join(right, keys, "full")
    out = [F.when(F.coalesce(F.col(f"e.{f}_set"), F.lit(False)), F.col(f"e.{f}")).otherwise(F.col(f"c.{f}")).alias(f) for f in fields]
    return joined.select(*keys, *out)


def placed(df: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """`df` with the place (from 1) of each row in the whole order, by ranges: no task has more than a range to sort.

    The order must be total, or equal rows that fall into one range are numbered in any order."""
    rows = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    ranges = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(ranges, "_range").withColumn(place, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")

"""Assembling books from items: spine ranges, zips, flattened contents and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written


def spine_ranges(spine: DataFrame, toc: DataFrame, book: str, position: str, start: str) -> DataFrame:
    """Each spine row with the contents entry whose range [start, next start) holds it; rows before the first are left out.

    The ranges of a book don't overlap, so this is a running last value over the union, without a range join.
    """
    both = spine.withColumn("_start", F.lit(None).cast("long")).unionByName(toc.select(book, F.col(start).alias(position), F.col(start).cast("long").alias("_start")), allowMissingColumns=True)
    w = Window.partitionBy(book).orderBy(position, F.desc_nulls_last("_start")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_of", F.last("_start", ignorenulls=True).over(w))
    return found.where(F.col("_start").isNull() & F.col("_of").isNotNull()).withColumn(start, F.col("_of")).drop("_start", "_of")


def zipped(now: DataFrame, old: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The state of each place in two tables: same, other (by `name`), missing (in the old one) or extra."""
    a, b = now.withColumn("_a", F.lit(True)), old.withColumnRenamed(name, "_name").withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), F.lit("extra")).when(F.col("_b").isNull(), F.lit("missing")).when(F.col(name) == F.col("_name"), F.lit("same")).otherwise(F.lit("other"))
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def first_suffix(df: DataFrame, rules: list[tuple[str, str]], path: str, label: str) -> DataFrame:
    """The label of the first rule whose suffix the path has; rows without one are left out. Rules are few, so they are an expression."""
    found = F.coalesce(*(F.when(F.endswith(F.col(path), F.lit(suffix)), F.lit(name)) for suffix, name in rules))
    return df.withColumn(label, found).where(F.col(label).isNotNull())


def flattened(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """id, root and depth of all entries of nested contents; entries without a parent are roots, and those that no root leads to are left out.

    Each round doubles the steps up that paths have taken, so their number grows with the logarithm of the depth,
    and rows are bounded by the table alone. Contents that a root leads around in are an error.
    """
    rows = edges.select(F.col(node).alias("id"), F.coalesce(parent, node).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"), F.col(parent).isNull().alias("done"))
    last, done = written(rows.where("id IS NOT NULL"), "contents"), None
    entries = last.count()
    for k in range(64):
        now = last.where("done").select("id", "up", "depth")
        done = now if done is None else done.unionByName(now)
        if done is not now and now.isEmpty():
            break  # a deeper entry would have one of this depth above it
        if k and 2 ** (k - 1) >= entries:
            raise ValueError("contents lead around in a circle")  # a path of more steps than there are entries
        ahead = last.where("NOT done")
        if ahead.isEmpty():
            break
        above = done.withColumn("done", F.lit(True)).unionByName(ahead).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), "done")
        last = written(ahead.drop("done").join(above, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), "done"), "contents")
    return done.select("id", F.col("up").alias("root"), "depth")


def tag_map(values: dict[str, Column]) -> Column:
    """A map of the tags that have a value."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def cover_suffix(media: Column, href: Column) -> Column:
    """A cover's file suffix: by its media type, else its link's own, else .jpg."""
    kind = F.regexp_extract(F.lower(media), "^image/(webp|gif|png|jpe?g)$", 1)
    known = F.when(kind != "", F.concat(F.lit("."), F.regexp_replace(kind, "jpeg", "jpg")))
    own = F.lower(F.regexp_extract(href, "([.][A-Za-z0-9]+)$", 1))
    return F.coalesce(known, F.nullif(own, F.lit("")), F.lit(".jpg"))

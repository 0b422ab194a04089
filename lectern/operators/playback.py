"""Playback state, times, spans and files of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position(x: Column) -> Column:
    """A chunk's index, null unless it is 0 or more."""
    return F.when(x >= 0, x)


def bookmarks(indexes: Column) -> Column:
    return F.filter(indexes, lambda i: i >= 0)


def valid_spans(spans: Column) -> Column:
    """The pairs whose start is 0 or more and whose end isn't before it."""
    return F.filter(spans, lambda s: (F.size(s) == 2) & (F.try_element_at(s, F.lit(1)) >= 0) & (F.try_element_at(s, F.lit(2)) >= F.try_element_at(s, F.lit(1))))


def clone_time(raw: Column) -> Column:
    """Seconds of `S`, `MM:SS` or `HH:MM:SS`, three decimals without trailing zeros; null for others, and for minutes or seconds of 60 and more."""
    parts = F.split(F.trim(raw), ":", -1)
    n = F.size(parts)
    at = lambda k: F.coalesce(F.try_element_at(parts, k).try_cast("decimal(12,3)"), F.lit(-1))
    last, before, first = at(n), F.when(n >= 2, at(n - 1)).otherwise(F.lit(0)), F.when(n >= 3, at(n - 2)).otherwise(F.lit(0))
    good = (n <= 3) & (last >= 0) & (before >= 0) & (first >= 0) & ((n == 1) | (last < 60)) & ((n == 1) | (before < 60))
    total = (first * 3600 + before * 60 + last).cast("decimal(20,3)").cast("string")
    short = F.regexp_replace(F.regexp_replace(total, "([.][0-9]*?)0+$", "$1"), "[.]$", "")
    return F.when(good, short)


def first_year(dates: Column) -> Column:
    """The first run of four digits in the dates, or ""."""
    years = F.filter(F.transform(dates, lambda d: F.regexp_extract(d, "([0-9]{4})", 1)), lambda y: y != "")
    return F.coalesce(F.try_element_at(years, F.lit(1)), F.lit(""))


def source_kind(source: Column, has_author: Column) -> list[Column]:
    """kind by the source's suffix, and origin by whether an author is known."""
    low = F.lower(source)
    kind = F.when(F.endswith(low, F.lit(".epub")), F.lit("epub")).when(F.endswith(low, F.lit(".txt")), F.lit("text")).otherwise("other")
    return [kind.alias("kind"), F.when(has_author, F.lit("author")).otherwise("unknown").alias("origin")]


def concat_list(df: DataFrame, book: str, order: list[str], path: str, duration: str) -> DataFrame:
    """A row a book: `list`, the file lines of its segments in order, and their whole `duration`."""
    line = F.concat(F.lit("file '"), F.replace(F.col(path), F.lit("'"), F.lit("'\\''")), F.lit("'\n"))
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(book).agg(rows.alias("_rows"), F.sum(duration).cast("long").alias("duration")).select(book, F.array_join(F.transform("_rows", lambda r: r["_line"]), "").alias("list"), "duration")


def book_details(chapters: DataFrame, book: str, order: str, fields: list[str], spans: str) -> DataFrame:
    """`chapters` (in order, with `fields` and chunk_count) and chunk_count of each book; a chapter has as many chunks as spans."""
    listed = F.array_sort(F.collect_list(F.struct(order, *fields, F.coalesce(F.size(spans), F.lit(0)).alias("chunk_count"))))
    out = chapters.groupBy(book).agg(listed.alias("chapters"))
    return out.withColumn("chunk_count", F.aggregate("chapters", F.lit(0).cast("long"), lambda n, c: n + c["chunk_count"]))

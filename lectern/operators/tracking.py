"""Ordered operators over books, chapters and chunks: offsets, gaps, progress, splits and pauses.

Tables carry their order in columns; every window is partitioned by the book (or chapter), so books are
independent tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written

TITLE_PAUSE = 5


def _before(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_offsets(df: DataFrame, book: str, order: list[str], duration: str) -> DataFrame:
    """`start_ms` and `end_ms` of each row: durations of less than 1 ms take 1 ms."""
    width = F.greatest(F.coalesce(F.col(duration), F.lit(0)), F.lit(1))
    start = F.coalesce(F.sum(width).over(_before([book], order)), F.lit(0))
    return df.withColumn("start_ms", start).withColumn("end_ms", start + width)


def until_first_gap(df: DataFrame, book: str, order: list[str], present: Column) -> DataFrame:
    """The rows of each book before its first row that isn't present."""
    here = F.coalesce(present, F.lit(False)).cast("int")
    return df.withColumn("_here", F.min(here).over(_upto([book], order))).where("_here = 1").drop("_here")


def runs(df: DataFrame, partition: list[str], order: list[str], key: Column) -> DataFrame:
    """`run`: the number of the run of equal keys a row is in, from 1; null keys are equal to each other."""
    w = Window.partitionBy(*partition).orderBy(*order)
    change = F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise((~F.lag("_key").over(w).eqNullSafe(F.col("_key"))).cast("int"))
    return df.withColumn("_key", key).withColumn("_change", change).withColumn("run", F.sum("_change").over(_upto(partition, order))).drop("_key", "_change")


def merge_intervals(df: DataFrame, partition: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching half-open intervals as one; empty ones are left out."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def boundary_pauses(df: DataFrame, book: str, chapter: str, position: str, pause: str) -> DataFrame:
    """The last chunk of each chapter but a book's last pauses for TITLE_PAUSE at least.

    No task has a whole book: chapters are sorted one by one, and meet their book's last chapter, of which there is one row a book, in a join.
    """
    last = F.row_number().over(Window.partitionBy(book, chapter).orderBy(F.desc(position))) == 1
    rows = written(df.withColumn("_last", last), "pauses")  # as it is read twice
    final = written(rows.groupBy(F.col(book).alias("_book")).agg(F.max(chapter).alias("_final")).where("_final IS NOT NULL"), "finals")
    placed = rows.join(final, F.col(book).eqNullSafe(F.col("_book")) & (F.col(chapter) == F.col("_final")), "left")
    longer = F.col("_last") & F.col(chapter).isNotNull() & F.col("_final").isNull()
    return placed.withColumn(pause, F.when(longer, F.greatest(F.col(pause), F.lit(TITLE_PAUSE))).otherwise(F.col(pause))).drop("_last", "_book", "_final")


def valid_pauses(pauses: Column, count: Column, fallback: Column | None = None) -> Column:
    """`count` pauses: the given ones if there are as many, where they are above 0; else the fallback's; else 1."""
    usable = pauses.isNotNull() & (F.size(pauses) == count)

    def one(i: Column) -> Column:
        other = F.lit(1)
        if fallback is not None:
            back = F.try_element_at(fallback, i)
            other = F.when(back > 0, back).otherwise(F.lit(1))
        own = F.when(usable, F.try_element_at(pauses, i))
        return F.when(own > 0, own).otherwise(other)

    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), one)).otherwise(F.array().cast("array<int>"))


def progress(df: DataFrame, book: str, order: list[str], done: Column, *current: str) -> DataFrame:
    """A row a book: total, done, percent (2 decimals) and the first row that isn't done, with its place."""
    w = Window.partitionBy(book).orderBy(*order)
    rows = df.withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("global_index", F.row_number().over(w) - 1)
    first = F.min(F.when(~F.col("_done"), F.struct("global_index", *current))).alias("_first")
    out = rows.groupBy(book).agg(F.count("*").alias("total"), F.count_if("_done").alias("done"), first)
    return out.select(book, "total", "done", F.round(F.col("done") / F.col("total") * 100, 2).alias("percent"), *(F.col(f"_first.{c}").alias(c) for c in ("global_index", *current)))


def balanced_parts(df: DataFrame, book: str, order: str, duration: str, parts: int) -> DataFrame:
    """`part` (from 1) of each chapter: at most `parts` contiguous parts of about equal duration.

    While parts are left, one closes before a chapter when as many chapters as parts are left, and when the
    chapter would take it past the remaining time over the remaining parts with chapters enough for them.
    This is a fold over a book's chapters, which are one small array.
    """
    item = F.struct(F.col(order).alias("o"), F.coalesce(F.col(duration), F.lit(0)).cast("double").alias("d"))
    books = df.groupBy(book).agg(F.array_sort(F.collect_list(item)).alias("_all"), F.sum(F.coalesce(F.col(duration), F.lit(0)).cast("double")).alias("_total"))
    many = F.lit(parts)
    zero = F.struct(F.lit(1).alias("part"), F.lit(0.0).alias("own"), F.col("_total").alias("left"), F.lit(0).alias("seen"), F.lit(0).alias("count"), F.array().cast("array<int>").alias("out"))
    # `out` has the places that parts begin at, so it never has more than `parts` entries

    def step(a: Column, x: Column) -> Column:
        parts_left = many - a["part"] + 1
        chapters_left = F.size("_all") - a["seen"]
        full = (a["own"] + x["d"] > a["left"] / parts_left) & (chapters_left >= parts_left)
        close = (a["count"] > 0) & (parts_left > 1) & (full | (chapters_left == parts_left))
        part = a["part"] + close.cast("int")
        return F.struct(
            part.alias("part"), (F.when(close, F.lit(0.0)).otherwise(a["own"]) + x["d"]).alias("own"), F.when(close, a["left"] - a["own"]).otherwise(a["left"]).alias("left"),
            (a["seen"] + 1).alias("seen"), (F.when(close, F.lit(0)).otherwise(a["count"]) + 1).alias("count"), F.when(close, F.concat(a["out"], F.array(a["seen"]))).otherwise(a["out"]).alias("out"),
        )

    placed = books.withColumn("_out", F.aggregate("_all", zero, step, lambda a: a["out"])).select(book, "_out", F.posexplode("_all").alias("_place", "_x"))
    return placed.select(book, F.col("_x.o").alias(order), (1 + F.size(F.filter("_out", lambda s: s <= F.col("_place")))).alias("part"))


def list_numbers(df: DataFrame, partition: list[str], order: list[str], value: str, start: str) -> DataFrame:
    """`number` of list items: counted from `start` (default 1), and anew from every item with a `value`."""
    w = Window.partitionBy(*partition).orderBy(*order)
    island = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_island", island)
    inner = Window.partitionBy(*partition, "_island").orderBy(*order)
    base = F.coalesce(F.first(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col(start), F.lit(1))
    return rows.withColumn("number", base + F.row_number().over(inner) - 1).drop("_island")


def joined_text(df: DataFrame, book: str, order: list[str], text: str, separator: Column | None = None) -> DataFrame:
    """A row a book: its texts in order, each but the last followed by its `separator` (a blank line by default)."""
    separator = F.lit("\n\n") if separator is None else separator
    item = F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), F.col(text).alias("t"), separator.alias("s"))
    items = F.array_sort(F.collect_list(item))
    whole = F.array_join(F.transform("_items", lambda x, i: F.concat(x["t"], F.when(i < F.size("_items") - 1, x["s"]).otherwise(F.lit("")))), "")
    return df.where(F.col(text).isNotNull()).groupBy(book).agg(items.alias("_items")).select(book, whole.alias(text))


def chapter_markers(df: DataFrame, book: str, order: list[str], duration: str, title: Column) -> DataFrame:
    """`marker`: a chapter's block of the metadata file, with its running start and end."""
    timed = running_offsets(df, book, order, duration)
    return timed.withColumn("marker", F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s\n", "start_ms", "end_ms", title))

"""Chapters of books from their items, spine and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import html, text
from lectern.operators.cleaning import footnote_index
from lectern.operators.library import keep_first

DOCUMENTS = ["application/xhtml+xml", "text/html"]


def is_file_title(title: Column, href: Column) -> Column:
    """Whether a title is but a file's name: empty, of a split series, with a page's suffix, or the link itself."""
    low, ref = F.lower(text.strip(F.coalesce(title, F.lit("")))), F.lower(text.href_base(href))
    return (low == "") | F.regexp_like(low, F.lit("[.](?:x?html?|xml)$")) | (low == ref) | (low == F.substring_index(ref, "/", -1))


def resolved_title(title: Column, item_title: Column, href: Column, body: Column) -> Column:
    """A chapter's title: the contents' or the item's unless it is a file's name, else from the text, else the file's stem."""
    named = lambda t: F.when(~is_file_title(t, href), text.strip(F.regexp_replace(t, "\\s+", " ")))
    stem = F.regexp_replace(F.substring_index(text.href_base(href), "/", -1), "(?<=.)[.][^.]*$", "")
    return F.coalesce(named(title), named(item_title), F.nullif(text.title_of_text(body), F.lit("")), F.nullif(stem, F.lit("")), F.lit("chapter"))


def extracted(items: DataFrame, spine: DataFrame, toc: DataFrame) -> DataFrame:
    """book_id, idx (from 1), title, href and text of each chapter that has text.

    Chapters begin at the contents' entries (each file once) and take in the spine up to the next entry as long as
    it is of the same split series; a book whose contents lead nowhere has its spine's documents as chapters.
    """
    docs = items.where(F.col("media_type").isin(DOCUMENTS) & F.col("content").isNotNull()).withColumn("html", F.decode("content", "UTF-8"))
    notes = footnote_index(docs, "book_id", "href", "html")
    texts = docs.join(notes, "book_id").select("book_id", "item_id", "href", text.extracted(html.html_text(F.col("html"), F.col("note_ids"), F.col("backref_ids"))).alias("text"))
    placed = spine.join(texts, ["book_id", "item_id"]).withColumn("series", text.series_key(F.col("href")))
    entries = keep_first(toc.withColumn("base", text.href_base(F.col("href"))), ["book_id", "base"], ["pos"]).select(F.col("book_id").alias("_book"), "base", "title", F.col("href").alias("entry"))
    begins = placed.join(entries, (F.col("book_id") == F.col("_book")) & ((F.col("href") == F.col("base")) | (F.col("item_id") == F.col("base"))), "left").drop("_book")
    w = Window.partitionBy("book_id").orderBy("pos")
    start = F.last(F.when(F.col("entry").isNotNull(), F.struct("pos", "title", "entry", "series")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    any_entry = F.count("entry").over(Window.partitionBy("book_id")) > 0
    rows = begins.withColumn("_start", start).withColumn("_toc", any_entry)
    of = F.when(~F.col("_toc"), F.struct("pos", F.lit("").alias("title"), F.col("href").alias("entry"), "series")).when(F.col("entry").isNotNull() | (F.col("_start.series") == F.col("series")), F.col("_start"))
    rows = rows.withColumn("_of", of).where("_of IS NOT NULL AND text <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    chapters = rows.groupBy("book_id", "_of").agg(body.alias("text")).withColumn("text", text.extracted(F.col("text")))
    titled = chapters.withColumn("title", resolved_title(F.col("_of.title"), F.lit(None).cast("string"), F.col("_of.entry"), F.col("text")))
    return titled.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("_of.pos")).alias("idx"), "title", F.col("_of.entry").alias("href"), "text")


def title_page(title: Column, authors: Column) -> Column:
    """The text of a book's title chapter: `Title: Subtitle`, a blank line, and its authors."""
    parts = F.transform(F.split(F.trim(F.coalesce(title, F.lit(""))), ":", 2), lambda p: F.trim(p))
    head = F.array_join(F.filter(parts, lambda p: p != ""), ": ")
    names = F.array_join(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), ", ")
    return F.array_join(F.filter(F.array(head, F.when(names != "", F.concat(F.lit("by "), names)).otherwise("")), lambda x: x != ""), "\n\n")


def chapter_id(path: Column, index: Column, title: Column) -> Column:
    """The stem of a chapter's file, else its number and slug."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)[.][^.]*$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.format_string("%04d-%s", index, text.slug(title)))


def highlighted(body: Column, ranges: Column) -> Column:
    """HTML of a text with its ranges (array of start and end, merged and in order) marked."""
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    piece = lambda a, b: escape(F.substring(body, a + 1, b - a))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], r["start"]), F.lit("<mark>"), piece(r["start"], r["end"]), F.lit("</mark>")).alias("out"))
    return F.aggregate(ranges, zero, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(body))))

"""Books from raw to clean chapters, and edits of them, each as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import cleaning
from lectern.operators.chapters import chapter_id, title_page


def _rule(rule: Column) -> Column:
    return F.concat(F.lit(cleaning.FLAGS), rule)


def first_rule(value: Column, rules: Column) -> Column:
    """The first of an array of rules that is found in `value`, or null."""
    return F.try_element_at(F.filter(rules, lambda p: F.regexp_like(value, _rule(p))), F.lit(1))


def cut_at(value: Column, rules: Column) -> Column:
    """`text` up to the first rule in order that is found, without white space at its end, and that rule as `reason` (or "")."""
    reason = first_rule(value, rules)
    head = F.regexp_replace(F.element_at(F.split(value, _rule(reason), 2), 1), "\\s+$", "")
    return F.struct(F.when(reason.isNotNull(), head).otherwise(value).alias("text"), F.coalesce(reason, F.lit("")).alias("reason"))


def remove_rules(value: Column, rules: Column) -> Column:
    """`text` without what the rules find, one after the other, and `counts`, how often each was found."""
    start = F.struct(value.alias("text"), F.array().cast("array<int>").alias("counts"))
    step = lambda acc, p: F.struct(F.regexp_replace(acc["text"], _rule(p), F.lit("")).alias("text"), F.concat(acc["counts"], F.array(F.regexp_count(acc["text"], _rule(p)))).alias("counts"))
    return F.aggregate(rules, start, step)


def sanitized(books: DataFrame, chapters: DataFrame, repair: bool = True) -> DataFrame:
    """The report of cleaning: a row a chapter, with its clean text.

    `books` has book, title, authors and the columns of `sources.rules.effective`; `chapters` has book, index, title,
    path and text (null: its file is missing). Chapters without a path are left out. The report has book, index, title,
    raw_path, dropped, drop_reason (a rule, or missing_raw), cutoff_reason, raw_chars, clean_chars, removed (how often each
    remove rule was found) and text, which is null for dropped chapters. Books meet their chapters by a join on book.
    """
    rules = ["drop_chapter_title_patterns", "section_cutoff_patterns", "remove_patterns"]
    sides = books.select("book", F.col("title").alias("_title"), F.col("authors").alias("_authors"), *rules)
    rows = chapters.where("path IS NOT NULL AND path <> ''").join(sides, "book").withColumn("title", F.trim(F.coalesce("title", F.lit(""))))
    # each step is a column of its own, so no expression is evaluated twice
    rows = rows.withColumn("drop_reason", F.coalesce(first_rule(F.col("title"), F.col(rules[0])), F.when(F.col("text").isNull(), F.lit("missing_raw")), F.lit("")))
    rows = rows.withColumn("_raw", F.when(F.col("drop_reason") == "", text.cleaned(F.col("text"), unwrap=False)))
    rows = rows.withColumn("_cut", cut_at(F.col("_raw"), F.col(rules[1]))).withColumn("_left", remove_rules(F.col("_cut.text"), F.col(rules[2])))
    clean = text.cleaned(F.col("_left.text"), unwrap=False)
    if repair:
        clean = cleaning.case_repaired(clean, cleaning.context_words(F.col("_title"), F.col("_authors"), F.col("title")))
    rows = rows.withColumn("_clean", clean).withColumn("dropped", F.col("drop_reason") != "")
    kept = lambda c, other: F.when(~F.col("dropped"), c).otherwise(other)
    return rows.select(
        "book", "index", "title", F.col("path").alias("raw_path"), "dropped", "drop_reason", kept(F.col("_cut.reason"), F.lit("")).alias("cutoff_reason"),
        kept(F.length("_raw"), F.lit(0)).alias("raw_chars"), kept(F.length("_clean"), F.lit(0)).alias("clean_chars"), kept(F.col("_left.counts"), F.array().cast("array<int>")).alias("removed"), F.col("_clean").alias("text"),
    )


def clean_set(books: DataFrame, report: DataFrame) -> DataFrame:
    """The chapters of the clean set: book, index (from 1), title, path, source_index, kind and text, a newline at its end.

    A book that wasn't a text file, and has a title or authors, begins with a title page.
    """
    page = title_page(F.col("title"), F.col("authors"))
    titles = books.where(~F.endswith(F.lower("source"), F.lit(".txt"))).withColumn("_page", page).where("_page <> ''")
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Title"))
    first = titles.select("book", name.alias("title"), F.lit("clean/chapters/0000-title.txt").alias("path"), F.lit(0).alias("source_index"), F.lit("title").alias("kind"), F.concat("_page", F.lit("\n")).alias("text"))
    kept = report.where("NOT dropped").select("book", "title", F.concat(F.lit("clean/chapters/"), F.substring_index("raw_path", "/", -1)).alias("path"), F.col("index").cast("int").alias("source_index"), F.lit("chapter").alias("kind"), F.concat("text", F.lit("\n")).alias("text"))
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("kind"), "source_index", "path"))  # the title page first
    return first.unionByName(kept).withColumn("index", place)


def report_stats(books: DataFrame, report: DataFrame) -> DataFrame:
    """book, total_chapters, dropped_chapters, added_title_chapter and removed (matches by rule that was found) of each book."""
    counts = report.groupBy("book").agg(F.count("*").alias("total_chapters"), F.count_if("dropped").alias("dropped_chapters"))
    each = report.select("book", F.posexplode("removed").alias("n", "found")).groupBy("book", "n").agg(F.sum("found").alias("found")).where("found > 0")
    named = each.join(books.select("book", "remove_patterns"), "book").select("book", F.struct(F.element_at("remove_patterns", F.col("n") + 1).alias("rule"), "found").alias("r"))
    removed = named.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list("r"))).alias("removed"))
    added = books.select("book", ((title_page(F.col("title"), F.col("authors")) != "") & ~F.endswith(F.lower("source"), F.lit(".txt"))).alias("added_title_chapter"))
    zero = F.lit(0).cast("long")
    out = added.join(counts, "book", "left").join(removed, "book", "left")
    return out.select("book", F.coalesce("total_chapters", zero).alias("total_chapters"), F.coalesce("dropped_chapters", zero).alias("dropped_chapters"), "added_title_chapter", F.coalesce("removed", F.create_map().cast("map<string,bigint>")).alias("removed"))


def loaded(toc: DataFrame, files: DataFrame) -> DataFrame:
    """book, index, id, title, text and path of the chapters that a table of contents (book, pos, index, title, path) names.

    `files` has book, path and value. Entries without a path and empty texts are left out; a missing file is an error.
    """
    rows = toc.where("path IS NOT NULL AND path <> ''").join(files.select("book", "path", F.col("value").alias("_value"), F.lit(True).alias("_there")), ["book", "path"], "left")
    value = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing chapter file: "), "path")).cast("string")).otherwise(F.col("_value"))
    rows = rows.withColumn("text", text.clean_file_text(value)).where(F.trim("text") != "").where("text <> '\n'")
    index = F.coalesce(F.nullif(F.col("index"), F.lit(0)), F.col("pos"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.format_string("Chapter %d", index))
    return rows.select("book", index.alias("index"), chapter_id(F.col("path"), index, title).alias("id"), title.alias("title"), "text", "path")


def combined_input(chapters: DataFrame) -> DataFrame:
    """book and text, its chapters' stripped texts in order with a blank line between them and a newline at the end.

    A book is one row here, as it is one file: this is for books, not for corpora."""
    body = chapters.withColumn("text", text.strip(F.col("text"))).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "\n\n")
    return body.groupBy("book").agg(F.concat(joined, F.lit("\n")).alias("text"))


def only(chapters: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The chapters whose id is in `ids`, an error-free subset: ids that no chapter has do nothing."""
    return chapters.join(ids.select(key).distinct(), key, "left_semi")


def stale(folders: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """The folders that the keep-set doesn't name."""
    return folders.join(keep.select(*keys).distinct(), keys, "left_anti")


def first_chapters(chapters: DataFrame, book: str, order: str) -> DataFrame:
    """The first chapter of each book by `order`, by one pre-aggregated minimum."""
    rest = [c for c in chapters.columns if c not in (book, order)]
    least = chapters.groupBy(book).agg(F.min(F.struct(order, *rest)).alias("_m"))
    return least.select(book, f"_m.{order}", *(f"_m.{c}" for c in rest))


def edited(chapters: DataFrame, edits: DataFrame, keys: list[str], value: str = "text") -> DataFrame:
    """A snapshot in which the texts of `edits` (unique in `keys`) stand in place of the old, with `changed` telling which did."""
    new = edits.select(*keys, F.col(value).alias("_new"))
    out = chapters.join(new, keys, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(value))
    return out.withColumn("changed", changed).withColumn(value, F.coalesce("_new", value)).drop("_new")


def without_cache(manifest: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest without the chapters whose chunks and segments are deleted."""
    return manifest.join(gone.select(*keys).distinct(), keys, "left_anti")


def reset_sample(manifest: DataFrame, book: str, order: str, durations: str = "durations") -> DataFrame:
    """The manifest with the durations of each book's first chapter as nulls, so that it alone is made anew."""
    first = manifest.groupBy(book).agg(F.min(order).alias("_first"))
    out = manifest.join(first, book)
    return out.withColumn(durations, F.when(F.col(order) == F.col("_first"), F.transform(durations, lambda d: F.nullif(d, d))).otherwise(F.col(durations))).drop("_first")


def with_fields(document: Column, edits: Column) -> Column:
    """A map with the entries of another merged in; a null value removes its key."""
    both = F.map_concat(F.map_filter(document, lambda k, v: ~F.array_contains(F.map_keys(edits), k)), edits)
    return F.map_filter(both, lambda k, v: v.isNotNull())


def progress(done: Column, total: Column) -> Column:
    """Percent with two decimals, at most 100; nothing to do is 0."""
    return F.when(total > 0, F.least(F.lit(100.0), F.bround(done / total * 100.0, 2))).otherwise(0.0)


def reused(requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`requests` with whether an earlier one had the same keys, whose result is used again; keys are pre-aggregated."""
    first = requests.groupBy(*keys).agg(F.min(order).alias("_first"))
    return requests.join(first, keys).withColumn("reused", F.col("_first") < F.col(order)).drop("_first")

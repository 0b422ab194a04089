"""Books end to end: rules, cleaning, readers, files and edits."""

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lectern.functions import segment
from lectern.operators import books, chapters
from lectern.queries.cleaning import WS, digest, sql_clamp, sql_lines, sql_quotes
from lectern.queries.registry import query
from lectern.session import shared_path
from lectern.sinks import files as sinks
from lectern.sources import epub, files, jsonl, rules


@query(
    "s9_rule_sets",
    r"""WITH k AS (SELECT * FROM (VALUES ('drop_chapter_title_patterns', 17, '^about (the )?authors?$', '^title page$'), ('section_cutoff_patterns', 5, '^\s*references\s*$', '^\s*footnotes\s*$'), ('remove_patterns', 9, NULL, NULL)) k(kind, n, first, last))
SELECT s_suppkey, kind, (CASE s_suppkey % 4 WHEN 0 THEN n + CASE kind WHEN 'drop_chapter_title_patterns' THEN 28 ELSE 0 END WHEN 1 THEN n + CASE kind WHEN 'drop_chapter_title_patterns' THEN 1 ELSE 0 END WHEN 2 THEN CASE kind WHEN 'remove_patterns' THEN 2 ELSE 0 END ELSE n END)::BIGINT AS n,
CASE WHEN kind = 'remove_patterns' THEN NULL WHEN s_suppkey % 4 = 2 THEN NULL ELSE first END AS first,
CASE WHEN kind = 'remove_patterns' THEN CASE s_suppkey % 4 WHEN 2 THEN 'b' END WHEN s_suppkey % 4 = 2 THEN NULL WHEN kind = 'section_cutoff_patterns' THEN last WHEN s_suppkey % 4 = 0 THEN '^List\ of\ figures' WHEN s_suppkey % 4 = 1 THEN '^part ' || s_suppkey || '$' ELSE last END AS last
FROM supplier, k WHERE NOT (s_suppkey % 4 = 2 AND kind <> 'remove_patterns')""",
)
def _(t):
    said = F.when(F.col("s_suppkey") % 4 == 1, F.format_string('{"drop_chapter_title_patterns": ["^part %d$"]}', "s_suppkey")).when(F.col("s_suppkey") % 4 == 2, F.lit('{"replace_defaults": true, "remove_patterns": ["a", "b"], "other": 1}')).when(F.col("s_suppkey") % 4 == 3, F.lit("{}"))
    rows = rules.rows(rules.effective(t.supplier.select("s_suppkey", said.alias("rules"))), "s_suppkey")
    ends = rows.groupBy("s_suppkey", "kind").agg(F.count("*").alias("n"), F.min_by("pattern", "ord").alias("first"), F.max_by("pattern", "ord").alias("last"))
    plain = (F.col("kind") == "remove_patterns") & (F.col("s_suppkey") % 4 != 2)
    return ends.select("s_suppkey", "kind", "n", F.when(F.col("kind") != "remove_patterns", F.col("first")).alias("first"), F.when(~plain, F.col("last")).alias("last"))


@query("u2_u3_rule_sets", "WITH d AS (SELECT DISTINCT p_type || p_size AS pattern FROM part WHERE p_size < 20) SELECT pattern FROM (SELECT DISTINCT p_type || (p_size - 10) AS pattern FROM part WHERE p_size > 10) EXCEPT SELECT pattern FROM d")
def _(t):
    kind = F.lit("drop").alias("kind")
    own = t.part.where("p_size > 10").select(kind, F.concat("p_type", F.col("p_size") - 10).alias("pattern"))
    return rules.own_rules(own, t.part.where("p_size < 20").select(kind, F.concat("p_type", "p_size").alias("pattern"))).select("pattern")


TITLES = "['Chapter One', 'NOTES', 'Index of Love', 'About the Authors', 'Copyright page', 'Part', 'Maps', ' contents ']"
RAW = "CASE WHEN turn % 5 <> 4 THEN text || ' seen (Smith, 1999) word[3].' || CASE turn % 3 WHEN 0 THEN chr(10) || 'References' || chr(10) || 'Smith' WHEN 1 THEN chr(10) || ' Appendix ' || chr(10) || 'tail' ELSE '' END END"
OWN = '{"remove_patterns": ["\\\\bthe\\\\b"], "section_cutoff_patterns": ["^\\\\s*appendix\\\\s*$"]}'


def conversation_books(t):
    """A book a conversation and a chapter a turn; books with odd ids have rules of their own, every fourth was a text file."""
    book = F.col("conv_id").alias("book")
    own = F.when(F.col("conv_id") % 2 == 1, F.lit(OWN))
    source = F.when(F.col("conv_id") % 4 == 0, F.lit("a.TXT")).otherwise("a.epub")
    shelf = t.conversations.groupBy("conv_id").agg(F.max_by("role", "turn").alias("r")).select(book, F.concat(F.lit("Book "), "conv_id").alias("title"), F.array(F.lit(" Ann "), F.lit(""), "r").alias("authors"), source.alias("source"), own.alias("rules"))
    turns = t.conversations.select(book, F.col("turn").alias("index"), F.expr(TITLES.replace("[", "element_at(array(", 1).replace("]", "), int(1 + turn % 8))")).alias("title"), F.format_string("raw/chapters/%04d.txt", "turn").alias("path"), F.expr(RAW.replace("chr(10)", "'\n'")).alias("text"))
    return rules.effective(shelf), turns


def sql_plain(x):
    return f"regexp_replace({sql_clamp("regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + sql_clamp(sql_lines(sql_quotes(x))) + ", '(^|[\\s“(\"])\\[([A-Za-z])\\]([a-z])', '\\1\\2\\3', 'g'), '-\\n(\\w)', '-\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\.[ \\t]*\\.[ \\t]*\\.', '...', 'g')")}, {WS})"


REPORT = rf"""c AS (SELECT conv_id AS book, turn AS index, trim({TITLES}[1 + turn % 8]) AS title, {RAW} AS t FROM conversations),
d AS (SELECT *, CASE WHEN title = 'NOTES' THEN '^notes$' WHEN title = 'About the Authors' THEN '^about (the )?authors?$' WHEN title = 'contents' THEN '^contents$' WHEN book % 2 = 0 AND title = 'Copyright page' THEN '^Copyright\ Page$' WHEN book % 2 = 0 AND title = 'Maps' THEN '^Maps$' WHEN t IS NULL THEN 'missing_raw' ELSE '' END AS drop_reason FROM c),
e AS (SELECT *, CASE WHEN drop_reason <> '' THEN NULL ELSE {sql_plain('t')} END AS raw FROM d),
f AS (SELECT *, CASE WHEN raw IS NULL THEN '' WHEN index % 3 = 0 THEN '^\s*references\s*$' WHEN index % 3 = 1 AND book % 2 = 1 THEN '^\s*appendix\s*$' ELSE '' END AS cutoff_reason FROM e),
g AS (SELECT *, CASE WHEN cutoff_reason <> '' THEN regexp_replace(string_split_regex(raw, '(?im)' || CASE WHEN index % 3 = 0 THEN '^\s*references\s*$' ELSE '^\s*appendix\s*$' END)[1], '\s+$', '') ELSE raw END AS cut FROM f),
h AS (SELECT *, replace(replace(cut, '(Smith, 1999)', ''), '[3]', '') AS r0 FROM g),
i AS (SELECT *, CASE WHEN book % 2 = 1 THEN len(regexp_extract_all(r0, '(?i)\bthe\b')) ELSE 0 END AS the, CASE WHEN book % 2 = 1 THEN regexp_replace(r0, '(?i)\bthe\b', '', 'g') ELSE r0 END AS r1 FROM h),
report AS (SELECT book, index, title, drop_reason <> '' AS dropped, drop_reason, cutoff_reason, coalesce(length(raw), 0)::INT AS raw_chars, coalesce(length({sql_plain('r1')}), 0)::INT AS clean_chars, CASE WHEN raw IS NULL THEN 0 ELSE 2 + the END::BIGINT AS removals, CASE WHEN raw IS NULL THEN 0 ELSE the END::BIGINT AS the FROM i)"""


@query("x1_sanitized_books", f"WITH {REPORT} SELECT * EXCLUDE (the) FROM report")
def _(t):
    report = books.sanitized(*conversation_books(t))
    return report.select("book", "index", "title", "dropped", "drop_reason", "cutoff_reason", "raw_chars", "clean_chars", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x).alias("removals"))


@query("a5_report_stats", f"WITH {REPORT} SELECT book, count(*) AS total_chapters, count_if(dropped)::BIGINT AS dropped_chapters, book % 4 <> 0 AS added_title_chapter, coalesce(sum(removals), 0)::BIGINT AS removals, (CASE WHEN sum(removals) = 0 THEN 0 ELSE 2 + (sum(the) > 0)::INT END)::INT AS rules FROM report GROUP BY book")
def _(t):
    shelf, raw = conversation_books(t)
    stats = books.report_stats(shelf, books.sanitized(shelf, raw))
    return stats.select("book", "total_chapters", "dropped_chapters", "added_title_chapter", F.aggregate(F.map_values("removed"), F.lit(0).cast("long"), lambda n, x: n + x).alias("removals"), F.size("removed").alias("rules"))


@query(
    "k2_clean_files",
    f"""WITH {REPORT}, s AS (SELECT book, 0 AS source_index, 'clean/chapters/0000-title.txt' AS path, length('Book ' || book || chr(10) || chr(10) || 'by Ann, ' || r)::BIGINT + 1 AS chars FROM (SELECT conv_id AS book, arg_max(role, turn) AS r FROM conversations GROUP BY conv_id) WHERE book % 4 <> 0
UNION ALL SELECT book, index, 'clean/chapters/' || lpad(index::VARCHAR, 4, '0') || '.txt', clean_chars + 1 FROM report WHERE NOT dropped)
SELECT book::VARCHAR || '/' || path AS path, chars, row_number() OVER (PARTITION BY book ORDER BY ends_with(path, '-title.txt') DESC, source_index) AS index FROM s""",
)
def _(t):
    shelf, raw = conversation_books(t)
    clean = sinks.in_books(books.clean_set(shelf, books.sanitized(shelf, raw)))
    folder = shared_path(t.spark, "books")
    back = files.read_named(sinks.write_files(clean, folder, keep=("index",)), folder, keep=("index",))
    return back.select("path", F.length(F.col("content").cast("string")).cast("long").alias("chars"), F.col("index").cast("long").alias("index"))


@query("k1_raw_files", "SELECT conv_id::VARCHAR || '/raw/chapters/' || lpad(turn::VARCHAR, 4, '0') || '-' || role || '.txt' AS path, md5(regexp_replace(text, '\\s+$', '') || chr(10)) AS digest FROM conversations")
def _(t):
    raw = t.conversations.select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("title"), F.lit("").alias("href"), F.concat("text", F.lit(" \n\n")).alias("text"))
    folder = shared_path(t.spark, "raw")
    back = files.read_named(sinks.write_files(sinks.in_books(sinks.raw_files(raw)), folder), folder)
    return back.select("path", digest(F.col("content")))


@query("k1_contents", "SELECT conv_id::VARCHAR AS book, 'Book ' || conv_id AS title, list(turn ORDER BY turn) AS indexes, count(*) AS chapters FROM conversations GROUP BY conv_id")
def _(t):
    entries = t.conversations.select(F.col("conv_id").cast("string").alias("book"), F.concat(F.lit("Book "), "conv_id").alias("title"), F.col("turn").alias("index"), F.col("role").alias("name"))
    made = sinks.contents(entries, ["index", "name"], ["title"])
    said = files.json_document(F.col("text"), "title string, chapters array<struct<index: bigint, name: string>>", strict=True)
    return made.select("book", said.alias("s")).select("book", "s.title", F.col("s.chapters.index").alias("indexes"), F.size("s.chapters").cast("long").alias("chapters"))


@query("k3_chunk_files", "SELECT conv_id || '/chunks/' || role || '/' || lpad(turn::VARCHAR, 6, '0') || '.txt' AS path, length(max(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id, role, turn")
def _(t):
    rows = t.conversations.groupBy("conv_id", "role", "turn").agg(F.max("text").alias("text")).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7f]", "?"))
    return sinks.write_files(sinks.chunk_files(rows.withColumn("conv_id", F.col("conv_id").cast("string")), "conv_id", "role", "turn", "text"), shared_path(t.spark, "chunks")).select("path", "bytes")


@query("k3_stale_chunks", "SELECT conv_id || '/chunks/a/' || lpad(turn::VARCHAR, 6, '0') || '.txt' AS path FROM conversations WHERE turn > 3")
def _(t):
    name = lambda df: sinks.chunk_files(df.select(F.col("conv_id").cast("string").alias("book"), F.lit("a").alias("chapter"), "turn", "text"), "book", "chapter", "turn", "text")
    return sinks.stale_chunks(name(t.conversations), name(t.conversations.where("turn <= 3")))


@query("k4_combined_input", f"SELECT conv_id AS book, md5(string_agg(s, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS digest FROM (SELECT conv_id, turn, regexp_replace(text, {WS}) AS s FROM conversations) WHERE s <> '' GROUP BY conv_id")
def _(t):
    return books.combined_input(t.conversations.select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), "text")).select("book", digest(F.col("text")))


@query("k6_appended_lines", "SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 5 = 0")
def _(t):
    path = shared_path(t.spark, "log")
    for rows in ("event_id % 2 = 0", "event_id % 5 = 0"):
        jsonl.append(t.events.where(rows).select("event_id", "event_type"), path)
    return jsonl.read(t.spark, path, "event_id long, event_type string")


@query("k13_progress", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE least(100.0, round_even(floor(value) / (event_id % 9 * 40) * 100, 2)) END::DOUBLE AS percent FROM events")
def _(t):
    return t.events.select("event_id", books.progress(F.floor("value"), F.col("event_id") % 9 * 40).alias("percent"))


@query("s2_text_books", "SELECT lpad(page_id::VARCHAR, 4, '0') || '_my-page.txt' AS file, 'my page' AS title, 'raw/chapters/0001-my-page.txt' AS path, md5(regexp_replace(html, '\\s+$', '') || chr(10)) AS digest FROM pages")
def _(t):
    folder = shared_path(t.spark, "texts")
    made = sinks.write_files(t.pages.select(F.format_string("%04d_my-page.txt", "page_id").alias("path"), F.concat("html", F.lit("\n \n")).alias("text")), folder)
    return files.text_books(files.read_named(made, folder).withColumn("value", F.col("content").cast("string"))).select(F.substring_index("source", "/", -1).alias("file"), "title", "path", digest(F.col("text")))


@query("s3_suffix_dispatch", "SELECT page_id, CASE WHEN regexp_matches(lower(u), '[.]epub$') THEN 'epub' WHEN regexp_matches(lower(u), '[.]txt$') THEN 'txt' ELSE 'unsupported' END AS kind FROM (SELECT page_id, url || ['.epub', '.TXT', '.pdf', ''][1 + page_id % 4] AS u FROM pages)")
def _(t):
    return t.pages.select("page_id", files.suffix_kind(F.concat("url", F.expr("element_at(array('.epub', '.TXT', '.pdf', ''), int(1 + page_id % 4))"))).alias("kind"))


@query("s5_loaded_chapters", "SELECT conv_id AS book, CASE WHEN turn = 0 THEN 1 ELSE turn END AS index, lpad(turn::VARCHAR, 4, '0') AS id, CASE WHEN turn % 2 = 0 THEN 'Chapter ' || CASE WHEN turn = 0 THEN 1 ELSE turn END ELSE role END AS title FROM conversations WHERE turn % 4 <> 3")
def _(t):
    toc = t.conversations.select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("pos"), F.col("turn").alias("index"), F.when(F.col("turn") % 2 == 1, F.col("role")).otherwise("").alias("title"), F.format_string("clean/%04d.txt", "turn").alias("path"))
    texts = t.conversations.select(F.col("conv_id").alias("book"), F.format_string("clean/%04d.txt", "turn").alias("path"), F.when(F.col("turn") % 4 != 3, F.concat(F.lit("a"), "text")).otherwise(" \n ").alias("value"))
    return books.loaded(toc, texts).select("book", "index", "id", "title")


@query("s6_text_chapters", "SELECT page_id, 'my page ' || page_id AS title, '0001-my-page-' || page_id AS id FROM pages")
def _(t):
    rows = t.pages.select("page_id", F.concat(F.lit("/a.b/my page "), "page_id", F.lit(".txt")).alias("path"), F.col("html").alias("value"))
    return files.text_chapters(rows).select(F.regexp_extract("path", "(\\d+)[.]txt$", 1).cast("long").alias("page_id"), "title", "id")


@query("s7_json_documents", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 10 END AS k FROM events")
def _(t):
    said = F.when(F.col("event_id") % 3 == 0, F.format_string(' {"k": %d, "x": [1]}', F.col("event_id") % 10)).when(F.col("event_id") % 3 == 1, F.lit("[1]"))
    return t.events.select("event_id", files.json_document(said, "k long")["k"].alias("k"))


@query("s12_voice_maps", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_suppkey END AS voice, CASE WHEN s_suppkey % 3 = 2 THEN 0 WHEN s_suppkey % 3 = 1 THEN 0 ELSE 2 END::INT AS chapters FROM supplier")
def _(t):
    said = F.when(F.col("s_suppkey") % 3 == 0, F.format_string('{"default": "v%d", "chapters": {"a": "x", "b": null}}', "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, F.lit('{"chapters": ["no"]}'))
    return t.supplier.select("s_suppkey", files.voice_map(said).alias("m")).select("s_suppkey", F.col("m.default").alias("voice"), F.size("m.chapters").alias("chapters"))


def _little(value, width):
    """An integer's bytes, the least first, in hexadecimal."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * (width - 1 - i) + 1, 2) for i in range(width)))


@query(
    "s15_wav_headers",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round_even(event_id % 1000 * 1000.0 / (8000 + event_id % 7), 0) END::BIGINT AS ms, event_id % 5 <> 0 AND event_id % 2 = 0 AND event_id % 1000 > 0 AS valid FROM events",
)
def _(t):
    channels, rate = F.when(F.col("event_id") % 2 == 0, 1).otherwise(2), 8000 + F.col("event_id") % 7
    size = F.col("event_id") % 1000 * 2 * channels
    extra = F.when(F.col("event_id") % 3 == 0, F.lit("4C49535403000000616263" + "00")).otherwise("")  # a chunk of odd size in between
    raw = F.concat(F.lit("52494646"), _little(size + 36, 4), F.lit("57415645666D7420"), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(channels, 2), _little(rate, 4), _little(rate * 2 * channels, 4), _little(2 * channels, 2), _little(F.lit(16), 2), extra, F.lit("64617461"), _little(size, 4))
    content = F.when(F.col("event_id") % 5 == 0, F.unhex(F.lit("52494646"))).otherwise(F.unhex(raw))
    rows = t.events.select("event_id", files.wav_header(content).alias("h"))
    return rows.select("event_id", files.wav_duration(F.col("h")).alias("ms"), files.is_valid_wav(F.col("h")).alias("valid"))


@query("s16_library_books", "SELECT DISTINCT 'book' || (page_id % 40) AS book FROM pages WHERE page_id % 3 = 0")
def _(t):
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/l/book"), F.col("page_id") % 40, F.lit("/clean/toc.json"))).when(F.col("page_id") % 3 == 1, F.lit("/l/_m4b/clean/toc.json")).otherwise("/l/book9/toc.json")
    return files.library_books(t.pages.select(path.alias("path")))


@query("s18_voice_genders", "SELECT s_suppkey, ['female', 'male', NULL, NULL, 'male'][1 + s_suppkey % 5] AS gender FROM supplier")
def _(t):
    name = F.concat(F.lit("voices/"), "s_suppkey", F.lit(".wav"))
    said = F.expr("""element_at(array('"Female"', '{"gender": " male "}', '"none"', '7', '"MALE"'), int(1 + s_suppkey % 5))""")
    document = F.concat(F.lit('{"elsewhere/x.wav": "male", "'), name, F.lit('": '), said, F.lit("}"))
    return t.supplier.select("s_suppkey", F.try_element_at(files.voice_genders(document), name).alias("gender"))


@query("t23b_stored_voices", "SELECT s_suppkey, ['', 'default-voice', 'voices/a.wav', '/other/b.wav', s_name][1 + s_suppkey % 5] AS voice FROM supplier")
def _(t):
    raw = F.expr("element_at(array(' ', ' DEFAULT', '/lib/voices/a.wav', '/other/b.wav', concat(s_name, ' ')), int(1 + s_suppkey % 5))")
    return t.supplier.select("s_suppkey", files.stored_voice(raw, F.lit("/lib/")).alias("voice"))


@query("f19_contained_paths", "SELECT event_id, [true, false, true, false, true, false][1 + event_id % 6] AS inside FROM events")
def _(t):
    raw = F.expr("element_at(array('a/b.txt', '../x', 'a/../b', 'a/../../lib2/c', '/lib/a/./b', '/libx/a'), int(1 + event_id % 6))")
    return t.events.select("event_id", files.within(raw, F.lit("/lib")).alias("inside"))


@query("f15_chapter_subset", "SELECT conv_id, turn FROM conversations WHERE 'c' || turn IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_suppkey < 5)")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("c"), "turn").alias("id"))
    return books.only(rows, t.supplier.where("s_suppkey < 5").select(F.concat(F.lit("c"), "s_suppkey").alias("id"))).select("conv_id", "turn")


@query("u5_stale_folders", "SELECT DISTINCT source, lang FROM documents WHERE (source, lang) NOT IN (SELECT source, lang FROM documents WHERE doc_id % 50 = 0)")
def _(t):
    return books.stale(t.documents.select("source", "lang").distinct(), t.documents.where("doc_id % 50 = 0"), ["source", "lang"])


@query("o5_first_chapters", "SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(t):
    return books.first_chapters(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn")


@query("x4_edited_texts", "SELECT conv_id, turn, md5(CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN 'new ' || text ELSE text END) AS digest, turn = 2 AND conv_id % 3 = 0 AS changed FROM conversations")
def _(t):
    edits = t.conversations.where("turn = 2 AND conv_id % 3 = 0").select("conv_id", "turn", F.concat(F.lit("new "), "text").alias("text"))
    return books.edited(t.conversations.select("conv_id", "turn", "text"), edits, ["conv_id", "turn"]).select("conv_id", "turn", digest(F.col("text")), "changed")


@query("x4b_removed_from_cache", "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def _(t):
    return books.without_cache(t.conversations.select("conv_id", "turn"), t.conversations.where("role = 'system'"), ["conv_id", "turn"])


@query("x5_merged_fields", "SELECT s_suppkey, list_sort(list_filter(['title=' || CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END, CASE WHEN s_suppkey % 3 <> 0 THEN 'year=' || s_nationkey END, 'lang=en'], lambda x: x IS NOT NULL)) AS fields FROM supplier")
def _(t):
    now = F.create_map(F.lit("title"), F.lit("old"), F.lit("year"), F.col("s_nationkey").cast("string"), F.lit("lang"), F.lit("en"))
    edits = F.map_filter(F.create_map(F.lit("title"), F.lit("new"), F.lit("year"), F.lit(None).cast("string")), lambda k, v: F.when(k == "title", F.col("s_suppkey") % 2 == 0).otherwise(F.col("s_suppkey") % 3 == 0))
    merged = books.with_fields(now, edits)
    return t.supplier.select("s_suppkey", F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("fields"))


@query("x8_sample_reset", "SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 2 END::INT AS done, 2::INT AS chunks FROM conversations")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.array(F.length("text"), F.length("role")).alias("durations"))
    out = books.reset_sample(rows, "conv_id", "turn")
    return out.select("conv_id", "turn", F.size(F.filter("durations", lambda d: d.isNotNull())).alias("done"), F.size("durations").alias("chunks"))


@query("x11_preview_memo", "SELECT a.event_id, b.first IS NOT NULL AND b.first < a.event_id AS reused FROM events a JOIN (SELECT user_id, event_type, round(value) AS v, min(event_id) AS first FROM events GROUP BY ALL) b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.v = round(a.value)")
def _(t):
    return books.reused(t.events.select("event_id", "user_id", "event_type", F.round("value").alias("v")), ["user_id", "event_type", "v"], "event_id").select("event_id", "reused")


@query("c8_respoken_chunks", "SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['eleven hundred men went.', 'Twelve went home.'] ELSE ['short ' || p_partkey] END) AS said, generate_subscripts(CASE WHEN p_partkey % 2 = 0 THEN [1, 2] ELSE [1] END, 1)::INT - 1 AS part FROM part")
def _(t):
    said = F.when(F.col("p_partkey") % 2 == 0, F.lit("eleven hundred men went. Twelve went home.")).otherwise(F.concat(F.lit("short "), "p_partkey"))
    return segment.respoken(t.part.select("p_partkey", said.alias("said")), "said", 30).select("p_partkey", "said", "part")


@query("c3_sentences", r"SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, regexp_replace(lower(text), '([a-z\x{80}-\x{10ffff}]+)[.]', '\1xx.', 'g') AS t FROM documents)) WHERE s <> '' GROUP BY doc_id")
def _(t):
    # no word before a full stop is an abbreviation here, so each mark ends a sentence
    plain = F.regexp_replace(F.lower("text"), "([a-z\\x{80}-\\x{10ffff}]+)[.]", "$1xx.")
    rows = t.all_cores("documents").select("doc_id", plain.alias("t")).select("doc_id", F.explode(segment.sentence_spans(F.col("t"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"))


@F.udf(BinaryType())
def _epub(title, turns):
    """An EPUB of files in a split series; the contents name the first and every third."""
    import io
    import zipfile

    raw = io.BytesIO()
    names = [f"t/b_split_{x.turn:03}.html" for x in turns]
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
        z.writestr("p.opf", f'<package xmlns:dc="d"><metadata><dc:title>{title}</dc:title></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{spine}</spine></package>')
        points = "".join(f"<navPoint><navLabel><text>Part {x.turn}</text></navLabel><content src='{n}'/></navPoint>" for k, (x, n) in enumerate(zip(turns, names)) if not k or x.turn % 3 == 0)
        z.writestr("toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
        for x, n in zip(turns, names):
            z.writestr(n, f"<html><head><title>no</title></head><body><p>{x.words}</p></body></html>")
    return raw.getvalue()


@query(
    "s1_h4_extracted_books",
    """WITH w AS (SELECT conv_id, turn, trim(regexp_replace(max(text), '[^A-Za-z]+', ' ', 'g')) AS words FROM conversations GROUP BY conv_id, turn),
e AS (SELECT *, sum((turn % 3 = 0 OR turn = first)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM w))
SELECT conv_id || '.epub' AS book, idx::INT AS idx, 'Part ' || min(turn) AS title, 't/b_split_' || lpad(min(turn)::VARCHAR, 3, '0') || '.html' AS href, md5(string_agg(words, chr(10) || chr(10) ORDER BY turn)) AS digest FROM e WHERE words <> '' GROUP BY conv_id, idx""",
)
def _(t):
    words = t.conversations.groupBy("conv_id", "turn").agg(F.trim(F.regexp_replace(F.max("text"), "[^A-Za-z]+", " ")).alias("words"))
    shelf = words.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "words"))).alias("turns"))
    folder = shared_path(t.spark, "epubs")
    made = sinks.write_files(shelf.select(F.concat(F.col("conv_id").cast("string"), F.lit(".epub")).alias("path"), _epub(F.concat(F.lit("Book "), "conv_id"), "turns").alias("text")), folder)
    read = epub.read_named(made, folder)
    return chapters.extracted(epub.items(read), epub.spine(read), epub.toc(read)).select(F.substring_index("book_id", "/", -1).alias("book"), "idx", "title", "href", digest(F.col("text")))

"""Titles, pages, playback and files of a shelf of books."""

from pyspark.sql import functions as F

from lectern.functions import speech
from lectern.operators import chapters, playback
from lectern.queries.registry import query

TITLE = "['', 'Part_split_003.html', 'intro.XHTML', 'My  Life', 'a/b c.html', 'notes.txt'][1 + page_id % 6]"


@query(
    "f10_t17_resolved_titles",
    f"SELECT page_id, CASE WHEN page_id % 6 = 3 THEN 'My Life' WHEN page_id % 6 = 5 THEN 'notes.txt' WHEN page_id % 2 = 0 THEN 'b c' ELSE 'Found here' END AS title FROM (SELECT page_id, {TITLE} AS t FROM pages)",
)
def _(t):
    title = F.expr("element_at(array('', 'Part_split_003.html', 'intro.XHTML', 'My  Life', 'a/b c.html', 'notes.txt'), int(1 + page_id % 6))")
    body = F.when(F.col("page_id") % 2 == 0, F.lit("IV\n12")).otherwise(F.lit("IV\nFound here!"))
    return t.pages.select("page_id", chapters.resolved_title(title, F.lit(None).cast("string"), F.lit("a/b%20c.html#x"), body).alias("title"))


@query("t11_title_pages", "SELECT doc_id, ['The Book: Of X', 'Plain', ': Sub', ''][1 + doc_id % 4] || '' AS t0, concat_ws(chr(10) || chr(10), nullif(['The Book: Of X', 'Plain', 'Sub', ''][1 + doc_id % 4], ''), 'by ' || source || CASE WHEN doc_id % 2 = 0 THEN ', ' || lang ELSE '' END) AS page FROM documents")
def _(t):
    title = F.expr("element_at(array('The Book: Of X', 'Plain', ': Sub', ''), int(1 + doc_id % 4))")
    names = F.array(F.concat(F.lit(" "), "source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" "))
    return t.documents.select("doc_id", title.alias("t0"), chapters.title_page(title, names).alias("page"))


@query("t19_chapter_ids", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'c' || turn ELSE lpad(turn::VARCHAR, 4, '0') || '-' || role END AS id FROM conversations")
def _(t):
    path = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x/c"), "turn", F.lit(".txt"))).otherwise("")
    return t.conversations.select("conv_id", "turn", chapters.chapter_id(path, F.col("turn"), F.initcap("role")).alias("id"))


def _(t):
    ranges = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end")))
    return t.documents.where("length(text) >= 20").select("doc_id", chapters.highlighted(F.substring("text", 1, 20), ranges).alias("marked"))


def sql_escaped(x):
    for mark, name in (("'&'", "amp"), ("'<'", "lt"), ("'>'", "gt"), ("'\"'", "quot"), ("chr(39)", "#x27")):
        x = f"replace({x}, {mark}, '&{name};')"
    return x


PIECES = ["substr(text, 1, n // 4)", "substr(text, n // 4 + 1, n // 2 - n // 4)", "substr(text, n // 2 + 1, 3 * n // 4 - n // 2)", "substr(text, 3 * n // 4 + 1, n - 3 * n // 4)"]


@query("t20_highlights", f"SELECT doc_id, md5({sql_escaped(PIECES[0])} || '<mark>' || {sql_escaped(PIECES[1])} || '</mark>' || {sql_escaped(PIECES[2])} || '<mark>' || {sql_escaped(PIECES[3])} || '</mark>') AS digest FROM (SELECT doc_id, text, length(text) AS n FROM documents)")
def _(t):
    at = lambda x: F.expr(f"int({x})")
    ranges = F.array(*(F.struct(at(a).alias("start"), at(b).alias("end")) for a, b in (("length(text) div 4", "length(text) div 2"), ("3L * length(text) div 4", "length(text)"))))
    return t.documents.select("doc_id", F.md5(chapters.highlighted(F.col("text"), ranges).cast("binary")).alias("digest"))


@query("t22_source_types", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'epub' WHEN 1 THEN 'text' ELSE 'other' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'author' ELSE 'unknown' END AS origin FROM pages")
def _(t):
    source = F.expr("element_at(array('b.EPUB', 'c.txt', 'd'), int(1 + page_id % 3))")
    return t.pages.select("page_id", *playback.source_kind(source, F.col("page_id") % 2 == 0))


@query("f18_playback_state", "SELECT event_id, CASE WHEN v >= 0 THEN v END AS last_played, list_filter([v, -1, event_id], lambda x: x >= 0) AS bookmarks FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 - 2 END AS v FROM events)")
def _(t):
    v = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5 - 2)
    return t.events.select("event_id", playback.position(v).alias("last_played"), playback.bookmarks(F.array(v, F.lit(-1).cast("long"), F.col("event_id"))).alias("bookmarks"))


@query("f20_valid_spans", "SELECT event_id, list_filter([[event_id % 7 - 2, event_id % 5], [0, 3], [4, 1]], lambda s: s[1] >= 0 AND s[2] >= s[1]) AS spans FROM events")
def _(t):
    spans = F.array(F.array(F.col("event_id") % 7 - 2, F.col("event_id") % 5), F.array(F.lit(0), F.lit(3)).cast("array<bigint>"), F.array(F.lit(4), F.lit(1)).cast("array<bigint>"), F.array(F.lit(9)).cast("array<bigint>"))
    return t.events.select("event_id", playback.valid_spans(spans).alias("spans"))


@query("m2_clone_times", "SELECT event_id, ['5', '90.5', '90', '3723.25', NULL, NULL, '0'][1 + event_id % 7] AS seconds FROM events")
def _(t):
    raw = F.expr("element_at(array(' 5.0 ', '90.500', '1:30', '01:02:03.250', '1:75', 'x', '0'), int(1 + event_id % 7))")
    return t.events.select("event_id", playback.clone_time(raw).alias("seconds"))


@query("a20_first_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE year(o_orderdate)::VARCHAR END AS year FROM orders")
def _(t):
    dates = F.array(F.lit("n.d."), F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "MM/yyyy")).otherwise("12"), F.lit(""))
    return t.orders.select("o_orderkey", playback.first_year(dates).alias("year"))


@query("a21_covers", "SELECT source, arg_max(doc_id, n_chars * 10000000 - doc_id) AS cover FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"))).alias("m")).select("source", (-F.col("m.d")).alias("cover"))


@query("a23_book_details", "SELECT conv_id, md5(string_agg(turn || role || (1 + turn % 3), ',' ORDER BY turn, role)) AS details, sum(1 + turn % 3)::BIGINT AS chunk_count, count(*) AS chapters FROM conversations GROUP BY conv_id")
def _(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.array_repeat(F.lit(1), (1 + F.col("turn") % 3).cast("int")).alias("spans"))
    out = playback.book_details(rows, "conv_id", "turn", ["role"], "spans")
    said = F.array_join(F.transform("chapters", lambda c: F.concat(c["turn"], c["role"], c["chunk_count"])), ",")
    return out.select("conv_id", F.md5(said.cast("binary")).alias("details"), "chunk_count", F.size("chapters").cast("long").alias("chapters"))


@query("k7_a24_concat_lists", "SELECT conv_id, string_agg('file ''segments/' || turn || '/' || role || '.wav''' || chr(10), '' ORDER BY turn) AS list, sum(length(text))::BIGINT AS duration FROM conversations GROUP BY conv_id")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("d"), F.concat(F.lit("segments/"), "turn", F.lit("/"), "role", F.lit(".wav")).alias("path"))
    return playback.concat_list(rows, "conv_id", ["turn"], "path", "d").select("conv_id", "list", "duration")


@query("v3_single_quotes", "SELECT event_id, ['rock n roll', '''tis it''s', 'no quotes', 'dogs tail'][1 + event_id % 4] AS said FROM events")
def _(t):
    raw = F.expr("element_at(array(\"rock 'n' roll\", \"'tis it's\", \"'no' ‘quotes’\", \"dogs' tail\"), int(1 + event_id % 4))")
    return t.events.select("event_id", speech.spoken(raw, speech.drop_single_quotes).alias("said"))


@query("j11_j14_j15_matched_entries", "SELECT c.conv_id, c.turn, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality END AS meta FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id * 8 + c.turn WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id * 8 + c.turn)")
def _(t):
    rows = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 8 + F.col("turn")).alias("doc_id"))
    return rows.join(t.documents.select("doc_id"), "doc_id", "left_semi").join(t.labels.select("doc_id", F.col("quality").alias("meta")), "doc_id", "left").select("conv_id", "turn", "meta")

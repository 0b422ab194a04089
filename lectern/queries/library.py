"""Lookups, keyed merges, sources and snapshots of a library of books."""

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import assembly, library, snippets
from lectern.queries.registry import query
from lectern.sources import jsonl, overrides


@query("j1_toc_positions", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size AS pos FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def _(t):
    spine = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("pos"))
    return t.lineitem.join(spine, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos")


@query(
    "j2_item_by_href_or_id",
    """SELECT c_custkey, coalesce(a.n_name, b.n_name, 'none') AS n_name FROM customer LEFT JOIN nation a ON a.n_name = CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN 'BRAZIL' END LEFT JOIN nation b ON b.n_nationkey = CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE -1 END""",
)
def _(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lit("BRAZIL")).alias("href"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(-1).alias("id"))
    dim = t.nation.select("n_nationkey", "n_name", F.col("n_name").alias("name_key"))
    return library.lookup_first(rows, dim, [("href", "name_key"), ("id", "n_nationkey")], "n_name", F.lit("none")).select("c_custkey", "n_name")


TOC = "SELECT conv_id, turn AS pos FROM conversations WHERE turn % 3 = 0"


@query(
    "j3_spine_ranges",
    f"""WITH toc AS (SELECT conv_id, pos, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM ({TOC}))
    SELECT c.conv_id, c.turn, toc.pos FROM conversations c JOIN toc ON toc.conv_id = c.conv_id AND c.turn >= toc.pos AND (toc.next IS NULL OR c.turn < toc.next)""",
)
def _(t):
    toc = t.conversations.where("turn % 3 = 0").select("conv_id", F.col("turn").alias("pos"))
    return assembly.spine_ranges(t.conversations.select("conv_id", "turn"), toc, "conv_id", "turn", "pos").select("conv_id", "turn", "pos")


@query("j6_a1_orphans", "WITH b AS (SELECT lang AS book, string_agg(text, chr(10) ORDER BY doc_id) AS whole FROM documents GROUP BY lang) SELECT item_id, book, length(text)::BIGINT AS chars FROM (SELECT item_id, text, ['en', 'de', 'fr', 'es'][1 + item_id % 4] AS book FROM benchmark) i LEFT JOIN b USING (book) WHERE b.whole IS NULL OR NOT contains(whole, substr(text, 1, 200))")
def _(t):
    texts = t.documents.select(F.col("lang").alias("book"), "doc_id", F.col("text").alias("whole"))
    items = t.benchmark.select("item_id", F.expr("element_at(array('en', 'de', 'fr', 'es'), int(1 + item_id % 4))").alias("book"), F.length("text").cast("long").alias("chars"), F.substring("text", 1, 200).alias("snippet"))
    return snippets.absent_texts(items, texts, "book", ["doc_id"], "snippet", "whole").select("item_id", "book", "chars")


@query("j7_chapter_voices", "SELECT conv_id, turn, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN s_name END, 'default') AS voice FROM conversations LEFT JOIN supplier ON s_suppkey = turn AND conv_id % 2 = 0")
def _(t):
    voices = t.supplier.select(F.col("s_suppkey").alias("turn"), F.col("s_name").alias("own"))
    rows = t.conversations.select("conv_id", "turn").join(voices, "turn", "left")
    return rows.select("conv_id", "turn", F.coalesce(F.when(F.col("conv_id") % 2 == 0, F.col("own")), F.lit("default")).alias("voice"))


@query("j8_voice_prompts", "SELECT DISTINCT n_name AS voice, 'voices/' || n_regionkey || '.wav' AS prompt FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    used = t.customer.select("c_nationkey").distinct()
    found = used.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    known = F.when(F.col("n_name").isNull(), F.raise_error(F.lit("unknown voice"))).otherwise(F.col("n_name"))
    return found.select(known.alias("voice"), F.concat(F.lit("voices/"), "n_regionkey", F.lit(".wav")).alias("prompt"))


@query("j9_chapter_overrides", "SELECT o_orderkey, list_sort(list(p_partkey)) AS overrides FROM orders JOIN (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey END AS chapter FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 3 = 0) ON chapter IS NULL OR chapter = o_orderkey GROUP BY o_orderkey")
def _(t):
    rules = t.part.where("p_partkey % 50 = 0 OR p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey")).alias("chapter"))
    return overrides.by_chapter(t.orders.select("o_orderkey"), rules, "o_orderkey", "chapter", "p_partkey", "overrides")


@query("j10_manifest_zip", "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN a.turn IS NULL THEN 'extra' WHEN b.turn IS NULL THEN 'missing' WHEN a.role = b.role THEN 'same' ELSE 'other' END AS state FROM (SELECT conv_id, turn, role FROM conversations WHERE turn < 5) a FULL JOIN (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'x' ELSE role END AS role FROM conversations WHERE turn > 1) b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def _(t):
    now = t.conversations.where("turn < 5").select("conv_id", "turn", "role")
    old = t.conversations.where("turn > 1").select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, F.lit("x")).otherwise(F.col("role")).alias("role"))
    return assembly.zipped(now, old, ["conv_id", "turn"], "role")


@query("j12_report_match", "SELECT page_id, label FROM (SELECT p.page_id, r.label, row_number() OVER (PARTITION BY p.page_id ORDER BY r.ord) AS n FROM pages p JOIN (VALUES (1, 'com/', 'a'), (2, 'html', 'b'), (3, '7', 'c'), (4, '', 'd')) r(ord, tail, label) ON ends_with(p.url, r.tail)) WHERE n = 1")
def _(t):
    return assembly.first_suffix(t.pages.select("page_id", "url"), [("com/", "a"), ("html", "b"), ("7", "c"), ("", "d")], "url", "label").select("page_id", "label")


@query("j13_existing_segments", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def _(t):
    there = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(there, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("w10_keep_first", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def _(t):
    return library.keep_first(t.documents.select("source", "lang", "doc_id", (-F.col("n_chars")).alias("o")), ["source", "lang"], ["o", "doc_id"]).select("source", "doc_id")


@query(
    "u1_merged_overrides",
    "WITH a AS (SELECT 0 AS side, p_partkey AS ord, lower(p_brand) AS k, p_name AS reading FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, p_partkey, lower(p_brand), p_type FROM part WHERE p_partkey % 5 = 0), b AS (SELECT k, arg_max(reading, side * 100000000 + ord) AS reading, min(side * 100000000 + ord) AS place FROM a GROUP BY k) SELECT k, reading, (place // 100000000)::INT AS side, place % 100000000 AS ord FROM b",
)
def _(t):
    rows = lambda where, reading: t.part.where(where).select(F.col("p_partkey").alias("ord"), F.lower("p_brand").alias("k"), F.col(reading).alias("reading"))
    merged = library.merge_last_wins(rows("p_partkey % 2 = 0", "p_name"), rows("p_partkey % 5 = 0", "p_type"), ["k"], "ord")
    return merged.select("k", "reading", F.col("position._side").alias("side"), F.col("position.ord").alias("ord"))


@query("o1_library_sort", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN k = '' THEN 'x' ELSE k END, p_partkey)::INT AS place FROM (SELECT p_partkey, regexp_replace(lower(trim(CASE WHEN p_partkey % 10 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN 'The ' || p_name WHEN p_partkey % 3 = 1 THEN 'An ' || p_name ELSE p_name END)), '^(the|an|a) ', '') AS k FROM part)")
def _(t):
    title = F.when(F.col("p_partkey") % 10 == 0, F.lit(" ")).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("An "), "p_name")).otherwise(F.col("p_name"))
    rows = t.part.select("p_partkey", text.sort_title(title, F.lit("X")).alias("key"))
    return library.placed(rows, ["key", "p_partkey"]).select("p_partkey", F.col("place").cast("int").alias("place"))


@query("o2_override_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN p_size % 2 = 0 THEN -length(p_name) ELSE 0 END, p_partkey)::INT AS place FROM part")
def _(t):
    return overrides.ordered(t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("base")), "p_brand", "base", "p_partkey", "place").select("p_partkey", "place")


@query("x2_dropped_chapters", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS index FROM conversations WHERE role <> 'system'")
def _(t):
    rows = t.conversations.select("conv_id", "turn")
    return library.drop_rows(rows, t.conversations.where("role = 'system'"), ["conv_id", "turn"], "conv_id", ["turn"])


@query("w11_x3_restored_chapters", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS index FROM conversations WHERE turn <> 3 OR conv_id % 2 = 0")
def _(t):
    rows = t.conversations.select("conv_id", "turn")
    return library.insert_rows(rows.where("turn <> 3"), rows.where("turn = 3 AND conv_id % 2 = 0"), "conv_id", "turn").select("conv_id", "turn", "index")


@query(
    "x10_voice_upsert",
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k % 2 = 0 THEN b.gender ELSE a.gender END AS gender FROM (SELECT s_suppkey AS k, s_name AS gender FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'new' END AS gender FROM supplier WHERE s_suppkey % 5 <> 1) b ON a.k = b.k",
)
def _(t):
    now = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("gender"))
    edits = t.supplier.where("s_suppkey % 5 <> 1").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 != 0, F.lit("new")).alias("gender"), (F.col("s_suppkey") % 2 == 0).alias("gender_set"))
    return library.upsert(now, edits, ["k"], ["gender"])


@query("s8_jsonl_lines", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 10 END AS k FROM events WHERE event_id % 3 <> 1 AND event_id % 7 <> 0")
def _(t):
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).when(F.col("event_id") % 3 == 1, F.lit("  ")).when(F.col("event_id") % 3 == 0, F.format_string('{"id": %d, "k": %d}', "event_id", F.col("event_id") % 10)).otherwise(F.format_string('{"id": %d, "other": []}', "event_id"))
    return jsonl.parsed(t.events.select(line.alias("value")), "id long, k long").select(F.col("id").alias("event_id"), "k")


@query("s11_override_lines", "SELECT p_partkey, 'b' || p_partkey AS base, 'r = ' || p_size AS reading FROM part WHERE p_partkey % 4 < 2")
def _(t):
    line = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(' b', p_partkey, ' = r = ', p_size, ' ') WHEN 1 THEN concat('b', p_partkey, '＝r = ', p_size) WHEN 2 THEN '# note = x' ELSE 'nothing' END")
    return overrides.parsed_lines(t.part.select("p_partkey", line.alias("line")), "line").select("p_partkey", "base", "reading")


@query("s13_spine_items", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' AND turn < 6")
def _(t):
    items = t.conversations.select("conv_id", "turn", "role")
    spine = t.conversations.where("turn < 6").select("conv_id", "turn")
    return spine.join(items.where("role <> 'system'"), ["conv_id", "turn"])


@query("s14_toc_flatten", "WITH RECURSIVE f AS (SELECT p_partkey AS id, p_partkey AS root, 0 AS depth FROM part WHERE p_partkey <= 20 UNION ALL SELECT p_partkey, root, depth + 1 FROM f JOIN part ON p_partkey // 3 = f.id AND p_partkey > 20) SELECT id, root, depth FROM f")
def _(t):
    edges = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 20, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return assembly.flattened(edges, "id", "parent")


@query("s17_metadata_fallback", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN l.quality END, CASE WHEN doc_id % 3 = 0 THEN l.toxic END, -1)::INT AS meta FROM documents LEFT JOIN labels l USING (doc_id)")
def _(t):
    clean = t.labels.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("a"))
    raw = t.labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("b"))
    return t.documents.select("doc_id").join(clean, "doc_id", "left").join(raw, "doc_id", "left").select("doc_id", F.coalesce("a", "b", F.lit(-1)).cast("int").alias("meta"))


@query("m10_m11_resolved_counts", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id % 4 WHEN event_id % 5 > 0 THEN event_id % 5 ELSE 7 END::INT AS n FROM events")
def _(t):
    size = lambda k: F.nullif(F.size(F.array_repeat(F.lit(1), (F.col("event_id") % k).cast("int"))), F.lit(0))
    return t.events.select("event_id", F.coalesce(size(4), size(5), F.lit(7)).alias("n"))


@query("m12_k9_tags", "SELECT doc_id, list_sort(list_filter(['title=' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, 'artist=' || source, 'album=' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END], lambda x: NOT ends_with(x, '='))) AS tags FROM documents")
def _(t):
    title = F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("")
    tags = assembly.tag_map({"title": title, "album": title, "artist": F.col("source")})
    return t.documents.select("doc_id", F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("tags"))


@query("k10_tag_escapes", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text || '\\=;#', '\\', '\\\\'), chr(10), '\\' || chr(10)), '=', '\\='), ';', '\\;'), '#', '\\#')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.tag_value(F.concat("text", F.lit("\\=;#"))).cast("binary")).alias("digest"))


@query("k1_chapter_files", "SELECT conv_id, lpad(turn::VARCHAR, 4, '0') || '-' || role || '.txt' AS name FROM conversations")
def _(t):
    return t.conversations.select("conv_id", F.format_string("%04d-%s.txt", "turn", text.slug(F.col("role"))).alias("name"))


@query("k12_cover_suffix", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' ELSE '.jpg' END AS ext FROM pages")
def _(t):
    media = F.expr("CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE '' END")
    return t.pages.select("page_id", assembly.cover_suffix(media, F.when(F.col("page_id") % 4 == 2, F.lit("a/b.GIF")).otherwise("cover")).alias("ext"))


@query("st_boundary_stream", "SELECT event_type, count(*) AS n, round(avg(value * 12 - 900), 6) AS mean_delta_ms FROM events WHERE event_type IN ('click', 'view') AND value * 12 - 900 BETWEEN -5000 AND 5000 GROUP BY event_type")
def _(t):
    from lectern.streaming import boundary

    return boundary.drained(t.spark, t.sf_dir)

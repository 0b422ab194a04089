"""Chunks, durations, progress and playback: lineitem plays chunks, orders chapters, events the boundary log."""

from pyspark.sql import functions as F

from lectern.operators import latency, tracking
from lectern.queries.registry import query
from lectern.session import by_key

#: Chunks of chapters of books: books are customers' orders modulo 97, a chapter an order, a chunk a line.
CHUNKS = """SELECT o_custkey % 97 AS book, l_orderkey AS chapter, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_shipdate AS shipped, l_extendedprice AS price,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_quantity * 100 AS BIGINT) END AS duration_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ORDER = ["chapter", "line", "part", "supp", "shipped", "price"]
ORDER_SQL = ", ".join(ORDER)


def chunks(t):
    lines, orders = by_key((t.lineitem, "l_orderkey"), (t.orders.select("o_orderkey", "o_custkey"), "o_orderkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        (F.col("o_custkey") % 97).alias("book"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("shipped"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_partkey") % 11 != 0, (F.col("l_quantity") * 100).cast("long")).alias("duration_ms"),
    )


CHAPTERS = f"SELECT book, chapter, sum(coalesce(duration_ms, 0))::BIGINT AS duration_ms, count(*) AS n_chunks, count(duration_ms) AS n_done FROM ({CHUNKS}) GROUP BY ALL"


def chapters(t):
    return chunks(t).groupBy("book", "chapter").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), F.count("*").alias("n_chunks"), F.count("duration_ms").alias("n_done"))


@query("a11_chapter_durations", CHAPTERS)
def _(t):
    return chapters(t)


@query("w4_running_offsets", f"SELECT book, chapter, (sum(greatest(duration_ms, 1)) OVER w - greatest(duration_ms, 1))::BIGINT AS start_ms, (sum(greatest(duration_ms, 1)) OVER w)::BIGINT AS end_ms FROM ({CHAPTERS}) WINDOW w AS (PARTITION BY book ORDER BY chapter)")
def _(t):
    return tracking.running_offsets(chapters(t), "book", ["chapter"], "duration_ms").select("book", "chapter", "start_ms", "end_ms")


@query(
    "k8_chapter_markers",
    f"""SELECT book, chapter, '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - w)::BIGINT || chr(10) || 'END=' || e::BIGINT || chr(10) || 'title=A\\=B\\;' || chapter || chr(10) AS marker
    FROM (SELECT book, chapter, greatest(duration_ms, 1) AS w, sum(greatest(duration_ms, 1)) OVER (PARTITION BY book ORDER BY chapter) AS e FROM ({CHAPTERS}))""",
)
def _(t):
    from lectern.functions.text import tag_value

    return tracking.chapter_markers(chapters(t), "book", ["chapter"], "duration_ms", tag_value(F.concat(F.lit("A=B;"), "chapter"))).select("book", "chapter", "marker")


@query("w5_until_first_gap", f"SELECT book, chapter, line, duration_ms FROM (SELECT *, min(CASE WHEN part % 40 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS m FROM ({CHUNKS})) WHERE m = 1")
def _(t):
    return tracking.until_first_gap(chunks(t), "book", ORDER, F.col("part") % 40 != 0).select("book", "chapter", "line", "duration_ms")


@query(
    "w6_split_runs",
    """SELECT conv_id, turn, role, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM
    (SELECT *, CASE WHEN turn % 3 = 0 OR lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL ELSE lang END AS role FROM (SELECT conv_id, turn, role AS lang FROM conversations)) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""".replace("turn % 3 = 0 OR ", ""),
)
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 4 != 0, F.col("role")).alias("role"))
    return tracking.runs(rows, ["conv_id"], ["turn"], F.col("role")).select("conv_id", "turn", "role", F.col("run").cast("long").alias("run"))


@query(
    "w7_balanced_parts",
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT book, duration_ms AS d, chapter, row_number() OVER (PARTITION BY book ORDER BY chapter) AS k, count(*) OVER (PARTITION BY book) AS n, sum(duration_ms) OVER (PARTITION BY book) AS total FROM ({CHAPTERS})),
    f AS (SELECT book, chapter, k, n, 1 AS part, d::DOUBLE AS own, total::DOUBLE AS rest FROM c WHERE k = 1 UNION ALL
    SELECT s.book, s.chapter, s.k, s.n, CASE WHEN s.x THEN s.part + 1 ELSE s.part END, CASE WHEN s.x THEN s.d ELSE s.own + s.d END, CASE WHEN s.x THEN s.rest - s.own ELSE s.rest END FROM
    (SELECT f.book, c.chapter, c.k, c.n, f.part, f.own, f.rest, c.d, f.part < 5 AND (c.n - f.k = 6 - f.part OR (f.own + c.d > f.rest / (6 - f.part) AND c.n - f.k >= 6 - f.part)) AS x FROM f JOIN c ON c.book = f.book AND c.k = f.k + 1) s)
    SELECT book, chapter, part::INT AS part FROM f""",
)
def _(t):
    return tracking.balanced_parts(chapters(t), "book", "chapter", "duration_ms", 5)


@query("w2_boundary_pauses", f"SELECT chapter, line, CASE WHEN row_number() OVER (PARTITION BY book, chapter ORDER BY line DESC) = 1 AND chapter <> max(chapter) OVER (PARTITION BY book) THEN greatest(pause, 5) ELSE pause END::INT AS pause FROM (SELECT o_custkey % 97 AS book, l_orderkey AS chapter, l_linenumber AS line, min([1, 3, 5, 7][1 + l_partkey % 4]) AS pause FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)")
def _(t):
    rows = chunks(t).groupBy("book", "chapter", "line").agg(F.min(F.expr("element_at(array(1, 3, 5, 7), int(1 + part % 4))")).alias("pause"))
    return tracking.boundary_pauses(rows, "book", "chapter", "line", "pause").select("chapter", "line", "pause")


@query(
    "w3_valid_pauses",
    "SELECT event_id, list_transform(range(1, 1 + event_id % 4), lambda i: CASE WHEN event_id % 3 <> 1 AND coalesce([2, 0, -1, 4][i], 0) > 0 THEN [2, 0, -1, 4][i] WHEN i <= 2 THEN [3, 0][i] + CASE WHEN [3, 0][i] = 0 THEN 1 ELSE 0 END ELSE 1 END)::INT[] AS pauses FROM events",
)
def _(t):
    n = (F.col("event_id") % 4).cast("int")
    given = F.slice(F.array(F.lit(2), F.lit(0), F.lit(-1), F.lit(4)), F.lit(1), n + F.when(F.col("event_id") % 3 == 1, 1).otherwise(0) * F.when(n == 0, 0).otherwise(1))
    given = F.when(F.col("event_id") % 3 != 1, given).otherwise(F.concat(given, given, F.array(F.lit(9))))
    return t.events.select("event_id", tracking.valid_pauses(given, n, F.array(F.lit(3), F.lit(0))).alias("pauses"))


@query("w8_merged_ranges", "WITH a AS (SELECT l_orderkey AS k, l_partkey % 60 AS s, l_partkey % 60 + (l_quantity % 13)::BIGINT AS e FROM lineitem), b AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS c FROM a WHERE e > s), d AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM b) SELECT k, min(s) AS s, max(e) AS e FROM d GROUP BY k, i")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 60).alias("s"), (F.col("l_partkey") % 60 + (F.col("l_quantity") % 13).cast("long")).alias("e"))
    return tracking.merge_intervals(rows, ["k"], "s", "e")


@query("w12_list_numbers", "WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN turn * 10 END AS v, CASE WHEN conv_id % 2 = 0 THEN 5 END AS st FROM conversations), b AS (SELECT *, count(v) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM a) SELECT conv_id, turn, (coalesce(max(v) OVER (PARTITION BY conv_id, i), st, 1) + row_number() OVER (PARTITION BY conv_id, i ORDER BY turn) - 1)::BIGINT AS number FROM b")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.col("turn") * 10).alias("v"), F.when(F.col("conv_id") % 2 == 0, F.lit(5)).alias("st"))
    return tracking.list_numbers(rows, ["conv_id"], ["turn"], "v", "st").select("conv_id", "turn", F.col("number").cast("long").alias("number"))


@query("w13_a18_joined_text", "SELECT conv_id, md5(string_agg(text || CASE WHEN turn = last THEN '' ELSE repeat(chr(10), (2 + turn % 4)::INT) END, '' ORDER BY turn)) AS digest, sum(length(text) + CASE WHEN turn = last THEN 0 ELSE 2 + turn % 4 END)::BIGINT AS chars FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id")
def _(t):
    out = tracking.joined_text(t.conversations, "conv_id", ["turn"], "text", F.expr("repeat('\n', int(2 + turn % 4))"))
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


@query(
    "a8_progress",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY {ORDER_SQL}) - 1 AS g FROM ({CHUNKS})),
    a AS (SELECT book, count(*) AS total, count(duration_ms) AS done, min(g) FILTER (duration_ms IS NULL) AS g FROM r GROUP BY book)
    SELECT a.book, total, done, round(done / total * 100, 2) AS percent, a.g::INT AS global_index, r.chapter, r.line FROM a LEFT JOIN r ON r.book = a.book AND r.g = a.g""",
)
def _(t):
    return tracking.progress(chunks(t), "book", ORDER, F.col("duration_ms").isNotNull(), "chapter", "line")


@query("a9_chapter_progress", f"SELECT chapter, count(*) AS total, count(duration_ms) AS done, round(count(duration_ms) / count(*) * 100, 2) AS percent FROM ({CHUNKS}) GROUP BY chapter")
def _(t):
    return tracking.progress(chunks(t), "chapter", ORDER[1:], F.col("duration_ms").isNotNull()).select("chapter", "total", "done", "percent")


@query("a10_audio_progress", f"SELECT book, n_chunks::BIGINT AS total, CASE WHEN book % 5 = 0 THEN n_chunks ELSE least(n_done + 3, n_chunks) END::BIGINT AS done FROM (SELECT book, sum(n_chunks) AS n_chunks, sum(n_done) AS n_done FROM ({CHAPTERS}) GROUP BY book)")
def _(t):
    books = chapters(t).groupBy("book").agg(F.sum("n_chunks").alias("total"), F.sum("n_done").alias("files"))
    return books.select("book", "total", F.when(F.col("book") % 5 == 0, F.col("total")).otherwise(F.least(F.col("files") + 3, "total")).alias("done"))


@query(
    "a22_book_summary",
    f"SELECT book, count(*) AS n_chapters, sum(n_chunks)::BIGINT AS n_chunks, sum(n_done)::BIGINT AS n_done, sum(duration_ms)::BIGINT AS duration_ms, sum(n_chunks) = sum(n_done) AS complete, sum(n_chunks) > 0 AND sum(n_done) > 0 AS merge_ready, greatest(1, ceil(sum(duration_ms) / 288000.0))::BIGINT AS parts FROM ({CHAPTERS}) GROUP BY book",
)
def _(t):
    out = chapters(t).groupBy("book").agg(F.count("*").alias("n_chapters"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_done").alias("n_done"), F.sum("duration_ms").alias("duration_ms"))
    return out.select("*", (F.col("n_chunks") == F.col("n_done")).alias("complete"), ((F.col("n_chunks") > 0) & (F.col("n_done") > 0)).alias("merge_ready"), F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 288_000)).cast("long").alias("parts"))


LOG = """SELECT event_id, event_type, user_id, CASE WHEN event_type IN ('click', 'view') THEN 'gapless' ELSE 'auto' END AS trigger, user_id % 5 <> 0 AS preloaded, 0.9 + (event_id % 5) * 0.05 AS playback_rate, value * 12 - 900 AS delta_ms, (event_id % 4 * 100) AS pad_ms, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 10 END AS output_latency_ms FROM events"""
GAPLESS = f"SELECT *, CASE WHEN output_latency_ms BETWEEN 0 AND 5000 THEN delta_ms + output_latency_ms END AS corrected FROM ({LOG}) WHERE trigger = 'gapless' AND preloaded AND playback_rate BETWEEN 0.95 AND 1.05 AND delta_ms BETWEEN -5000 AND 5000"


def log(t):
    return t.events.select(
        "event_id", "event_type", "user_id", F.when(F.col("event_type").isin("click", "view"), F.lit("gapless")).otherwise("auto").alias("trigger"), (F.col("user_id") % 5 != 0).alias("preloaded"),
        F.expr("0.9D + (event_id % 5) * 0.05D").alias("playback_rate"), F.expr("value * 12 - 900").alias("delta_ms"), F.expr("event_id % 4 * 100").alias("pad_ms"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 10).alias("output_latency_ms"),
    )


LOG_D = LOG.replace("0.9 + (event_id % 5) * 0.05", "0.9::DOUBLE + (event_id % 5) * 0.05::DOUBLE")
GAPLESS = GAPLESS.replace(LOG, LOG_D)


@query("f16_gapless_events", f"SELECT event_id, delta_ms, output_latency_ms FROM ({GAPLESS})")
def _(t):
    return latency.gapless(log(t)).select("event_id", "delta_ms", "output_latency_ms")


PICKS = ", ".join(f"round(coalesce(nullif(l[1 + floor((len(l) - 1) * {q}::DOUBLE)::INT], 0), l[{1 if q <= 0.5 else -1}]), 3) AS p{round(q * 100)}" for q in latency.QUANTILES)


@query("a12_a13_delta_stats", f"SELECT event_type, len(l)::BIGINT AS n, round(l[1], 3) AS min, {PICKS}, round(l[-1], 3) AS max, round(list_avg(l), 3) AS mean FROM (SELECT event_type, list(delta_ms ORDER BY delta_ms) AS l FROM ({GAPLESS}) GROUP BY event_type)")
def _(t):
    return latency.stats(latency.gapless(log(t)), ["event_type"], "delta_ms")


@query(
    "a14_a16_boundary_report",
    f"""SELECT k, (len(l) + nulls)::BIGINT AS samples, len(l)::BIGINT AS with_latency, round(len(l) / (len(l) + nulls), 4) AS coverage, pads,
    CASE WHEN len(l) + nulls >= 200 AND len(l) / (len(l) + nulls) >= 0.8 THEN round_even(round(coalesce(nullif(l[1 + floor((len(l) - 1) * 0.5)::INT], 0), l[1]), 3), 0)::BIGINT END AS pad_change_ms
    FROM (SELECT user_id % 3 AS k, list(corrected ORDER BY corrected) FILTER (corrected IS NOT NULL) AS l, count_if(corrected IS NULL) AS nulls, list_sort(list(DISTINCT pad_ms)) AS pads FROM ({GAPLESS}) GROUP BY k)""",
)
def _(t):
    return latency.report(log(t).withColumn("k", F.col("user_id") % 3), ["k"])


@query("f17_checked_events", f"SELECT event_id, from_index, to_index, round(delta_ms, 3) AS delta_ms, round(least(greatest(playback_rate, 0.25), 4.0), 3) AS playback_rate, greatest(pad_ms, 0) AS pad_ms, CASE WHEN output_latency_ms BETWEEN 0 AND 5000 THEN round(output_latency_ms, 3) END AS output_latency_ms, trigger, preloaded FROM (SELECT *, event_id % 50 - 3 AS from_index, event_id % 50 - 2 AS to_index FROM ({LOG_D}) ORDER BY event_id LIMIT 500) WHERE from_index >= 0 AND to_index >= 0 AND delta_ms BETWEEN -5000 AND 5000")
def _(t):
    rows = log(t).withColumns({"from_index": F.col("event_id") % 50 - 3, "to_index": F.col("event_id") % 50 - 2})
    return latency.checked(rows).select("event_id", "from_index", "to_index", "delta_ms", "playback_rate", "pad_ms", "output_latency_ms", "trigger", "preloaded")


@query("m6_safe_numbers", "SELECT event_id, CASE WHEN isfinite(TRY_CAST(s AS DOUBLE)) THEN TRY_CAST(s AS DOUBLE) END AS x FROM (SELECT event_id, ['1.5', 'nan', 'inf', 'x', '', '-7', '1e3'][1 + event_id % 7] AS s FROM events)")
def _(t):
    s = F.expr("element_at(array('1.5', 'nan', 'inf', 'x', '', '-7', '1e3'), int(1 + event_id % 7))")
    return t.events.select("event_id", latency.finite(s).alias("x"))


@query("m7_m8_frames", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_partkey * 1000 / 24000, 0)::BIGINT AS ms, (round_even(24000 * (l_suppkey % 7 * 100) / 1000, 0) * (l_linenumber % 3 + 1))::BIGINT AS pad FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(F.col("l_partkey") * 1000 / 24000, 0).cast("long").alias("ms"), (F.bround(24000 * (F.col("l_suppkey") % 7 * 100) / 1000, 0) * (F.col("l_linenumber") % 3 + 1)).cast("long").alias("pad"))


@query("m1_timecodes", "SELECT event_id, s, CASE WHEN regexp_full_match(s, '[0-9]+:[0-9]+:[0-9]+(\\.[0-9]+)?') THEN round_even((split_part(s, ':', 1)::INT * 3600 + split_part(s, ':', 2)::INT * 60 + split_part(s, ':', 3)::DOUBLE) * 1000, 0)::BIGINT ELSE 0 END AS ms FROM (SELECT event_id, ['01:02:03.5', '1:2', 'x:1:2', '00:00:00', '10:59:59.999', ''][1 + event_id % 6] AS s FROM events)")
def _(t):
    s = F.expr("element_at(array('01:02:03.5', '1:2', 'x:1:2', '00:00:00', '10:59:59.999', ''), int(1 + event_id % 6))")
    part = lambda k: F.try_element_at(F.split("s", ":", -1), F.lit(k)).try_cast("double")
    ms = F.when(F.size(F.split("s", ":", -1)) == 3, F.bround((part(1) * 3600 + part(2) * 60 + part(3)) * 1000, 0).cast("long"))
    return t.events.select("event_id", s.alias("s")).withColumn("ms", F.coalesce(ms, F.lit(0)))


@query("m4_m5_split_counts", "SELECT c_custkey, CASE WHEN ms <= 0 OR ms <= 28800000 THEN 1 ELSE ceil(ms / 28800000) END::BIGINT AS parts, round(least(100, greatest(0, ms / 600000)), 2) AS percent FROM (SELECT c_custkey, round(c_acctbal * 10000) AS ms FROM customer)")
def _(t):
    rows = t.customer.select("c_custkey", F.round(F.col("c_acctbal") * 10000).alias("ms"))
    return rows.select("c_custkey", F.when(F.col("ms") <= 28_800_000, F.lit(1)).otherwise(F.ceil(F.col("ms") / 28_800_000)).cast("long").alias("parts"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("ms") / 600_000)), 2).alias("percent"))


@query("k11_part_names", "SELECT o_orderkey, 'book.part' || lpad((1 + o_orderkey % n)::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') || '.m4b' AS name FROM (SELECT o_orderkey, 1 + o_custkey % 120 AS n FROM orders)")
def _(t):
    n = 1 + F.col("o_custkey") % 120
    return t.orders.select("o_orderkey", F.concat(F.lit("book.part"), F.lpad((1 + F.col("o_orderkey") % n).cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")), F.lit(".m4b")).alias("name"))


@query("x6_cleared_cache", f"SELECT chapter, line, part, supp, CASE WHEN book % 2 = 0 THEN NULL ELSE duration_ms END AS duration_ms FROM ({CHUNKS})")
def _(t):
    return chunks(t).select("chapter", "line", "part", "supp", F.when(F.col("book") % 2 != 0, F.col("duration_ms")).alias("duration_ms"))


@query("x7_pending_chunks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def _(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(done, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("a25_file_counts", "SELECT l_orderkey, count_if(l_quantity > 10)::BIGINT AS files, count(*) AS total FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 10).alias("files"), F.count("*").alias("total"))

"""Extraction and cleaning of text."""

from pyspark.sql import functions as F

from lectern.functions import html, text
from lectern.operators import cleaning as rules
from lectern.queries.registry import query

WS = r"'^\s+|\s+$', '', 'g'"


def digest(column):
    return F.md5(column.cast("binary")).alias("digest")


def sql_quotes(x, double=True):
    marks = "chr(700)||chr(8216)||chr(8217)" + ("||chr(8220)||chr(8221)||chr(8222)||chr(8223)||chr(171)||chr(187)" if double else "")
    return f"translate({x}, {marks}, {'repeat(chr(39),3)' + ('||repeat(chr(34),6)' if double else '')})"


def sql_lines(x):
    return f"regexp_replace(replace(replace({x}, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+\\n', chr(10), 'g')"


def sql_clamp(x):
    return f"replace(replace(regexp_replace(regexp_replace({x}, '\\n{{5,}}', chr(1), 'g'), '\\n{{3,4}}', chr(2), 'g'), chr(1), repeat(chr(10),5)), chr(2), repeat(chr(10),3))"


@query(
    "s4_clean_file_text",
    f"""SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM (
    SELECT doc_id, regexp_replace(regexp_replace({sql_lines(sql_quotes("'  ' || text || ' it' || chr(8217) || 's  odd ' || chr(13) || chr(10) || chr(9)", False))}, '[ \\t]{{2,}}', ' ', 'g'), {WS}) || chr(10) AS t
    FROM documents)""",
)
def _(t):
    raw = F.concat(F.lit("  "), F.col("text"), F.lit(" it’s  odd \r\n\t"))
    return t.all_cores("documents").withColumn("t", text.clean_file_text(raw)).select("doc_id", F.length("t").alias("chars"), digest(F.col("t")))


DIRTY = "chr(8220) || replace(text, '.', '.' || chr(8221)) || chr(8230) || chr(8232) || 'a' || chr(8203) || ' . . .  b' || chr(8239) || chr(173) || repeat(chr(10), (doc_id % 7)::INT) || 'end' || chr(8233)"


@query(
    "t1_extracted_text",
    f"""SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT doc_id,
    regexp_replace(regexp_replace(regexp_replace({sql_clamp(sql_lines("replace(" + sql_quotes(f"regexp_replace(replace(replace(replace({DIRTY}, chr(8232), chr(10)), chr(8233), chr(10)||chr(10)), chr(8239), ' '), '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2069}}\\x{{feff}}]', '', 'g')") + ", chr(8230), '...')"))},
        '[ \\t]{{2,}}', ' ', 'g'), '\\.(?:\\s*\\.){{2,}}', '...', 'g'), {WS}) AS t FROM documents)""",
)
def _(t):
    raw = F.concat(F.lit("“"), F.replace("text", F.lit("."), F.lit(".”")), F.lit("… a​ . . .  b ­"), F.expr("repeat('\n', int(doc_id % 7))"), F.lit("end "))
    return t.all_cores("documents").withColumn("t", text.extracted(raw)).select("doc_id", F.length("t").alias("chars"), digest(F.col("t")))


RAW2 = "'[T]he ' || replace(text, ' de ', ' de-' || chr(10)) || repeat(chr(10), (2 + doc_id % 5)::INT) || '- one' || chr(10) || '  - two. . . ' || chr(10) || chr(10) || 'wrapped ' || chr(10) || ' line' || CASE WHEN doc_id % 2 = 0 THEN repeat(' more words here', 9) ELSE '' END || chr(10) || 'x'"


@query(
    "t2_cleaned_text",
    f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace({sql_clamp(sql_lines(sql_quotes(RAW2)))}, '(^|[\\s“("])\\[([A-Za-z])\\]([a-z])', '\\1\\2\\3', 'g'), '-\\n(\\w)', '-\\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, string_split_regex(t, '\\n{{2,}}') AS blocks, regexp_extract_all(t, '\\n{{2,}}') AS gaps FROM a),
c AS (SELECT doc_id, i, gaps[i] AS gap, string_split(blocks[i], chr(10)) AS lines FROM b, range(1, len(blocks) + 1) r(i)),
d AS (SELECT doc_id, i, gap, lines, list_filter(list_transform(lines, lambda x: regexp_replace(x, {WS})), lambda x: x <> '') AS filled FROM c),
e AS (SELECT doc_id, i, gap, regexp_replace(regexp_replace(CASE WHEN len(lines) > 1 AND (len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[—–•*-]'))) > 0 OR (len(filled) >= 3 AND list_sum(list_transform(filled, lambda x: length(x))) < 60 * len(filled))) THEN array_to_string(filled, chr(10)) ELSE array_to_string(filled, ' ') END, '[ \\t]{{2,}}', ' ', 'g'), {WS}) AS body FROM d),
f AS (SELECT doc_id, string_agg(body || CASE WHEN gap IS NULL THEN '' WHEN length(gap) >= 5 THEN repeat(chr(10), 5) WHEN length(gap) >= 3 THEN repeat(chr(10), 3) ELSE repeat(chr(10), 2) END, '' ORDER BY i) AS t FROM e GROUP BY doc_id),
g AS (SELECT doc_id, regexp_replace({sql_clamp("regexp_replace(t, '\\.[ \\t]*\\.[ \\t]*\\.', '...', 'g')")}, {WS}) AS t FROM f)
SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM g""",
)
def _(t):
    raw = F.concat(F.lit("[T]he "), F.replace("text", F.lit(" de "), F.lit(" de-\n")), F.expr("repeat('\n', int(2 + doc_id % 5))"), F.lit("- one\n  - two. . . \n\nwrapped \n line"), F.when(F.expr("doc_id % 2 = 0"), F.lit(" more words here" * 9)).otherwise(""), F.lit("\nx"))
    return t.all_cores("documents").withColumn("t", text.cleaned(raw)).select("doc_id", F.length("t").alias("chars"), digest(F.col("t")))


@query("t3_break_clamp", f"SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT doc_id, {sql_clamp('replace(text, chr(10), repeat(chr(10), (1 + doc_id % 8)::INT))')} AS t FROM documents)")
def _(t):
    raw = F.replace("text", F.lit("\n"), F.expr("repeat('\n', int(1 + doc_id % 8))"))
    return t.documents.withColumn("t", text.clamp_breaks(raw)).select("doc_id", F.length("t").alias("chars"), digest(F.col("t")))


CUT = "text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'References' || chr(10) || 'Smith' WHEN 1 THEN chr(10) || ' NOTES  ' || chr(10) || 'x' || chr(10) || 'bibliography' ELSE ' notes' END"


@query(
    "t4_section_cutoff",
    f"""WITH a AS (SELECT doc_id, {CUT} AS t FROM documents),
b AS (SELECT doc_id, t, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{p}'" for p in rules.SECTION_CUTOFFS)} ELSE '' END AS reason FROM a)
SELECT doc_id, reason, length(c)::INT AS chars, md5(c) AS digest FROM (
SELECT doc_id, reason, CASE reason {' '.join(f"WHEN '{p}' THEN regexp_replace(string_split_regex(t, '{p}')[1], '\\s+$', '')" for p in rules.SECTION_CUTOFFS)} ELSE t END AS c FROM b)""",
)
def _(t):
    tail = F.expr("CASE doc_id % 4 WHEN 0 THEN '\nReferences\nSmith' WHEN 1 THEN '\n NOTES  \nx\nbibliography' ELSE ' notes' END")
    cut, reason = text.cut_section(F.concat("text", tail), rules.SECTION_CUTOFFS)
    return t.documents.select("doc_id", cut.alias("t"), reason.alias("reason")).select("doc_id", "reason", F.length("t").alias("chars"), digest(F.col("t")))


MARKED = "text || ' seen(Smith, 1999) word[3] (ibid. : 4) and [1, 2-3] (cf. Jones 2001, p. 3) (2005, 12) (x 1990; y 2002b)'"


@query(
    "t5_remove_citations",
    "WITH a0 AS (SELECT doc_id, " + MARKED + " AS t FROM documents)"
    + "".join(f", a{k + 1} AS (SELECT *  EXCLUDE (t), len(regexp_extract_all(t, '{p}'))::INT AS n{k}, regexp_replace(t, '{p}', '', 'g') AS t FROM a{k})" for k, p in enumerate(rules.CITATIONS))
    + f" SELECT doc_id, {', '.join(f'n{k}' for k in range(len(rules.CITATIONS)))}, md5(t) AS digest FROM a{len(rules.CITATIONS)}",
)
def _(t):
    out, counts = text.remove_all(F.concat("text", F.lit(" seen(Smith, 1999) word[3] (ibid. : 4) and [1, 2-3] (cf. Jones 2001, p. 3) (2005, 12) (x 1990; y 2002b)")), rules.CITATIONS)
    return t.documents.select("doc_id", *(c.alias(f"n{k}") for k, c in enumerate(counts)), digest(out))


@query(
    "a4_removal_totals",
    "WITH a0 AS (SELECT source, " + MARKED + " AS t FROM documents)"
    + "".join(f", a{k + 1} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{p}')) AS n{k}, regexp_replace(t, '{p}', '', 'g') AS t FROM a{k})" for k, p in enumerate(rules.CITATIONS))
    + f" SELECT source, rule::INT AS rule, sum(n)::BIGINT AS removed FROM (SELECT source, unnest(range({len(rules.CITATIONS)})) AS rule, unnest([{', '.join(f'n{k}' for k in range(len(rules.CITATIONS)))}]) AS n FROM a{len(rules.CITATIONS)}) GROUP BY ALL HAVING sum(n) > 0",
)
def _(t):
    _, counts = text.remove_all(F.concat("text", F.lit(" seen(Smith, 1999) word[3] (ibid. : 4) and [1, 2-3] (cf. Jones 2001, p. 3) (2005, 12) (x 1990; y 2002b)")), rules.CITATIONS)
    each = t.documents.select("source", F.posexplode(F.array(*counts)).alias("rule", "n"))
    return each.groupBy("source", "rule").agg(F.sum("n").cast("long").alias("removed")).where("removed > 0")


TITLES = "['Table of Contents', 'Chapter 3', 'About the Authors', 'Index', 'The Index of Love', 'NOTES', 'Title Page', 'copyright', 'Endorsement', 'Notes on Time'][1 + doc_id % 10]"


@query(
    "f1_dropped_titles",
    f"SELECT doc_id, {TITLES} AS title, CASE {' '.join(f"WHEN regexp_matches({TITLES}, '{p}') THEN '{p}'" for p in rules.DROPPED_TITLES)} END AS reason FROM documents",
)
def _(t):
    title = F.expr("element_at(array('Table of Contents', 'Chapter 3', 'About the Authors', 'Index', 'The Index of Love', 'NOTES', 'Title Page', 'copyright', 'Endorsement', 'Notes on Time'), int(1 + doc_id % 10))")
    return t.documents.select("doc_id", title.alias("title")).withColumn("reason", text.first_match(F.col("title"), rules.DROPPED_TITLES))


@query(
    "f3_missing_raw",
    """SELECT d.doc_id, l.doc_id IS NULL AS dropped, CASE WHEN l.doc_id IS NULL THEN 'missing_raw' ELSE '' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(t):
    joined = t.documents.select("doc_id").join(t.labels.select(F.col("doc_id").alias("raw")), F.col("doc_id") == F.col("raw"), "left")
    return joined.select("doc_id", F.col("raw").isNull().alias("dropped"), F.when(F.col("raw").isNull(), F.lit("missing_raw")).otherwise("").alias("reason"))


@query("f4_note_markers", "SELECT doc_id, m, regexp_matches(m, '^[0-9]{1,4}[A-Za-z]?[).]?$') AS marker, regexp_matches(lower(m), '^((note|noteref|en|endnote|fnref|fn|footnote)[-:._a-z0-9]*|(en|n)[0-9]+[a-z]?)$') AS note_id FROM (SELECT doc_id, ['12', '7a.', '12345', 'fn3', 'N12', 'noteref-4', 'x', '3)', ''][1 + doc_id % 9] AS m FROM documents)")
def _(t):
    m = F.expr("element_at(array('12', '7a.', '12345', 'fn3', 'N12', 'noteref-4', 'x', '3)', ''), int(1 + doc_id % 9))")
    return t.documents.select("doc_id", m.alias("m")).select("doc_id", "m", rules.is_note_marker(F.col("m")).alias("marker"), rules.is_note_id(F.col("m")).alias("note_id"))


@query(
    "f9_title_headings",
    r"SELECT doc_id, h, h <> '' AND NOT regexp_matches(h, '(?i)^[\W_]*(\d+|[ivxlcdm]+)[\W_]*$') AS titled FROM (SELECT doc_id, ['', 'IV', '- 12 -', 'Mix', 'Livid', 'Chapter IV', '(xii)', 'a 1'][1 + doc_id % 8] AS h FROM documents)",
)
def _(t):
    h = F.expr("element_at(array('', 'IV', '- 12 -', 'Mix', 'Livid', 'Chapter IV', '(xii)', 'a 1'), int(1 + doc_id % 8))")
    return t.documents.select("doc_id", h.alias("h")).withColumn("titled", text.is_title_heading(F.col("h")))


@query(
    "f12_caps_lines",
    "SELECT doc_id, count(*) AS lines, count_if(upper(l) = l AND lower(l) <> l)::BIGINT AS caps FROM (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END, chr(10))) AS l FROM documents) GROUP BY doc_id",
)
def _(t):
    line = F.explode(F.split(F.when(F.expr("doc_id % 3 = 0"), F.upper("text")).otherwise(F.col("text")), "\n", -1)).alias("l")
    return t.documents.select("doc_id", line).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if((F.upper("l") == F.col("l")) & (F.lower("l") != F.col("l"))).alias("caps"))


@query(
    "f13_keeps_lines",
    f"""SELECT doc_id, len(lines) > 1 AND (len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[—–•*-]'))) > 0 OR (len(filled) >= 3 AND list_sum(list_transform(filled, lambda x: length(x))) < 60 * len(filled))) AS keeps
    FROM (SELECT doc_id, lines, list_filter(list_transform(lines, lambda x: regexp_replace(x, {WS})), lambda x: x <> '') AS filled FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
)
def _(t):
    return t.documents.select("doc_id", text.keeps_lines(F.split("text", "\n", -1)).alias("keeps"))


@query(
    "t9_title_case",
    "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(w, '[-''’]|[^-''’]+'), lambda p: upper(p[1]) || lower(p[2:])), '') AS titled FROM (SELECT p_partkey, replace(upper(p_name), ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE chr(39) END) AS w FROM part)",
)
def _(t):
    w = F.replace(F.upper("p_name"), F.lit(" "), F.when(F.expr("p_partkey % 2 = 0"), F.lit("-")).otherwise(F.lit("'")))
    return t.part.select("p_partkey", text.title_case_word(w).alias("titled"))


@query("t13_slugs", "SELECT doc_id, CASE WHEN s = '' THEN 'chapter' ELSE s END AS slug FROM (SELECT doc_id, substr(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS s FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("t14_hrefs", "SELECT page_id, url_decode(replace(split_part(url, '#', 1), '+', '%2B')) AS base, CASE WHEN contains(url, '#') THEN url_decode(replace(substr(url, strpos(url, '#') + 1), '+', '%2B')) || '#' ELSE '' END || 'a b+' || page_id AS fragment FROM pages")
def _(t):
    link = F.concat("url", F.lit("#a%20b+"), "page_id")
    return t.pages.select("page_id", text.href_base(link).alias("base"), text.href_fragment(link).alias("fragment"))


HREF = "'text/book' || (doc_id % 7) || CASE WHEN doc_id % 5 = 0 THEN '.html' WHEN doc_id % 2 = 0 THEN '_split_' || doc_id || '.html' ELSE '-split-' || doc_id || '.xhtml' END"


@query("t15_a2_split_series", f"SELECT prefix, ext, count(*) AS n FROM (SELECT regexp_extract(h, '^(.+?)(_split_|-split-)[0-9]+([.][^./]+)$', 1) AS prefix, regexp_extract(h, '^(.+?)(_split_|-split-)[0-9]+([.][^./]+)$', 3) AS ext FROM (SELECT {HREF} AS h FROM documents)) WHERE prefix <> '' GROUP BY ALL")
def _(t):
    key = text.series_key(F.expr(HREF.replace("||", "||")))
    return t.documents.select(key.alias("k")).where("k IS NOT NULL").groupBy(F.col("k.prefix").alias("prefix"), F.col("k.ext").alias("ext")).agg(F.count("*").alias("n"))


TITLED = r"x <> '' AND NOT regexp_matches(x, '(?i)^[\W_]*(\d+|[ivxlcdm]+)[\W_]*$')"


@query(
    "t16_titles_from_text",
    f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN 'IV' || chr(10) || ' ' || chr(10) || text ELSE text END, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), {WS})), lambda x: {TITLED}) AS lines FROM documents),
b AS (SELECT doc_id, list_transform(lines, lambda x: struct_pack(cut := length(x) > 80 OR len(string_split(x, ' ')) > 10, s := CASE WHEN length(x) > 80 OR len(string_split(x, ' ')) > 10 THEN array_to_string(string_split(x, ' ')[1:10], ' ') ELSE x END)) AS heads FROM a),
c AS (SELECT doc_id, list_transform(heads, lambda x: struct_pack(cut := x.cut, s := regexp_replace(regexp_replace(regexp_replace(x.s, '^[ "''`\\[\\](){{}}<>-]+|[ "''`\\[\\](){{}}<>-]+$', '', 'g'), '[,:;.!?]+$', ''), {WS}))) AS heads FROM b),
d AS (SELECT doc_id, list_filter(list_transform(heads, lambda x: CASE WHEN x.cut AND {TITLED.replace("x ", "x.s ").replace("(x,", "(x.s,")} AND NOT ends_with(x.s, '...') THEN x.s || '...' ELSE x.s END), lambda x: {TITLED}) AS t FROM c)
SELECT doc_id, coalesce(t[1], '') AS title FROM d""",
)
def _(t):
    raw = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("IV\n \n"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", text.title_of_text(raw).alias("title"))


@query("t18_file_titles", r"SELECT page_id, CASE WHEN b = '' THEN s ELSE b END AS title FROM (SELECT page_id, s, regexp_replace(translate(regexp_replace(s, '^[0-9]+[-_ ]+', ''), '_-', '  '), '^\s+|\s+$', '', 'g') AS b FROM (SELECT page_id, lpad(page_id::VARCHAR, 4, '0') || CASE WHEN page_id % 4 = 0 THEN '-' ELSE '_my-file_name ' END AS s FROM pages))")
def _(t):
    name = F.concat(F.lit("a.b/raw/"), F.expr("lpad(string(page_id), 4, '0')"), F.when(F.expr("page_id % 4 = 0"), F.lit("-")).otherwise("_my-file_name "), F.lit(".txt"))
    return t.pages.select("page_id", text.file_title(name).alias("title"))


@query("t21_authors", "SELECT doc_id, list_filter(list_transform(string_split_regex(source || ' , ' || lang || chr(10) || '  ,x', '[,\\n]'), lambda a: trim(a)), lambda a: a <> '') AS authors FROM documents")
def _(t):
    return t.documents.select("doc_id", rules.authors(F.concat("source", F.lit(" , "), "lang", F.lit("\n  ,x"))).alias("authors"))


@query("t23_voice_names", "SELECT s_suppkey, upper(n[1]) || n[2:] AS name FROM (SELECT s_suppkey, lower(trim(regexp_replace(replace(s_name, '#', ' ' || chr(9) || ' '), '[\\s_-]+', ' ', 'g'))) AS n FROM supplier)")
def _(t):
    return t.supplier.select("s_suppkey", rules.voice_name(F.replace("s_name", F.lit("#"), F.lit(" \t "))).alias("name"))


@query("t24_semantic_tokens", "SELECT p_partkey, list_filter(string_split_regex(lower(p_type || '-' || p_name), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM part")
def _(t):
    return t.part.select("p_partkey", rules.semantic_tokens(F.concat("p_type", F.lit("-"), "p_name")).alias("tokens"))


@query(
    "a3_case_map",
    r"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '\p{L}(?:\p{L}|[''’-])*')) AS word FROM documents),
    v AS (SELECT source, lower(word) AS k, word, count(*) AS n FROM w WHERE upper(word) <> word GROUP BY ALL)
    SELECT source, k, word AS best, n FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY n DESC, CASE WHEN regexp_matches(word, '^[A-Z].*[a-z]') THEN 3 WHEN lower(word) = word THEN 2 ELSE 1 END DESC, word) AS r FROM v) WHERE r = 1""",
)
def _(t):
    return rules.case_map(t.all_cores("documents"), "source", "text").select("source", F.col("key").alias("k"), "best", "n")


@query("h1_html_text")
def _(t):
    return t.all_cores("pages").select("page_id", text.extracted(html.html_text(F.col("html"))).alias("text"))


@query("h2_footnote_index")
def _(t):
    return rules.footnote_index(t.pages.withColumn("book", F.expr("page_id % 10")), "book", "url", "html")


@query("t6_t7_case_repair")
def _(t):
    return t.all_cores("documents").select("doc_id", rules.case_repaired(F.when(F.expr("doc_id % 3 = 0"), F.upper("text")).when(F.expr("doc_id % 3 = 1"), F.concat(F.upper(F.substring("text", 1, 40)), F.expr("substring(text, 41)"))).otherwise(F.col("text"))).alias("text"))

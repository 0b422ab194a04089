"""Segmentation and verbalization."""

from pyspark.sql import functions as F

from lectern.functions import numbers, segment, speech
from lectern.queries.registry import query

ONES = "[" + ", ".join(f"'{w}'" for w in numbers.SMALL) + "]"
TENS = "['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def sql_below_hundred(x):
    return f"CASE WHEN {x} < 20 THEN {ONES}[1 + {x}] ELSE {TENS}[{x} // 10 - 1] || CASE WHEN {x} % 10 = 0 THEN '' ELSE ' ' || {ONES}[1 + {x} % 10] END END"


def sql_below_thousand(x):
    return f"CASE WHEN {x} < 100 THEN {sql_below_hundred(x)} ELSE {ONES}[1 + {x} // 100] || ' hundred' || CASE WHEN {x} % 100 = 0 THEN '' ELSE ' ' || {sql_below_hundred(f'({x} % 100)')} END END"


def sql_words(x):
    """Words of a whole number from 0 to 10^9 in DuckDB."""
    parts = ", ".join(f"CASE WHEN ({x} // {s}) % 1000 > 0 THEN {sql_below_thousand(f'(({x} // {s}) % 1000)')} || '{w}' END" for s, w in ((1_000_000, " million"), (1000, " thousand"), (1, "")))
    return f"CASE WHEN {x} = 0 THEN 'zero' ELSE concat_ws(' ', {parts}) END"


@query("v26_int_words", f"SELECT o_orderkey, {sql_words('n')} AS words FROM (SELECT o_orderkey, (o_custkey * 7919 * (o_orderkey % 3))::BIGINT AS n FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", numbers.int_words(F.col("o_custkey") * 7919 * (F.col("o_orderkey") % 3)).alias("words"))


YEAR = f"CASE WHEN y > 2099 THEN {sql_words('y')} WHEN y < 2000 THEN {sql_below_hundred('(y // 100)')} || CASE WHEN y % 100 = 0 THEN ' hundred' WHEN y % 100 < 10 THEN ' oh ' || {ONES}[1 + y % 100] ELSE ' ' || {sql_below_hundred('(y % 100)')} END WHEN y = 2000 THEN 'two thousand' WHEN y < 2010 THEN 'two thousand ' || {ONES}[1 + y % 100] ELSE 'twenty ' || {sql_below_hundred('(y % 100)')} END"


@query("v24_year_words", f"SELECT o_orderkey, {YEAR} AS words FROM (SELECT o_orderkey, year(o_orderdate) - 90 + o_orderkey % 200 AS y FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", numbers.year_words(F.year("o_orderdate") - 90 + F.col("o_orderkey") % 200).alias("words"))


@query(
    "v25_ordinals",
    f"SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 'zeroth' ELSE w[:length(w) - length(l)] || CASE l WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth' WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth' ELSE CASE WHEN l LIKE '%y' THEN l[:length(l) - 1] || 'ieth' ELSE l || 'th' END END END AS words FROM (SELECT p_partkey, w, split_part(w, ' ', -1) AS l FROM (SELECT p_partkey, {sql_words('p_partkey')} AS w FROM part))",
)
def _(t):
    return t.part.select("p_partkey", numbers.ordinal_words(F.col("p_partkey")).alias("words"))


ROMAN = "['','M','MM','MMM'][1 + n // 1000] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][1 + n // 100 % 10] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][1 + n // 10 % 10] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][1 + n % 10]"


@query("v14_roman_numerals", f"SELECT p_partkey, roman, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE n END::INT AS value, 'Chapter ' || {sql_words('n')} AS heading FROM (SELECT p_partkey, n, CASE WHEN p_partkey % 7 = 0 THEN 'IIII' ELSE {ROMAN} END AS roman FROM (SELECT p_partkey, 1 + p_partkey % 3999 AS n FROM part))")
def _(t):
    n = 1 + F.col("p_partkey") % 3999
    roman = F.when(F.col("p_partkey") % 7 == 0, F.lit("IIII")).otherwise(numbers.to_roman(n))
    return t.part.select("p_partkey", roman.alias("roman"), n.alias("n")).select("p_partkey", "roman", numbers.roman_value(F.col("roman")).alias("value"), F.concat(F.lit("Chapter "), numbers.int_words(F.col("n"))).alias("heading"))


@query("v22_plural_numbers", f"SELECT p_partkey, CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN w[:length(w) - 1] || 'ies' WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' ELSE w || 's' END AS words FROM (SELECT p_partkey, {sql_words('p_partkey')} AS w FROM part)")
def _(t):
    return t.part.select("p_partkey", numbers.plural_word(numbers.int_words(F.col("p_partkey"))).alias("words"))


AMOUNT = "CASE WHEN o_orderkey % 3 = 0 THEN '1.00' WHEN o_orderkey % 3 = 1 THEN (o_custkey % 900)::VARCHAR || '.00' ELSE (o_custkey % 900)::VARCHAR || ',000.50' END"


@query("v15_currency", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1 dollar' WHEN o_orderkey % 3 = 1 THEN (o_custkey % 900) || CASE WHEN o_custkey % 900 = 1 THEN ' dollar' ELSE ' dollars' END ELSE (o_custkey % 900) || '000.50 dollars' END AS said FROM orders")
def _(t):
    amount = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '1.00' WHEN o_orderkey % 3 = 1 THEN concat(o_custkey % 900, '.00') ELSE concat(o_custkey % 900, ',000.50') END")
    return t.orders.select("o_orderkey", speech.spoken(F.concat(F.lit("$"), amount), speech.currency).alias("said"))


@query("v6_spoken_urls", """SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[A-Za-z0-9]+|.'), lambda k: CASE lower(k) WHEN 'http' THEN 'h-t-t-p' WHEN 'https' THEN 'h-t-t-p-s' WHEN 'www' THEN 'w-w-w' WHEN 'ftp' THEN 'f-t-p' WHEN ':' THEN 'colon' WHEN '/' THEN 'slash' WHEN '.' THEN 'dot' WHEN '-' THEN 'dash' WHEN '_' THEN 'underscore' WHEN '?' THEN 'question mark' WHEN '=' THEN 'equals' WHEN '&' THEN 'ampersand' WHEN '#' THEN 'hash' WHEN '@' THEN 'at' WHEN '%' THEN 'percent' WHEN '~' THEN 'tilde' ELSE k END), ' ') || '.' AS said FROM pages""")
def _(t):
    return t.pages.select("page_id", speech.spoken(F.concat("url", F.lit(".")), speech.say_urls).alias("said"))


@query("v1_v2_stripped", "SELECT doc_id, md5(regexp_replace('(' || text || ') [\"x\"] {y} “z” «q»', '[][(){}\"“”«»„‟❝❞]', '', 'g')) AS digest FROM documents")
def _(t):
    raw = F.concat(F.lit("("), "text", F.lit(') ["x"] {y} “z” «q»'))
    return t.documents.select("doc_id", F.md5(F.translate(raw, "()[]{}" + speech.DOUBLE_QUOTES, "").cast("binary")).alias("digest"))


SAMPLES = ["'tis the dogs' 'best' bone", "See pp. 4 and v. IX, No. 7", "Mr. A. B. Cole of the U.S.A.", "44 B.C. or AD 70", "Chapters III and IV; part i of it", "1999-05, the 1850s and '80s", "1,234,567 and 3.14 and 2.0.1", "II.3, Fig. 2.1 and -5", "a1b 007 21st 12345678", "one\n\n\ntwo\nthree,\nfour", "ā Saṃsāra ñ é", "e.g. this, etc. VS. that"]
SAID = [
    "'tis the dogs best bone.", "See pages four and verse IX, number seven.", "Mr A-B-Cole of the U-S-A.", "forty four B-C or A-D seventy.", "Chapters three and four; part i of it.", "nineteen ninety nine to two thousand five, the eighteen fifties and eighties.",
    "one million two hundred thirty four thousand five hundred sixty seven and three point one four and two point zero point one.", "two point three, Figure two point one and minus five.", "a one b zero zero seven twenty first twelve million three hundred forty five thousand six hundred seventy eight.",
    "one. two, three, four.", "aa Samsaara ny e.", "for example this, et cetera VERSUS that.",
]


def _sql_list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


@query("v1_v28_verbalized_samples", f"SELECT event_id, {_sql_list(SAID)}[1 + event_id % {len(SAID)}] AS said FROM events")
def _(t):
    raw = F.try_element_at(F.array(*(F.lit(s) for s in SAMPLES)), (1 + F.col("event_id") % len(SAMPLES)).cast("int"))
    return t.events.select("event_id", speech.spoken(raw).alias("said"))


@query("v_verbalized_documents")
def _(t):
    return t.all_cores("documents").select("doc_id", speech.spoken(F.col("text")).alias("said"))


@query("v4_reading_overrides", "SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '\\b[Tt][Hh][Ee]\\b', 'ze', 'g'), 'tion', 'shun', 'g'), 'que', 'k')) AS digest FROM documents")
def _(t):
    rules = [{"base": "the", "reading": "ze"}, {"pattern": "tion", "reading": "shun", "case_sensitive": True}, {"pattern": "que", "reading": "k", "case_sensitive": True, "mode": "substring"}, {"pattern": "(", "reading": "broken"}]
    return t.all_cores("documents").select("doc_id", F.md5(speech.spoken(F.col("text"), speech.apply_overrides, entries=rules).cast("binary")).alias("digest"))


PARA = "replace(text, chr(10), chr(10) || ' ' || chr(10))"


@query("c1_c2_paragraphs", f"SELECT doc_id, i::INT AS pos, p AS paragraph FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({PARA}, '\\n\\s*\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents))")
def _(t):
    raw = F.replace("text", F.lit("\n"), F.lit("\n \n"))
    rows = t.all_cores("documents").select("doc_id", raw.alias("t")).select("doc_id", "t", F.posexplode(segment.paragraph_spans(F.col("t"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.expr("substring(t, s.start + 1, s.end - s.start)").alias("paragraph"))


@query("c6_c7_w1_chunks")
def _(t):
    return segment.chunks(t.all_cores("documents").select("doc_id", "text"), "text", 400)


@query("c4_c5_sentences_with_rules")
def _(t):
    rows = t.all_cores("documents").select("doc_id", "text", F.explode(segment.sentence_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("sentence"))


@query("c9_m9_manifest", "SELECT conv_id, turn, role, sha256(text) AS text_sha256, CASE WHEN turn % 3 = 0 THEN false ELSE true END AS reusable FROM conversations")
def _(t):
    from lectern.operators.manifest import reusable

    now = t.conversations.select("conv_id", "turn", "role", "text")
    old = now.select("conv_id", "turn", "role", F.sha2(F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    return reusable(now, old, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text_sha256", "reusable")

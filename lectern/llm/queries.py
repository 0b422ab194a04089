"""The queries of this subpackage by name, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chains, decontaminate, langid, lbl, line_rules, ordinal, packing, simhash, token_io, warc
from lectern.llm.common import split_remainder
from lectern.session import spread, table


def tokenizer(name: str) -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), data=False))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_io.write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_io.read_tokens(manifest, binary=True).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op3_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_remainder(7) == 2
    return lbl.score(documents(spark, sf_dir), ~held_out, held_out.alias("held_out"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), split_remainder(5) == 0
    return langid.predict(docs, langid.fit(docs, ~held_out), held_out.alias("held_out"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(documents(spark, sf_dir), text=False).drop("clean_text")


#: Three grades: a point for sound text and one for a civil tone.
GRADE = "quality + 1 - toxic AS grade"


def op8_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ordinal.predict(docs, ordinal.fit_ordinal(docs, table(spark, sf_dir, "labels").selectExpr("doc_id", GRADE), "grade"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids")


#: The chain's categories: the labels know one kind of toxicity, of which that in junk text is the second.
TOXICITY = {"toxic": "toxic", "toxic_junk": "toxic * (1 - quality)"}


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = chains.fit_chain(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return chains.predict(docs, chain, list(TOXICITY)).withColumn("toxic", F.col("is_toxic"))


QUERIES = {"op1_warc": op1_warc, "op2_token_ids": op2_token_ids, "op3_lbl": op3_lbl, "op4_packing": op4_packing, "op5_langid": op5_langid, "op6_simhash": op6_simhash, "op7_line_rules": op7_line_rules, "op8_ordinal": op8_ordinal, "op9_decontaminate": op9_decontaminate, "op10_toxicity": op10_toxicity}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT page_id, n, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f""",
    "op7_line_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0d]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0d]')) AS ls FROM d),
n AS (SELECT doc_id, host, t, ws, ls, list_transform(ls, lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0d]+', ' ', 'g'))) AS ns FROM w),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_zip(ws, ws[2:], ws[3:])[:len(ws) - 2]) AS key FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS repeated FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY doc_id),
u AS (SELECT DISTINCT host, ns FROM n),
f AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(ns)) AS line FROM u) GROUP BY host, line HAVING count(*) > 5),
g AS (SELECT doc_id, count(*) AS removed_lines, sum(words) AS removed_words FROM (SELECT doc_id, host, unnest(ns) AS line, len(string_split(line, ' ')) AS words FROM n) JOIN f USING (host, line) GROUP BY doc_id),
m AS (SELECT n.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(repeated, 0)::BIGINT AS n_repeat_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines, coalesce(removed_words, 0)::BIGINT AS removed_words
    FROM n LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept FROM m""",
}

"""Every registered query by its name, and every pipeline stage, over small tables with nulls, repeats and clashing columns."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from lectern.llm import line_rules
from lectern.llm.queries import ORACLES, QUERIES, tokenizer
from lectern.llm.tokens import Encoder
from lectern.session import written
from tests.llm.test_line_rules import brute as brute_rules
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_simhash import brute_kept
from tests.test_queries import rows

ITEM = "Which of the seven rivers of the old country runs north past the mill town? The river that they call Arda."


def prose(k, n=70):
    return " ".join(f"w{(k * 37 + i * 11) % 97}x{i % 7}" for i in range(n))


DOCS = [
    *((k, prose(k), "en", f"s{k % 3}") for k in range(30)),
    *((100 + k, prose(5), "en", "s2") for k in range(6)), (105, prose(6), "en", "s0"), (105, prose(6), "en", "s0"),
    (200, None, None, None), (201, "", "en", "s1"), (202, " \n\t\n", None, "s1"), (None, prose(40), "de", None), (None, None, None, None),
    (203, "12 34 !!", "en", "s0"), (204, prose(50) + "\n" + ITEM + "\n" + prose(51), "en", "s1"), (205, ITEM, "en", "s1"),
    *((300 + k, f"All rights  RESERVED here.\n{prose(60 + k)}\nall rights reserved HERE.", "fr", "hot") for k in range(9)),
    (400, "long words " * 60_000, "en", "hot"),
]
LABELS = [*((k, k % 2, int(k % 5 == 0)) for k in range(30)), (3, 0, 1), (None, 1, 1), (7, None, None), (99999, 1, 0)]
PAGES = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "http://é", "é" * 300_000)]


def tables(spark, folder, part):
    docs, labels, pages, items = (DOCS, LABELS, PAGES, [(1, ITEM), (2, None), (None, ITEM), (3, "")]) if part == "odd" else ([], [], [], [])
    clash = ["'c' AS host", "1 AS n_words", "'k' AS fp", "array(1) AS candidates", "'y' AS _y0", "2.5 AS start", "'r' AS root"]
    for name, data, kinds in (
        ("documents", [(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"),
        ("pages", pages, "page_id long, url string, html string"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, kinds).selectExpr("*", *clash).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module", params=["odd", "empty"])
def case(spark, request, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(request.param))
    tables(spark, folder, request.param)
    return request.param, folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, case, name):
    part, folder = case
    df = QUERIES[name](spark, folder)
    got = df.collect()
    source = PAGES if name == "op1_warc" else DOCS
    if part == "empty":
        assert got == []
        return
    if name != "op4_packing":
        key = "page_id" if name == "op1_warc" else "doc_id"
        assert Counter(r[key] for r in got) == Counter(r[0] for r in source)
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("pages", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        if name == "op7_line_rules":  # the SQL goes by doc_id, so rows that repeat one, or have none, are left out of both
            once = {d for d, n in Counter(x[0] for x in DOCS).items() if n == 1 and d is not None}
            found, expected = [r for r in got if r.doc_id in once], [r for r in want.fetchall() if r[columns.index("doc_id")] in once]
        else:
            found, expected = got, want.fetchall()
        assert rows(found, df.columns) == rows(expected, columns)
    if name == "op6_simhash":
        assert sorted((tuple(r) for r in got), key=str) == brute_groups([(d[0], d[1]) for d in DOCS])
    if name in ("op2_token_ids", "op4_packing"):
        enc = Encoder(tokenizer("byte_bpe_50k.json" if name == "op2_token_ids" else "word_bpe_49k.json"), memo=False)
        lengths = Counter((d[0], len(enc.encode(d[1] or "")) // 4 + 1) for d in DOCS)
        if name == "op2_token_ids":
            assert Counter((r.doc_id, r.n_tokens) for r in got) == lengths
        else:
            assert sum(r.length for r in got) == sum(n * k for (_, n), k in lengths.items())
            whole = Counter()
            for r in got:
                whole[r.sequence_id] += r.length
            assert all(n == 4096 or n & (n - 1) == 0 for n in whole.values())
    if name == "op9_decontaminate":
        assert {r.doc_id for r in got if r.contaminated} == {204, 205}
    if name == "op10_toxicity":
        assert all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic >= 0.5) for r in got)
    if name == "op8_ordinal":
        assert all(0 <= r.expected_grade <= 2 for r in got)
    if name == "op5_langid":
        assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202, 203)} == {"und"}


def test_stages(spark, case):
    part, folder = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.toPandas()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != cp.STAGES[-1][0]:
            assert out.columns == list(cp.COLUMNS)
        docs = written(out, "stage")
        seen.append(docs.toPandas())
    if part == "empty":
        assert all(not len(x) for x in seen)
        return
    null = lambda x: None if x is None or x != x else x
    pairs = lambda df: [(None if null(d) is None else int(d), t or "") for d, t in zip(df.doc_id, df.text)]
    want = [(r[0], r[10]) for r in brute_rules([(d[0], d[1], d[3]) for d in DOCS], line_rules.MIN_DOCS, line_rules.LEAST_KEPT) if r[9]]
    assert Counter(pairs(seen[1])) == Counter(want)
    assert any("RESERVED" in (d[1] or "") for d in DOCS) and not any("RESERVED" in t for t in seen[1].text)
    assert not Counter(pairs(seen[2])) - Counter(pairs(seen[1]))
    assert sorted(pairs(seen[3]), key=str) == brute_kept(pairs(seen[2]))
    gone = Counter(pairs(seen[3])) - Counter(pairs(seen[4]))
    assert set(d for d, _ in gone) <= {204, 205} and not any(re.search("seven rivers", t) for t in seen[4].text)
    enc = Encoder(tokenizer("word_bpe_49k.json"), memo=False)
    assert sum(seen[5].length) == sum(len(np.frombuffer(enc.encode(t), "<u4")) + 1 for _, t in pairs(seen[4]))

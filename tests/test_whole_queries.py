"""Queries that take in every row and whole texts."""

import hashlib

import pytest

from lectern.queries import QUERIES


def test_all_chapters_have_overrides(spark, sf):
    got = QUERIES["j9_chapter_overrides"](spark, sf).collect()
    orders = [r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    parts = [r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]
    want = {o: sorted(p for p in parts if p % 50 == 0 or p % 3 == 0 and p == o) for o in orders}
    assert {r.o_orderkey: r.overrides for r in got} == want and len(got) == len(orders)


@pytest.mark.parametrize("name", ["t20_highlights", "t13_slugs", "t6_t7_case_repair", "v4_reading_overrides"])
def test_whole_texts_of_all_documents(spark, name, tmp_path):
    texts = ["", "ab", None, "é — ß " * 40 + "end of it", "x" * 1_000_050 + " last words"]
    spark.createDataFrame([(3 * i + 1, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 4, 7, 10, 13]
    if name == "t13_slugs":
        assert got[4] == "ab" and got[10] == "e-" * 30 and len(got[13]) == 60
    if name == "t6_t7_case_repair":
        assert len(got[13]) == len(texts[4]) and got[13].endswith("last words")
    if name == "t20_highlights":
        n = len(texts[4])
        marked = texts[4][: n // 4] + "<mark>" + texts[4][n // 4 : n // 2] + "</mark>" + texts[4][n // 2 : 3 * n // 4] + "<mark>" + texts[4][3 * n // 4 :] + "</mark>"
        assert got[13] == hashlib.md5(marked.encode()).hexdigest()

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import packing, token_io
from lectern.llm.queries import tokenizer
from lectern.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {n: Encoder(tokenizer(n)) for n in NAMES}
ODD = ["", " ", "\n", "it's  we'LL", "Ünïcode ſtraße İ ǅ", "a\x1cb \x85c\xa0d", "x y", "étude", "日本 語 text", "<|endoftext|> <|startoftext|>x", "1234 5a6", "  two\n\n three \t\r\n", "ªº µ ² ½", "don't''s 's", "🙂 ok", "ΣΑΣ ς"]


def whole(name, text):
    return ENCODERS[name].tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_words_by_memo_equal_whole_texts(name, sf):
    texts = ODD + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:60]
    assert ENCODERS[name].cut is not None
    for text in texts:
        assert np.frombuffer(ENCODERS[name].encode(text), "<u4").tolist() == whole(name, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB's \n\t.,!0é-_|$'İſÿɏ\x1f\xa0語"), max_size=40))
def test_any_text(text):
    for name in NAMES:
        assert np.frombuffer(ENCODERS[name].encode(text), "<u4").tolist() == whole(name, text)


ROWS = [(5, "one two"), (3, None), (5, "one two"), (None, "x"), (9, ""), (1, "word " * 9000), (2, "z" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "src", 1.5, "clash") for d, t in ROWS], "doc_id long, text string, source string, start double, ids string")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_all_ids_in_order(odd, encoding):
    manifest = token_io.write_tokens(odd, tokenizer(NAMES[0]), 0, encoding, group_tokens=4000)
    got = sorted(token_io.read_tokens(manifest).collect(), key=lambda r: r.start)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert [r.ids for r in got] == [[*whole(NAMES[0], t or ""), 0] for _, t in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    assert sorted(token_io.read_metadata(manifest).collect(), key=lambda r: r.start) == [(r.doc_id, r.start, r.n_tokens) for r in got]
    crc = {r.start: r.ids_crc32 for r in token_io.read_tokens(manifest, binary=True).select("start", F.crc32("tokens").alias("ids_crc32")).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    path = max(manifest.collect(), key=lambda r: r.n_tokens).path.removeprefix("file://")
    group = pq.ParquetFile(path).metadata.row_group(0)
    ids = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
    assert ids.has_column_index or ids.has_offset_index
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta") and ids.has_dictionary_page == (encoding == "dictionary")


def test_no_rows_no_files(odd):
    manifest = token_io.write_tokens(odd.limit(0), tokenizer(NAMES[0]))
    assert manifest.count() == 0 and token_io.read_tokens(manifest).collect() == []


@given(st.lists(st.integers(0, 300), max_size=60), st.sampled_from([1, 8, 64, 100]))
def test_assign_covers_every_token_once_and_pads_nothing(lengths, capacity):
    pieces, sizes = packing.assign(lengths, capacity)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, offset in pieces:
        assert n > 0
        by_doc[doc].append((start, n))
        by_sequence[seq].append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc[doc]):
            assert start == at
            at += k
        assert at == n
    for seq, size in enumerate(sizes):
        at = 0
        for offset, k in sorted(by_sequence[seq]):
            assert offset == at
            at += k
        assert at == size and (size == capacity or size & (size - 1) == 0 and size < capacity)


def test_costs_are_balanced():
    lengths = [3000, 1000, 900, 700, 600, 500, 400, 300, 200, 100, 92, 400]
    pieces, sizes = packing.assign(lengths, 4096)
    assert len(sizes) == 2
    assert len({s for d, *_, s, _ in pieces if d == 0}) == 1
    cost = [sum(n + n * n / 2048 for *_, n, s, _ in pieces if s == k) for k in range(2)]
    assert max(cost) / min(cost) < 1.6


def test_pack_of_odd_rows(odd):
    got = packing.pack(odd, tokenizer(NAMES[1]), 2, 64, 256).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        assert len(r.tokens) == 4 * r.length and r.offset + r.length <= r.sequence_tokens
        ids[r.doc_id] += np.frombuffer(r.tokens, "<u4").tolist()
    for d, t in ROWS:
        n = sum(x == d for x, _ in ROWS)
        if n == 1:
            assert ids[d] == [*whole(NAMES[1], t or ""), 2]
        else:
            assert sorted(ids[d]) == sorted(2 * [*whole(NAMES[1], t), 2])
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id, r.sequence_tokens] += r.length
    assert all(size == n for (_, size), n in used.items()) and len({s for s, _ in used}) == len(used)
    assert packing.pack(odd.limit(0), tokenizer(NAMES[1])).collect() == []


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_chosen_documents_are_read_alone(spark, encoding):
    """Few pages are read for few ids: the scan hands on far fewer rows than there are, and the ids column only when asked."""
    docs = spark.range(6000).selectExpr("id * 2 AS doc_id", "concat('word ', id, repeat(' and more', cast(id % 40 AS int))) AS text")
    manifest = token_io.write_tokens(docs, tokenizer(NAMES[0]), 0, encoding, group_tokens=40_000, page_bytes=2048)
    ids = [0, 801, 802, 4444, 11_998, 99_999]
    want = {r.doc_id: r for r in token_io.read_tokens(manifest).where(F.col("doc_id").isin(ids)).collect()}
    assert sorted(want) == [0, 802, 4444, 11_998]
    assert {r.doc_id: r for r in token_io.read_documents(manifest, ids).collect()} == want
    slim = token_io.read_documents(manifest, ids, ids=False)
    assert slim.columns == ["doc_id", "start", "n_tokens"] and {r.doc_id: r.start for r in slim.collect()} == {d: r.start for d, r in want.items()}
    assert token_io.read_documents(manifest, []).collect() == [] and token_io.read_documents(manifest, [7]).collect() == []
    scan = token_io._chosen(manifest, ids, True)
    assert len(scan.collect()) == 4
    plan = scan._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    read = leaf.metrics().get("numOutputRows").get().value()
    assert read < 6000 / 4, read
    assert "ids" not in token_io._chosen(manifest, ids, False)._jdf.queryExecution().executedPlan().collectLeaves().apply(0).toString()

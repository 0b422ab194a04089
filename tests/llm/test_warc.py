import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from lectern.llm import warc

BIG = "größe " * 3000
ROWS = [(9, "http://a/\r\nX: y", BIG), (4, "http://b", BIG), (4, "http://b", BIG), (7, None, None), (8, "http://c", ""), (1, "u", "tiny"), (2, "u", "tiny"), (None, "http://d", BIG), (None, "http://e", "z" * 100), (3, "http://f", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 40), (5, "x", "é" * 50), (6, "x", "é" * 50), (10, "x", "e" * 99), (11, "x", "e" * 99)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, payload string, n int")


@pytest.mark.parametrize("chunk", [1000, 1 << 18])
def test_round_trip(pages, chunk):
    manifest = warc.write_archives(pages, chunk)
    chunks = warc.read_archives(manifest, chunk)
    got = sorted((tuple(r) for r in warc.records(chunks).collect()), key=str)
    groups = defaultdict(list)
    for i, (p, _, html) in enumerate(ROWS):
        groups[(html or "").encode()].append((p is None, p or 0, i))
    want = []
    for i, (p, _, html) in enumerate(ROWS):
        data = (html or "").encode()
        first = min(groups[data])
        revisit = len(data) >= 100 and first[2] != i
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[1] if revisit else None))
    assert got == sorted(want, key=str)
    parts = defaultdict(dict)
    for r in chunks.where("record_type = 'response'").collect():
        assert len(r.data) <= chunk
        parts[r.record_id][r.chunk_no] = r
    payloads = []
    for rows in parts.values():
        data, digest = b"", hashlib.sha256()
        for k in range(len(rows)):
            data += rows[k].data
            digest.update(rows[k].data)
            assert (rows[k].payload_bytes, rows[k].payload_digest, rows[k].is_last) == (len(data), digest.hexdigest(), k == len(rows) - 1)
        payloads.append(data)
    assert sorted(payloads) == sorted((h or "").encode() for (_, _, h), w in zip(ROWS, want) if w[3] == "response")
    assert sum(r.n_records for r in manifest.collect()) == len(ROWS)


def test_empty(pages):
    manifest = warc.write_archives(pages.limit(0))
    assert manifest.count() == 0 and warc.records(warc.read_archives(manifest)).collect() == []


def test_broken_archives(pages):
    path = warc.write_archives(pages.where("page_id = 3")).first().path.removeprefix("file://")
    raw = open(path, "rb").read()
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(raw[:-10])))
    text = gzip.decompress(raw)
    assert text.count(b"WARC-Type") == 1
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(text.replace(b"Content-Length: 5", b"Content-Length: 6")))))
    assert list(warc.records_of(io.BytesIO(b""))) == []


def test_chunk_rows_carry_running_digests(pages):
    rows = defaultdict(dict)
    for r in warc.chunk_rows(pages, 1000).collect():
        rows[r.row][r.chunk_no] = r
    assert len(rows) == len(ROWS)
    for chunks in rows.values():
        data = b""
        for k in range(len(chunks)):
            data += chunks[k].data
            assert (chunks[k].payload_bytes, chunks[k].payload_digest, chunks[k].is_last) == (len(data), hashlib.sha256(data).hexdigest(), k == len(chunks) - 1)


def test_pages_from_a_shuffle(spark):
    """Every revisit names a record that was written, and each group has one response, whatever order rows come in."""
    pages = spark.range(400).selectExpr("id % 130 AS page_id", "'u' AS url", "repeat(concat('payload ', id % 7), 40) AS html").repartition(7, "html").unionAll(spark.range(40).selectExpr("id", "'v'", "repeat('payload 3', 40)").repartition(3))
    got = warc.read_archives(warc.write_archives(pages), data=False).where("is_last").collect()
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    assert len(got) == 440 and len({r.record_id for r in got}) == 440 and len(responses) == len({r.payload_digest for r in got})
    least = {d: min(r.page_id for r in got if r.payload_digest == d) for d in {r.payload_digest for r in got}}
    assert all(r.page_id == least[r.payload_digest] for r in responses.values())
    assert all(r.refers_to == least[r.payload_digest] for r in got if r.record_type == "revisit")

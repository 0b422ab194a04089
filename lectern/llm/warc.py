"""WARC archives as chunked record tables.

A payload is held whole only in the row that it comes in: it is cut into rows of record identifier and chunk
number, travels so, is written chunk by chunk into its record's gzip member, and is read back in blocks. Out and
back, each chunk row carries the bytes and the SHA-256 of the payload as far as it goes, so the last row of a
record has the whole payload's digest, which tells the equal payloads without looking at them again.
Equal payloads are stored once: later records revisit the first and hold its HTTP headers alone.
Archives have attempt-unique names, and only those of tasks that ended well are in the manifest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches
from lectern.llm.token_io import filesystem
from lectern.plans.skew import salted_lookup
from lectern.session import discard, shared_path, written

CHUNK = 1 << 18
#: Shorter payloads are never worth a revisit.
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
_BLOCK = 1 << 20
#: Bytes of chunk rows that a task holds before it hands them on.
_HELD = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all payloads: row, page_id, url, chunk_no, is_last, payload_bytes, payload_digest, data.

    `row` identifies a row of `pages`. payload_bytes and payload_digest tell of the payload up to and with the
    chunk, from one running digest; chunks are cut from the column's own buffer, so no payload is copied whole.
    A null html is one empty chunk. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        held, size = [], 0
        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html")):
                payload, digest, at, number = memoryview(html.as_buffer() or b""), hashlib.sha256(), 0, 0
                while not number or at < len(payload):
                    part = payload[at : at + chunk]
                    digest.update(part)
                    at += len(part)
                    held.append({"row": row, "page_id": page, "url": url, "chunk_no": number, "is_last": at == len(payload), "payload_bytes": at, "payload_digest": digest.hexdigest(), "data": bytes(part)})
                    number, size = number + 1, size + len(part) + 300
                    if size > _HELD:
                        yield pa.RecordBatch.from_pylist(held, schema=_CUT)
                        held, size = [], 0
                row += 1
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_CUT)

    rows = small_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    return rows.mapInArrow(cut, "row long, page_id long, url string, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, data binary")


def revisits(chunks: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(row, first_page, first_row) of the records of a table of `chunk_rows` that revisit another.

    Of equal payloads of `least_bytes` at least, the one with the smallest page_id is the response, the others
    revisit it. Of rows that repeat a page_id the one with the least `row` is; rows without a page_id come last.
    Only digests, ids and counts are read and grouped; payloads that many records share are spread over tasks.
    """
    keys = chunks.where(F.col("is_last") & (F.col("payload_bytes") >= least_bytes)).select("row", "page_id", "payload_digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    firsts = written(
        keys.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row"), "n"), "first-payloads"
    )
    total = firsts.agg(F.sum("n")).first()[0] or 1
    found = salted_lookup(keys, firsts, "payload_digest", "n", total, F.col("row"))
    return found.where("first_row <> row").select("row", "first_page", "first_row")


def _name(page: int | None, row: int) -> str:
    return f"<urn:lectern:page:{'none' if page is None else page}:{row}>"


def _headers(r: dict) -> bytes:
    """The WARC header and the HTTP header of a record: a last chunk's row, with what it revisits."""
    revisit = r["first_row"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"] or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(r['page_id'], r['row'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(r['first_page'], r['first_row'])}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else r['payload_bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, chunk: int = CHUNK, least_bytes: int = LEAST_BYTES, folder: str | None = None, level: int = 1) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html); the manifest: path, n_records, n_bytes.

    The chunk rows are a table in the shared folder, so a record is the same record however often a task is
    repeated. A record's last row is sent ahead of its chunks as its head, since it has the whole payload's digest and
    size, with what it revisits; records meet their chunks by one shuffle, and stream into their gzip members.
    Columns besides these are ignored; an empty table writes nothing. A payload whose chunks don't have the digest
    of its header is an error.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        out, path, records, size = None, "", 0, 0
        member = head = digest = None

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            out.write(data)

        def close() -> None:
            nonlocal member
            if member is not None:
                if head["first_row"] is None and digest.hexdigest() != head["payload_digest"]:
                    raise ValueError(f"{path}: a record's chunks don't make up its payload")
                put(member.compress(b"\r\n\r\n") + member.flush())
                member = None

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "data"}
            for i, data in enumerate(batch.column("data")):
                r = {c: x[i] for c, x in columns.items()}
                if out is None:
                    files.create_dir(root, recursive=True)
                    path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                if r["chunk_no"] < 0:
                    close()
                    member, head, digest = zlib.compressobj(level, zlib.DEFLATED, 31), r, hashlib.sha256()
                    records += 1
                    put(member.compress(_headers(r)))
                elif r["row"] != head["row"]:
                    raise ValueError(f"{path}: a chunk without its record")
                elif head["first_row"] is None:
                    digest.update(data.as_buffer())
                    put(member.compress(data.as_buffer()))
        if out is not None:
            close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": records, "n_bytes": size}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    chunks = written(chunk_rows(pages, chunk), "chunks", "zstd")
    again = written(revisits(chunks, least_bytes), "revisits")
    kinds = chunks.schema
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields}
    heads = chunks.where("is_last").drop("data", "chunk_no").join(again, "row", "left").select(*(F.lit(-1).alias(c) if c == "chunk_no" else none[c] if c == "data" else c for c in kinds.names), "first_page", "first_row")
    # what is only revisited needn't travel
    bodies = chunks.join(again.select("row"), "row", "left_anti").select(*(c if c in ("row", "chunk_no", "data") else none[c] for c in kinds.names), F.lit(None).cast("long").alias("first_page"), F.lit(None).cast("long").alias("first_row"))
    rows = small_batches(heads.unionByName(bodies).repartition("row").sortWithinPartitions("row", "chunk_no"))
    manifest = rows.mapInArrow(write, "path string, n_records long, n_bytes long").withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path"))
    done = written(manifest, "warc-manifest")
    discard(chunks, again)
    return done


class _Reader:
    """The unpacked bytes of a file of gzip members, block by block."""

    def __init__(self, f):
        self.f, self.buffer, self.member, self.rest = f, bytearray(), None, b""

    def fill(self) -> bool:
        raw = self.rest or self.f.read(_BLOCK)
        self.rest = b""
        if not raw:
            if self.member is not None and not self.member.eof:
                raise ValueError("the archive ends within a record")
            return False
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.buffer += self.member.decompress(raw, _BLOCK)
        self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """The bytes before `mark`, which is passed over; None at the end of the file."""
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most:
                raise ValueError("a header has no end")
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a header")
                return None
        got = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise ValueError("the archive ends within a payload")
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in header.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:lectern:page:(-?\d+):\d+>", name or "")
    return int(m[1]) if m else None


def records_of(f, chunk: int = CHUNK, data: bool = True) -> Iterator[dict]:
    """The chunk rows of an open archive; never more of a payload than a chunk and a block is held."""
    reader = _Reader(f)
    while (header := reader.until(b"\r\n\r\n")) is not None:
        if not header.lstrip().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        warc = _fields(header.lstrip())
        length = int(warc["content-length"])
        http_length, http = 0, {}
        if warc.get("content-type", "").startswith("application/http"):
            raw = reader.until(b"\r\n\r\n")
            http, http_length = _fields(raw), len(raw) + 4
        row = {"record_id": warc.get("warc-record-id"), "page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": _page(warc.get("warc-refers-to"))}
        left, done, number, digest = length - http_length, 0, 0, hashlib.sha256()
        if row["record_type"] == "revisit":
            reader.take(left)
            yield row | {"chunk_no": 0, "is_last": True, "payload_bytes": int(http.get("content-length", 0)), "payload_digest": warc.get("warc-payload-digest", "").removeprefix("sha256:"), "data": None}
        else:
            while True:
                part = reader.take(min(chunk, left))
                left -= len(part)
                done += len(part)
                digest.update(part)
                if not left and warc.get("warc-payload-digest", "sha256:" + digest.hexdigest()) != "sha256:" + digest.hexdigest():
                    raise ValueError(f"{row['record_id']}: its payload has another digest than its header says")
                yield row | {"chunk_no": number, "is_last": not left, "payload_bytes": done, "payload_digest": digest.hexdigest(), "data": part if data else None}
                number += 1
                if not left:
                    break
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']}: its block is longer than its header says")


_CUT = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])
_CHUNK_ROWS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])


def read_archives(manifest: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk rows of all archives of a table with their `path`; without `data` the bytes stay behind.

    payload_bytes and payload_digest tell of the payload up to and with the chunk; of a revisit, of the
    whole payload that it stands for. A broken archive is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = filesystem(path)
                held, size = [], 0
                with files.open_input_stream(at, compression=None) as f:
                    for row in records_of(f, chunk, data):
                        held.append(row)
                        size += len(row["data"] or b"") + 300
                        if size > _HELD:
                            yield pa.RecordBatch.from_pylist(held, schema=_CHUNK_ROWS)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_CHUNK_ROWS)

    kinds = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, data binary"
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, kinds)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record of `read_archives`: the last chunk's digest is the payload's."""
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

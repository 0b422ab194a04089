"""Token-ID output: Parquet files of id lists that can be read token by token or by metadata alone.

A file holds documents in ascending order with columns doc_id, start (ids in the file before it),
n_tokens and ids (a list column, dictionary or delta encoded). Row groups hold a bounded number of
tokens and every file has page indexes, so a reader gets at a document's ids or at all the lengths
without decoding anything else: `read_documents` reads the pages of chosen ids alone, `read_metadata` no ids at
all. `write_tokens` returns the manifest, one row a file, from which these and `read_tokens` work. Files have attempt-unique names and only those of tasks that
ended well are in the manifest, so tasks may fail, be repeated or run twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, rows_of
from lectern.llm.tokens import encoder
from lectern.session import shared_path, written

#: Rows after which a page may end, so that a chosen document costs few others.
PAGE_ROWS = 128
MANIFEST = "part int, path string, n_docs long, n_tokens long, first_doc long, last_doc long"
FILE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.uint32(), False)))])


def filesystem(uri: str):
    """The file system and plain path of a folder or file that Spark names by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int | None = 0, encoding: str = "dictionary", group_tokens: int = 1 << 20, page_bytes: int = 1 << 16, folder: str | None = None
) -> DataFrame:
    """Encodes every whole text, appends `end_id`, and writes ids in ascending doc_id order.

    Null texts are empty and have the end id alone. Null doc_ids come first; rows that share a doc_id
    are all kept, in the order of their texts' hashes. An empty table gives an empty manifest. Other columns are ignored.
    The range partitioning breaks ties by the hash, so that one repeated doc_id isn't one task's.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    folder = folder or shared_path(docs.sparkSession, "tokens")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        enc, writer, path = encoder(tokenizer), None, ""
        ids_of: list[bytes] = []
        docs_of: list[int | None] = []
        held = total = n_docs = 0
        first = last = None

        def flush() -> None:
            nonlocal writer, path, held, total
            if writer is None:
                files.create_dir(root, recursive=True)
                path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.parquet"
                # only the ids: Spark's reader loses its place in delta-coded longs when it skips pages
                delta = {"column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}, "use_dictionary": False}
                plain = {"use_dictionary": ["ids.list.element"], "dictionary_pagesize_limit": 1 << 20}
                writer = pq.ParquetWriter(files.open_output_stream(f"{root}/{path}"), FILE, compression="zstd", compression_level=1, write_page_index=True, data_page_size=page_bytes, write_batch_size=PAGE_ROWS, **(delta if encoding == "delta" else plain))
            lengths = np.array([len(x) // 4 for x in ids_of], np.int64)
            ends = np.cumsum(lengths)
            flat = pa.array(np.frombuffer(b"".join(ids_of), "<u4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat).cast(FILE.field("ids").type)
            writer.write_table(pa.table([pa.array(docs_of, pa.int64()), pa.array(total + ends - lengths), pa.array(lengths), lists], schema=FILE))
            total += held
            held = 0
            ids_of.clear()
            docs_of.clear()

        for batch in rows_of(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                first, last, n_docs = doc if not n_docs else first, doc, n_docs + 1
                ids_of.append(ids)
                docs_of.append(doc)
                held += len(ids) // 4
                if held >= group_tokens:
                    flush()
        if ids_of:
            flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": path, "n_docs": n_docs, "n_tokens": total, "first_doc": first, "last_doc": last}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]))

    ordered = doc_texts(docs).withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return written(ordered.mapInArrow(write, MANIFEST).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path")), "token-manifest")


def _bases(manifest: DataFrame) -> DataFrame:
    """path and base, the ids of all files before it."""
    before = Window.orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))


def _read(manifest: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """The columns of all files, a row group at a time; `start` counts from the first file on."""
    based = _bases(manifest)
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                files, at = filesystem(path)
                with files.open_input_file(at) as f:
                    for rows in pq.ParquetFile(f).iter_batches(batch_size=1024, columns=columns):
                        got = {c: rows.column(c) for c in columns}
                        if "start" in got:
                            got["start"] = pa.compute.add(got["start"], base)
                        if "ids" in got and "tokens binary" in schema:
                            at = got["ids"].offsets.to_pylist()
                            raw = got["ids"].values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
                            got["ids"] = pa.array([raw[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary())
                        elif "ids" in got:
                            got["ids"] = got["ids"].cast(pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays(list(got.values()), names=names)

    return based.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def read_metadata(manifest: DataFrame) -> DataFrame:
    """doc_id, start and n_tokens of every document; no ids are read."""
    return _read(manifest, ["doc_id", "start", "n_tokens"], "doc_id long, start long, n_tokens long")


def read_tokens(manifest: DataFrame, binary: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<long>) of every document.

    With `binary`, `tokens` comes in place of ids: the ids as little-endian unsigned 32-bit integers.
    """
    columns = ["doc_id", "start", "n_tokens", "ids"]
    return _read(manifest, columns, "doc_id long, start long, n_tokens long, " + ("tokens binary" if binary else "ids array<long>"))


def _chosen(manifest: DataFrame, doc_ids: list[int], ids: bool) -> DataFrame:
    """The rows of the files that may hold some of `doc_ids`, by Spark's Parquet reader: it skips row groups by their
    statistics and, by the page indexes, the pages of every column that hold none of them."""
    spark, wanted = manifest.sparkSession, sorted(set(doc_ids))
    there = F.exists(F.array(*map(F.lit, wanted)).cast("array<long>"), lambda d: (d >= F.col("first_doc")) & (d <= F.col("last_doc")))
    # a file begins with rows without an id if there are any, so its first_doc may be null
    paths = [r.path for r in manifest.where(F.coalesce(there, F.col("last_doc") >= wanted[0])).select("path").collect()] if wanted else []
    kinds = "doc_id long, start long, n_tokens long" + ", ids array<long>" * ids
    if not paths:
        return spark.createDataFrame([], kinds + ", file string")
    return spark.read.schema(kinds).parquet(*paths).where(F.col("doc_id").isin(wanted)).select(*(x.split()[0] for x in kinds.split(", ")), F.col("_metadata.file_name").alias("file"))


def read_documents(manifest: DataFrame, doc_ids: list[int], ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and (with `ids`) ids of the documents in `doc_ids` alone; unknown ids have no row.

    Files, row groups and pages that hold none of them aren't read, nor are the tokens without `ids`. The files that are
    opened are listed on the driver: at most two an id, but for files that repeat one. Rows that share a doc_id all come.
    """
    base = _bases(manifest).select(F.substring_index("path", "/", -1).alias("file"), "base")
    found = _chosen(manifest, doc_ids, ids).join(base, "file")
    return found.withColumn("start", F.col("start") + F.col("base")).drop("file", "base")

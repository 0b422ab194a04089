"""Files of a book from tables: every row of a table is a file, written whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions import text
from lectern.session import small_batches, written

WRITTEN = StructType().add("path", "string").add("bytes", "long")


def filesystem(uri: str):
    """The file system and plain path of a folder or file that Spark names by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_files(df: DataFrame, folder: str, path: str = "path", content: str = "text", overwrite: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Writes `content` (text or bytes) of each row to `folder`/`path`; the manifest: path, bytes and the row's `keep` columns.

    A file is written under a name of its own and then renamed, so readers see it whole, and a task that is
    repeated only writes the same again. Paths must differ; if not, the folder is emptied again. If the folder has files already it is an error unless `overwrite`,
    which replaces the folder. A null content is an empty file. An empty table writes nothing.
    """
    from pyarrow import fs

    files, root = filesystem(folder)
    if files.get_file_info(root).type == fs.FileType.Directory and files.get_file_info(fs.FileSelector(root)):
        if not overwrite:
            raise FileExistsError(f"{folder} has files already; overwrite to write it anew")
        files.delete_dir_contents(root)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        made = set()
        for batch in batches:
            done, sizes = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                at = f"{root}/{name}"
                inside = at.rsplit("/", 1)[0]
                if inside not in made:
                    files.create_dir(inside, recursive=True)
                    if len(made) > 10_000:
                        made.clear()
                    made.add(inside)
                beside = f"{at}.{uuid.uuid4().hex[:12]}"
                with files.open_output_stream(beside, compression=None) as out:
                    out.write(data)
                files.move(beside, at)
                done.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(sizes, pa.int64()), *batch.columns[2:]], names=["path", "bytes", *keep])

    rows = df.select(F.col(path), F.col(content).cast("binary").alias("_content"), *keep)
    schema = StructType([*WRITTEN, *(df.schema[c] for c in keep)])
    manifest = written(small_batches(rows).mapInArrow(run, schema), "files")
    twice = manifest.groupBy("path").count().where("count > 1").limit(1).collect()  # of the manifest, so the rows are made only once
    if twice:
        files.delete_dir_contents(root)
        raise ValueError(f"two rows for {twice[0][0]}")
    return manifest


def raw_name(index: Column, title: Column) -> Column:
    """The file of a raw chapter: its number and the slug of its title."""
    return F.format_string("raw/chapters/%04d-%s.txt", index, text.slug(title))


def raw_files(chapters: DataFrame) -> DataFrame:
    """book, index, title, href, path and text of raw chapters (book, idx, title, href, text) as they are written."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.format_string("Chapter %d", "idx"))
    return chapters.select("book", F.col("idx").alias("index"), title.alias("title"), "href", raw_name(F.col("idx"), title).alias("path"), F.concat(F.regexp_replace("text", "\\s+$", ""), F.lit("\n")).alias("text"))


def contents(entries: DataFrame, fields: list[str], head: list[str] = [], path: str = "toc.json") -> DataFrame:
    """The JSON table of contents of each book: its `head` columns and `chapters`, the `fields` of its entries by index."""
    listed = F.array_sort(F.collect_list(F.struct("index", *(c for c in fields if c != "index"))))
    whole = entries.groupBy("book", *head).agg(listed.alias("chapters"))
    return whole.select("book", F.lit(path).alias("path"), F.to_json(F.struct(*head, "chapters")).alias("text"))


def chunk_files(chunks: DataFrame, book: str, chapter: str, place: str, chunk: str) -> DataFrame:
    """path and text of the chunks of chapters: one file a chunk, numbered from 1 in its chapter's folder."""
    return chunks.select(F.concat_ws("/", F.col(book), F.lit("chunks"), F.col(chapter), F.format_string("%06d.txt", F.col(place))).alias("path"), F.col(chunk).alias("text"))


def stale_chunks(before: DataFrame, now: DataFrame) -> DataFrame:
    """The paths of earlier chunk files that are no longer written: higher numbers of chapters that got shorter."""
    return before.select("path").join(now.select("path").distinct(), "path", "left_anti")


def in_books(files: DataFrame) -> DataFrame:
    """Files of books with the book's folder before their path."""
    return files.withColumn("path", F.concat_ws("/", F.col("book").cast("string"), "path"))

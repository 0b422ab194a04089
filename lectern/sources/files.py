"""Books, documents and recordings as files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lectern.functions import text
from lectern.session import small_batches


def suffix_kind(path: Column) -> Column:
    """What a path's suffix tells to read it as: epub, txt, or unsupported."""
    low = F.lower(path)
    return F.when(F.endswith(low, F.lit(".epub")), "epub").when(F.endswith(low, F.lit(".txt")), "txt").otherwise("unsupported")


def text_books(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """A book of one chapter for each text file (its path and whole text): source, book_title, index, title, path, text.

    The title is told by the file's name; white space at the text's end becomes one newline.
    """
    title = text.file_title(F.col(path))
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("Chapter 1"))
    return files.select(
        F.col(path).alias("source"), F.coalesce(F.nullif(title, F.lit("")), F.lit("Text")).alias("book_title"), F.lit(1).alias("index"), named.alias("title"),
        F.format_string("raw/chapters/%04d-%s.txt", F.lit(1), text.slug(named)).alias("path"), F.concat(F.regexp_replace(value, "\\s+$", ""), F.lit("\n")).alias("text"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and value, the whole text, of each text file; a file is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_named(manifest: DataFrame, folder: str, path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, the manifest's `keep` columns and content, the bytes, of the files in `folder` that it names: tasks open them by name, so no folder is listed, and a small file isn't planned as a task's share."""
    from lectern.sinks.files import filesystem

    rows = manifest.select(F.col(path).alias("path"), *keep)
    columns = [*rows.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        for batch in batches:
            said, size, names = [], 0, batch.column(0).to_pylist()
            for k, name in enumerate(names, 1):
                with files.open_input_file(f"{root}/{name}") as source:
                    said.append(source.readall())
                size += len(said[-1])
                if size > 4 << 20 or k == len(names):
                    yield pa.RecordBatch.from_arrays([*batch.slice(k - len(said), len(said)).columns, pa.array(said, pa.binary())], names=columns)
                    said, size = [], 0

    return small_batches(rows.repartition(3 * manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, StructType([*rows.schema, StructField("content", BinaryType())]))


def text_chapters(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """A file's clean text as its only chapter: index, id, title (the file's stem), text, path."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)[.][^.]*$", "")
    title = F.coalesce(F.nullif(stem, F.lit("")), F.lit("text"))
    return files.select(F.lit(1).alias("index"), F.format_string("%04d-%s", F.lit(1), text.slug(title)).alias("id"), title.alias("title"), text.clean_file_text(F.col(value)).alias("text"), path)


def json_document(document: Column, schema: str, strict: bool = False) -> Column:
    """An object by `schema`; with nothing there its fields are null. What isn't an object is an error if `strict`, else nothing."""
    is_object = F.startswith(F.trim(document), F.lit("{"))
    given = F.when(is_object, document)
    if strict:
        given = F.when(document.isNull() | is_object, document).otherwise(F.raise_error(F.lit("not a JSON object")).cast("string"))
    return F.from_json(F.coalesce(given, F.lit("{}")), schema)


def voice_map(document: Column) -> Column:
    """default and chapters (chapter id to voice) of a voice map; chapters that aren't an object are none."""
    said = json_document(document, "default string, chapters string", strict=True)
    chapters = F.when(F.startswith(F.trim(said["chapters"]), F.lit("{")), F.from_json(said["chapters"], "map<string,string>"))
    return F.struct(said["default"].alias("default"), F.coalesce(chapters, F.create_map().cast("map<string,string>")).alias("chapters"))


GENDERS = ("female", "male")


def voice_genders(document: Column) -> Column:
    """Gender by voice of a library's voice metadata: of voices in the voices folder, given plainly or as an object."""
    said = F.coalesce(F.from_json(F.when(F.startswith(F.trim(document), F.lit("{")), document), "map<string,string>"), F.create_map().cast("map<string,string>"))
    gender = lambda v: F.lower(F.trim(F.when(F.startswith(F.trim(v), F.lit("{")), F.get_json_object(v, "$.gender")).otherwise(v)))
    clean = F.transform_values(said, lambda k, v: gender(v))
    return F.map_filter(clean, lambda k, v: F.regexp_like(k, F.lit("^voices/[^/]+[.]wav$")) & v.isin(*GENDERS))


def stored_voice(value: Column, root: Column, default: str = "default-voice") -> Column:
    """A voice as it is kept: nothing for blanks, the default's id for `default`, and paths in the library relative to it."""
    name, inside = F.trim(F.coalesce(value, F.lit(""))), F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.lower(name) == "default", F.lit(default)).when(F.startswith(name, inside), F.substring(name, F.length(inside) + 1, F.length(name))).otherwise(name)


def within(path: Column, root: Column) -> Column:
    """Whether a path, its `.` and `..` resolved, lies in the root (absolute, resolved) or is it."""
    step = lambda out, p: F.when((p == "") | (p == "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path))
    parts = lambda x: F.aggregate(F.split(x, "/"), F.array().cast("array<string>"), step)
    mine, base = parts(full), parts(root)
    return F.slice(mine, F.lit(1), F.size(base)) == base


def library_books(files: DataFrame, path: str = "path") -> DataFrame:
    """The books of a library, from the paths in it: folders with a clean table of contents, but for the merge folder."""
    book = F.regexp_extract(path, "([^/]+)/clean/toc[.]json$", 1)
    return files.select(book.alias("book")).where((F.col("book") != "") & (F.col("book") != "_m4b")).distinct()


WAV = "channels int, sample_bytes int, rate int, frames long"


def _wav(raw: bytes) -> dict | None:
    """The header of a RIFF WAVE recording; None if it isn't one."""
    if raw is None or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"fmt " and at + 24 <= len(raw):
            fmt = struct.unpack_from("<HHIIHH", raw, at + 8)
        if kind == b"data":
            if fmt is None or fmt[0] not in (1, 0xFFFE) or not fmt[1] or not (fmt[5] + 7) // 8:
                return None
            width = (fmt[5] + 7) // 8
            return {"channels": fmt[1], "sample_bytes": width, "rate": fmt[2], "frames": size // (width * fmt[1])}
        at += 8 + size + size % 2
    return None


def wav_header(content: Column) -> Column:
    """channels, sample_bytes, rate and frames of a recording's bytes (its beginning is enough), or null."""

    @F.pandas_udf(WAV)
    def run(raw: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("channels", "sample_bytes", "rate", "frames"))
        return pd.DataFrame([_wav(x) or none for x in raw], columns=list(none)).astype({"channels": "Int32", "sample_bytes": "Int32", "rate": "Int32", "frames": "Int64"})

    found = run(content)
    return F.when(found["frames"].isNotNull(), found)


def wav_duration(header: Column) -> Column:
    """Milliseconds, half to even."""
    return F.when(header["rate"] > 0, F.bround(header["frames"] * 1000.0 / header["rate"]).cast("long")).otherwise(F.when(header.isNotNull(), 0))


def is_valid_wav(header: Column) -> Column:
    """Mono, two bytes a sample, and not empty."""
    return F.coalesce((header["channels"] == 1) & (header["sample_bytes"] == 2) & (header["frames"] > 0), F.lit(False))

"""EPUB files as tables: a book's package is parsed in Arrow batches, and its parts become rows.

A book is a zip of small files, so one book is the unit of work; a library of any size is many tasks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import small_batches, written
from lectern.sources import files

BOOK = (
    "book_id string, error string, metadata struct<title: string, cover: string, year: string, dates: array<string>, language: string, authors: array<string>>, "
    "items array<struct<item_id: string, href: string, media_type: string, content: binary>>, spine array<string>, toc array<struct<title: string, href: string>>"
)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _cover(metas: list[dict], items: list[dict]) -> str | None:
    """The cover's link: a cover property, the named cover item, an image called cover, else the largest image."""
    images = [i for i in items if i["media_type"].startswith("image/")]
    named = next((m.get("content") for m in metas if m.get("name") == "cover"), None)
    tries = (
        (i for i in items if "cover-image" in i["properties"].split()),
        (i for i in images if i["item_id"] == named),
        (i for i in images if i["item_id"].lower() == "cover"),
        (i for i in images if "cover" in i["href"].lower()),
        iter(sorted(images, key=lambda i: -len(i["content"] or b""))),
    )
    return next((i["href"] for t in tries for i in t), None)


def parse(raw: bytes) -> dict:
    """The parts of one book; links are relative to the package's folder."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        folder = posixpath.dirname(package)
        root = ElementTree.fromstring(z.read(package))
        place = lambda href: posixpath.normpath(posixpath.join(folder, unquote(href)))
        items = []
        for e in root.iter():
            if _local(e.tag) == "item":
                href = unquote(e.get("href", ""))
                items.append({"item_id": e.get("id", ""), "href": href, "media_type": e.get("media-type", ""), "properties": e.get("properties", ""), "content": z.read(place(href)) if place(href) in names else None})
        spine = [e.get("idref", "") for e in root.iter() if _local(e.tag) == "itemref"]
        said: dict[str, list[str]] = {}
        for e in root.iter():
            if _local(e.tag) in ("title", "creator", "language", "date") and (e.text or "").strip():
                said.setdefault(_local(e.tag), []).append(e.text.strip())
        metas = [dict(e.attrib) for e in root.iter() if _local(e.tag) == "meta"]
        toc = []
        ncx = next((i for i in items if i["media_type"] == "application/x-dtbncx+xml" and i["content"]), None)
        nav = next((i for i in items if "nav" in i["properties"].split() and i["content"]), None)
        if ncx:
            for point in ElementTree.fromstring(ncx["content"]).iter():  # in document order, so nested points follow their parent
                if _local(point.tag) == "navPoint":
                    label = next((t.text or "" for c in point if _local(c.tag) == "navLabel" for t in c if _local(t.tag) == "text"), "")
                    src = next((c.get("src", "") for c in point if _local(c.tag) == "content"), "")
                    if src:
                        toc.append({"title": label.strip(), "href": src})
        elif nav:
            from lectern.functions.html import tree

            toc = [{"title": " ".join(a.text().split()), "href": a.attrs["href"]} for a in tree(nav["content"].decode("utf-8", "replace")).walk() if a.name == "a" and a.attrs.get("href")]
        dates = said.get("date", [])
        year = next((m[0] for d in dates if (m := re.search(r"\d{4}", d))), "")
        return {
            "metadata": {"title": (said.get("title") or [""])[0], "cover": _cover(metas, items), "year": year, "dates": dates, "language": (said.get("language") or [""])[0], "authors": said.get("creator", [])},
            "items": [{k: i[k] for k in ("item_id", "href", "media_type", "content")} for i in items], "spine": spine, "toc": toc,
        }


def books(raw: DataFrame) -> DataFrame:
    """A row a file of a table with path and content; one that isn't a book has its `error` and no parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                row = {"book_id": path, "error": None, "metadata": None, "items": [], "spine": [], "toc": []}
                try:
                    row |= parse(bytes(content))
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=["book_id", "error", "metadata", "items", "spine", "toc"])

    return small_batches(raw.select("path", "content")).mapInPandas(run, BOOK)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The books of a folder, parsed once: a table, as its items, spine and contents are each read from it."""
    return written(books(spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(path)), "books")


def read_named(manifest: DataFrame, folder: str) -> DataFrame:
    """`read` of the books in `folder` that a manifest names; `book_id` is the manifest's path."""
    return written(books(files.read_named(manifest, folder)), "books")


def items(df: DataFrame) -> DataFrame:
    return df.select("book_id", F.explode("items").alias("i")).select("book_id", "i.*")


def spine(df: DataFrame) -> DataFrame:
    return df.select("book_id", F.posexplode("spine").alias("pos", "item_id"))


def toc(df: DataFrame) -> DataFrame:
    return df.select("book_id", F.posexplode("toc").alias("pos", "t")).select("book_id", "pos", "t.title", "t.href")

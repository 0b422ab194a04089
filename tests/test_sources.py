import io
import zipfile

from pyspark.sql import functions as F

from lectern.operators import chapters
from lectern.sources import epub, jsonl, overrides

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Small Book</dc:title><dc:creator>A. Writer</dc:creator><dc:date>c. 1899</dc:date><meta name="cover" content="img"/></metadata>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="t/a_split_000.html" media-type="application/xhtml+xml"/><item id="b" href="t/a_split_001.html" media-type="application/xhtml+xml"/><item id="c" href="t/c.html" media-type="application/xhtml+xml"/><item id="n" href="t/notes.html" media-type="application/xhtml+xml"/><item id="img" href="x.png" media-type="image/png"/></manifest>
<spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/><itemref idref="n"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Start</text></navLabel><content src="t/a_split_000.html#p"/><navPoint><navLabel><text>a_split_001.html</text></navLabel><content src="t/c.html"/></navPoint></navPoint><navPoint><navLabel><text>Again</text></navLabel><content src="t/c.html#x"/></navPoint></navMap></ncx>"""


def book(toc=True):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", OPF)
        if toc:
            z.writestr("O/toc.ncx", NCX)
        z.writestr("O/t/a_split_000.html", "<html><body><h1>One</h1><p>Text<a href='notes.html#n1'>1</a> here.</p></body></html>")
        z.writestr("O/t/a_split_001.html", "<html><body><p>More of it.</p></body></html>")
        z.writestr("O/t/c.html", "<html><body><p>Found title, in words.</p></body></html>")
        z.writestr("O/t/notes.html", "<html><body><h2>Notes</h2><p id='n1'><a href='a_split_000.html#r1'>1</a> a note</p></body></html>")
        z.writestr("O/x.png", b"png")
    return raw.getvalue()


def test_books_and_chapters(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(book())
    (tmp_path / "two.EPUB").write_bytes(book(toc=False))
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    df = epub.read(spark, str(tmp_path)).cache()
    rows = {r.book_id.rsplit("/", 1)[1]: r for r in df.collect()}
    assert set(rows) == {"one.epub", "two.EPUB", "bad.epub"} and rows["bad.epub"].error and not rows["one.epub"].error
    meta = rows["one.epub"].metadata
    assert (meta.title, meta.authors, meta.year, meta.cover) == ("Small Book", ["A. Writer"], "1899", "x.png")
    got = {(r.book_id.rsplit("/", 1)[1], r.idx): (r.title, r.href, r.text) for r in chapters.extracted(epub.items(df), epub.spine(df), epub.toc(df)).collect()}
    assert got == {
        ("one.epub", 1): ("Start", "t/a_split_000.html#p", "One\n\n\n\n\nText here.\n\nMore of it."),
        ("one.epub", 2): ("Found title, in words", "t/c.html", "Found title, in words."),
        ("two.EPUB", 1): ("One", "t/a_split_000.html", "One\n\n\n\n\nText here."),
        ("two.EPUB", 2): ("More of it", "t/a_split_001.html", "More of it."),
        ("two.EPUB", 3): ("Found title, in words", "t/c.html", "Found title, in words."),
        ("two.EPUB", 4): ("Notes", "t/notes.html", "Notes"),
    }


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \nnull\n {"b": "x", "a": null}\n')
    assert sorted(map(str, jsonl.read(spark, str(tmp_path / "log.jsonl"), "a long, b string").collect())) == ["Row(a=1, b=None)", "Row(a=None, b='x')"]
    jsonl.append(spark.range(3), str(tmp_path / "out"))
    jsonl.append(spark.range(2), str(tmp_path / "out"))
    assert jsonl.read(spark, str(tmp_path / "out"), "id long").count() == 5


def test_override_lines(spark):
    rows = spark.createDataFrame([("a = b",), ("# c = d",), ("e＝f = g",), ("",), (None,), ("= x",)], "line string")
    assert [(r.base, r.reading) for r in overrides.parsed_lines(rows, "line").collect()] == [("a", "b"), ("e", "f = g")]


def test_title_pages(spark):
    row = spark.range(1).select(chapters.title_page(F.lit("A : B"), F.array(F.lit("x"), F.lit(" "), F.lit("y"))).alias("p")).first()
    assert row.p == "A: B\n\nby x, y"

"""Operators whose work is spread over rows and files, against plain versions of them."""

import random

import pytest

from lectern import session
from lectern.operators import assembly, chapters, snippets, tracking
from lectern.queries import QUERIES
from lectern.sinks import files as sinks
from lectern.sources import epub, files, overrides

from .test_sources import book


def test_snippets_across_texts(spark):
    rng = random.Random(3)
    books = {b: ["".join(rng.choice("abé\n") for _ in range(rng.choice((0, 1, 3, 40, 700)))) for _ in range(60)] for b in ("x", "y", "z")}
    texts = [(b, i, t) for b, own in books.items() for i, t in enumerate(own)] + [("x", 1000, None), (None, 1, "abababab"), ("nulls", 1, None)]
    whole = {b: "\n".join(own) for b, own in books.items()}
    asked = [None, "", "a", "no such words in it"]
    for b in books:
        for n in (1, 5, 9, 60, 200):
            asked += [whole[b][k : k + n] for k in (0, len(whole[b]) - n, *(rng.randrange(len(whole[b]) - n) for _ in range(12)))]
            asked += [asked[-1][:-1] + "q"]
    items = [(i, b, s) for i, (b, s) in enumerate((b, s) for b in ("x", "y", "z", "nulls", "none", None) for s in asked)]
    want = {i for i, b, s in items if b not in books or s is not None and s not in whole[b]}
    for parts in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == "4")
        try:
            rows = spark.createDataFrame(texts, "book string, at long, text string").repartition(7)
            got = snippets.absent_texts(spark.createDataFrame(items, "item int, book string, s string"), rows, "book", ["at"], "s", "text").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(r.item for r in got) == sorted(want)


def test_contents_deep_wide_and_astray(spark):
    edges = [(1, None), (2, None)] + [(k, k - 1) for k in range(10, 160)] + [(9, 1)] + [(1000 + k, 2) for k in range(50)] + [(200, 201), (201, 200), (300, 300), (400, 999), (401, 400)]
    want = {(1, 1, 0), (2, 2, 0)} | {(k, 1, k - 8) for k in range(9, 160)} | {(1000 + k, 2, 1) for k in range(50)}
    got = assembly.flattened(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = assembly.flattened(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), "a", "b")
    assert none.columns == ["id", "root", "depth"] and not none.collect()
    with pytest.raises(ValueError):
        assembly.flattened(spark.createDataFrame([(1, None), (1, 2), (2, 1)], "a long, b long"), "a", "b")
    assert assembly.flattened(spark.range(1_200_000).selectExpr("id", "CASE WHEN id > 20 THEN id DIV 1000 END AS up"), "id", "up").count() == 1_200_000


def test_global_overrides_are_sorted_once(spark):
    chapters, rules = spark.createDataFrame([(1,), (2,), (3,)], "c long"), spark.createDataFrame([(9, None), (4, None), (7, 2), (5, 2), (6, 8)], "v long, s long")
    made = overrides.by_chapter(chapters, rules, "c", "s", "v", "out")
    assert {r.c: r.out for r in made.collect()} == {1: [4, 9], 2: [4, 5, 7, 9], 3: [4, 9]}
    assert "array_sort(" not in made._jdf.queryExecution().optimizedPlan().toString() and "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()
    own = overrides.by_chapter(chapters, rules.where("s IS NOT NULL"), "c", "s", "v", "out")
    assert {r.c: r.out for r in own.collect()} == {2: [5, 7]}
    assert not overrides.by_chapter(chapters, rules.where("false"), "c", "s", "v", "out").collect()


def test_files_are_read_by_their_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 7}/{k}.txt", f"é{k}" * 10) for k in range(300)] + [("none.txt", None)], "path string, text string")
    made = sinks.write_files(rows, f"file://{tmp_path}/a")
    (tmp_path / "a/other.txt").write_text("not in the manifest")
    got = {r.path: bytes(r.content).decode() for r in files.read_named(made, f"file://{tmp_path}/a").collect()}
    assert got == {r.path: r.text or "" for r in rows.collect()}
    with pytest.raises(ValueError):
        sinks.write_files(rows.union(rows), f"file://{tmp_path}/b")
    assert not list((tmp_path / "b").iterdir())


def test_books_are_parsed_once(spark, tmp_path):
    rows = spark.createDataFrame([("a/one.epub", book()), ("two.epub", book(toc=False)), ("bad.epub", b"no zip")], "path string, text binary")
    made = sinks.write_files(rows, f"file://{tmp_path}")
    (tmp_path / "other.epub").write_bytes(book())  # not in the manifest
    for read in (epub.read_named(made, f"file://{tmp_path}"), epub.read(spark, str(tmp_path))):
        parts = chapters.extracted(epub.items(read), epub.spine(read), epub.toc(read))
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "MapIn" not in plan and "note_facts" not in plan and plan.count("ArrowEvalPython") == 1
        names = {r.book_id.rsplit("/", 1)[-1]: r.error for r in read.collect()}
        assert names["bad.epub"] and ("other.epub" in names) == (len(names) == 4)
        got = sorted((r.book_id.rsplit("/", 1)[-1], r.idx, r.href) for r in parts.collect() if not r.book_id.endswith("other.epub"))
        assert got == [("one.epub", 1, "t/a_split_000.html#p"), ("one.epub", 2, "t/c.html"), *(("two.epub", k, f"t/{n}.html") for k, n in enumerate(("a_split_000", "a_split_001", "c", "notes"), 1))]


def test_rows_keep_their_columns_through_files(spark, sf, tmp_path):
    rows = spark.createDataFrame([(f"{k % 3}/a b%20é{k}.txt", "ß" * k, k, [k]) for k in range(30)] + [("none.txt", None, None, None)], "path string, text string, n int, l array<int>")
    made = sinks.write_files(rows, f"file://{tmp_path}/a", keep=("n", "l"))
    got = files.read_named(made, f"file://{tmp_path}/a", keep=("l", "n")).selectExpr("path", "string(content) AS text", "n", "l").collect()
    assert sorted(map(str, got)) == sorted(str(r).replace("text=None", "text=''") for r in rows.collect())
    assert not sinks.write_files(rows.where("false"), f"file://{tmp_path}/b", keep=("n",)).collect()
    for name in ("k2_clean_files", "s2_text_books"):  # no folder is listed, and k2's texts are cleaned once
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "Join" not in plan and "repair" not in plan


def test_pauses_of_books_in_many_tasks(spark, monkeypatch):
    rng = random.Random(5)
    chunks = [(b, c, p, rng.choice((None, 1, 3, 7))) for b in (None, 1, 2, 3) for c in (None, *range(1, 60)) for p in range(rng.randint(1, 4))] + [(4, None, 0, 1), (5, 1, 0, 1)]
    finals = {b: max((c for x, c, *_ in chunks if x == b and c is not None), default=None) for b, *_ in chunks}
    lasts = {(b, c): max(p for x, y, p, _ in chunks if (x, y) == (b, c)) for b, c, *_ in chunks}
    longer = lambda b, c, p: c is not None and c != finals[b] and lasts[b, c] == p
    want = {(b, c, p): max(v or 0, 5) if longer(b, c, p) else v for b, c, p, v in chunks}
    got = tracking.boundary_pauses(spark.createDataFrame(chunks, "book int, chapter int, line int, pause int"), "book", "chapter", "line", "pause")
    assert got.columns == ["book", "chapter", "line", "pause"]
    assert {(r.book, r.chapter, r.line): r.pause for r in got.collect()} == want and got.count() == len(chunks)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # none over a whole book; those over chapters are in a table

    monkeypatch.setattr(session, "TASK_ROWS", 1_000)
    left, right = spark.range(9_500), spark.range(0, 9_500, 3).withColumnRenamed("id", "k")
    a, b = session.by_key((left, "id"), (right, "k"))
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 10 and a.join(b, a.id == b.k).count() == 3_167
    a, b = session.by_key((right, "k"), (left, "id"))
    assert a is right and b is left

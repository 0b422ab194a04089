"""Quality rules: statistics of a text's words, and lines that recur across the documents of a host.

A line is normalised (A-Z lowered, white space collapsed) and hashed. It is frequent on its host when it
is in more than MIN_DOCS distinct documents there, however large the host is. Documents with equal lines
throughout count once, so a text that was crawled a thousand times doesn't make its own lines frequent. Frequent
lines are removed from every document of the host; one that loses more than half of its words so is
depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, rows_of, small_batches
from lectern.llm.kernels import Words, sums, text_bytes, xxh64
from lectern.plans.skew import salted_lookup
from lectern.session import written

#: A line is frequent in more than MIN_DOCS documents of its host.
MIN_DOCS = 5
#: A document that keeps less than this part of its words is depleted.
LEAST_KEPT = 0.5
#: Frequent lines that may be broadcast, with their hosts; beyond it they are joined by a shuffle.
BROADCAST_LINES = 200_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, removed_lines long, removed_words long, kept boolean, clean_text string"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _by_line(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The lower-cased words by line, the lines' hashes (0: no words), and the number of lines of each text."""
    breaks = np.flatnonzero(raw == 10)
    # a line ends at a break or at its text's end; texts that end in a break have an empty last line
    ends = np.concatenate([breaks + 1, offsets[1:]])
    text = np.concatenate([np.searchsorted(offsets[1:], breaks, side="right"), np.arange(len(offsets) - 1)])
    order = np.lexsort((np.arange(len(ends)) >= len(breaks), ends, text))
    ends = ends[order]
    words = Words(raw, np.concatenate([[0], ends]))
    some = np.flatnonzero(words.count)
    hashes = np.zeros(len(ends), np.int64)
    first, last = words.first[some], words.first[some] + words.count[some] - 1
    hashes[some] = xxh64(words.buffer, words.at[first], words.at[last] + words.size[last] - words.at[first]).view(np.int64)
    return words, hashes, np.bincount(text, minlength=len(offsets) - 1)


def _documents(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of all lines of each text, and its distinct line hashes."""
    _, hashes, many = _by_line(*text_bytes(texts))
    ends = np.cumsum(many)
    lists, ids = [], []
    for a, b in zip(ends - many, ends):
        own = hashes[a:b]
        own = own[own != 0]
        ids.append(xxh64(own.view(np.uint8), np.zeros(1, np.int64), np.array([8 * len(own)]))[0])
        lists.append(np.unique(own))
    return np.array(ids, np.uint64).view(np.int64), lists


def _with_document(rows: DataFrame) -> DataFrame:
    """`rows` with `doc`, the hash of their lines, and `_row`, a number that differs among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in rows_of(batches):
            ids, _ = _documents(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids), pa.array(row + np.arange(len(ids)))], names=[*batch.schema.names, "doc", "_row"])
            row += len(ids)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", doc long, _row long")


def line_hashes(docs: DataFrame) -> DataFrame:
    """host, doc (a hash of all lines of the document) and lines (its distinct line hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            ids, lists = _documents(batch.column("text"))
            lengths = np.array([len(x) for x in lists])
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(ids), column], names=["host", "doc", "lines"])

    hosts = F.coalesce(F.col("source"), F.lit("")).alias("host")
    return doc_texts(docs, hosts).drop("doc_id").mapInArrow(run, "host string, doc long, lines array<long>")


def seen_lines(docs: DataFrame) -> DataFrame:
    """host, doc, line and n, the rows of `docs` with that host and document, for the lines of each document."""
    lines = line_hashes(docs).select("host", "doc", F.explode("lines").alias("line"))
    return written(lines.groupBy("host", "doc", "line").agg(F.count("*").alias("n")), "lines")


def frequent_lines(seen: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """host, line and in_docs of the lines of `seen_lines` in more than `min_docs` distinct documents of a host."""
    return written(seen.groupBy("host", "line").agg(F.count("*").alias("in_docs")).where(F.col("in_docs") > min_docs), "frequent-lines")


def _by_document(seen: DataFrame, often: DataFrame) -> DataFrame:
    """_key (of host and document), `frequent`, the document's own frequent lines, and n, its rows.

    A line that very many documents share is spread over tasks; a document's list is never longer than itself."""
    key = F.concat_ws(":", F.hex("line"), "host")
    lines = often.select(key.alias("_line"), F.lit(True).alias("_often"), F.col("in_docs").alias("_weight"))
    found = salted_lookup(seen.withColumn("_line", key), lines, "_line", "_weight", max(1, seen.count()), F.col("doc")).where("_often")
    return found.groupBy(_document_key().alias("_key")).agg(F.collect_list("line").alias("frequent"), F.max("n").alias("n"))


def _document_key() -> Column:
    return F.concat_ws(":", F.hex("doc"), "host")


def measure(column: pa.Array, often: list[np.ndarray | None], least_kept: float = LEAST_KEPT) -> list[pa.Array]:
    """The MEASURES of texts, given the hashes of the lines that are frequent on each one's host."""
    raw, offsets = text_bytes(column)
    texts = len(offsets) - 1
    words = Words(raw, offsets, lower=False)
    n_words = words.count
    black = np.ones(len(raw) + 1, np.int64)
    black[:-1] = ((raw & 0xC0) != 0x80) & (raw != 32) & ((raw < 9) | (raw > 13))
    per = lambda flags: (lambda total: total[offsets[1:]] - total[offsets[:-1]])(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
    word_chars, n_symbols = per(black[:-1]), per(_SYMBOLS[raw])

    # words of 3-word windows that are found twice or more in their text
    covered = np.zeros(len(words.at) + 2, bool)
    windows = np.maximum(n_words - 2, 0)
    total = int(windows.sum())
    if total:
        h = words.hashes()
        index = np.arange(total) + np.repeat(words.first - (np.cumsum(windows) - windows), windows)
        with np.errstate(over="ignore"):
            mixed = h[index] * np.uint64(0x9E3779B185EBCA87) + np.roll(h, -1)[index]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.roll(h, -2)[index]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x165667B19E3779F9) + np.repeat(np.arange(texts, dtype=np.uint64), windows) * np.uint64(0x85EBCA77C2B2AE63)
        order = np.argsort(mixed)
        same = mixed[order][1:] == mixed[order][:-1]
        twice = np.zeros(total, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[index[twice] + k] = True
    n_repeat = sums(covered[: len(words.at)].astype(np.int64), n_words)

    line_words, hashes, many = _by_line(raw, offsets)
    dup, removed_lines, removed_words, clean = [], np.zeros(texts, np.int64), np.zeros(texts, np.int64), column.to_pylist()
    begins = np.cumsum(many) - many
    for i, frequent in enumerate(often):
        lines = None
        own = hashes[begins[i] : begins[i] + many[i]]
        # equal lines have equal hashes, so only texts with a repeated hash are looked at line by line
        if len(own) - np.count_nonzero(own == 0) == len(np.unique(own[own != 0])):
            dup.append(0)
        else:
            lines = [x for x, h in zip(clean[i].split("\n"), own) if h]
            dup.append(len(lines) - len(set(lines)))
        if frequent is not None:
            out = np.isin(own, frequent) & (own != 0)
            if out.any():
                removed_lines[i] = out.sum()
                removed_words[i] = line_words.count[begins[i] : begins[i] + many[i]][out].sum()
                clean[i] = "\n".join(x for x, gone in zip(clean[i].split("\n"), out) if not gone)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (n_words - removed_words >= least_kept * n_words)
    return [pa.array(np.asarray(x)) for x in (n_words, word_chars, n_symbols, np.array(dup, np.int64), n_repeat, failed, removed_lines, removed_words, kept)] + [pa.array(clean, pa.string())]


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, least_kept: float = LEAST_KEPT, keep: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """doc_id, the columns `keep` and MEASURES for every row of `docs`; without `text`, clean_text is null.

    `clean_text` is the text without its host's frequent lines. A null text has no words and fails the
    base rules; a null source is the host "". Lines without words are never frequent or repeated. Rows that repeat a doc_id are judged each
    for itself, and equal rows get equal verdicts. An empty table gives no rows. Up to BROADCAST_LINES frequent lines are sent
    to all tasks once, and texts stay where they are; more are joined to the documents, whose copies are spread by row.
    """
    seen = seen_lines(docs)
    often = frequent_lines(seen, min_docs)
    host = F.coalesce(F.col("source"), F.lit(""))
    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"), host.alias("host"), *(F.col(c).alias(f"_keep_{c}") for c in keep)))
    shared = None
    if often.count() <= BROADCAST_LINES:
        got = often.orderBy("host").toArrow()
        hosts, line = got.column("host").to_pylist(), got.column("line").to_numpy()
        edges = [i for i in range(len(hosts)) if not i or hosts[i] != hosts[i - 1]] + [len(hosts)]
        shared = docs.sparkSession.sparkContext.broadcast({hosts[a]: line[a:b] for a, b in zip(edges, edges[1:])})
    else:
        rows = _with_document(rows).withColumn("_key", _document_key())
        rows = salted_lookup(rows, _by_document(seen, often), "_key", "n", max(1, docs.count()), F.col("_row")).drop("_key", "_row", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            if shared is not None:
                lines = [shared.value.get(h) for h in batch.column("host").to_pylist()]
            else:
                lines = [None if x is None else np.array(x, np.int64) for x in batch.column("frequent").to_pylist()]
            found = measure(batch.column("text"), lines, least_kept)
            if not text:
                found[-1] = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), *(batch.column(f"_keep_{c}") for c in keep), *found], names=["doc_id", *keep, *_NAMES])

    kinds = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in keep)
    return rows.mapInArrow(run, f"doc_id long{kinds}, {MEASURES}")

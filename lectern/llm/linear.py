"""Hashed text features and the linear models over them.

Features of a text are its distinct lower-cased words, the distinct 4- and 5-byte grams of these, their
first 5 and 7 bytes, and a few binned shape statistics, hashed into BITS bits. Models are fitted in numpy on
the driver from at most SAMPLE labelled documents, chosen by the hash of their id; scoring covers every
document. Each model is the one minimum of a convex function, a mean log loss with a ridge, found by L-BFGS,
over the features whose rates differ between the classes by LEAST_Z standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, rows_of
from lectern.llm.kernels import Words, sums, text_bytes
from lectern.session import written

BITS = 20
#: Labelled documents that a model is fitted on, at the most.
SAMPLE = 4_000
#: Features of fewer sample documents have no weight.
LEAST_DOCS = 4
#: So have features whose rates in the classes differ by fewer standard errors: chance makes such differences.
LEAST_Z = 2.0
#: Weight of the squared weights (of log-odds-scaled features) against the mean loss of a document.
RIDGE = 1e-5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _hashed(keys: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ np.uint64(kind * 0x51ED27)) * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << BITS) | key)
    return both >> BITS, both & ((1 << BITS) - 1)


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of each text, one text's after the other's, and how many each has.

    With `wanted`, a flag for each feature number, the others are left out before any sorting.
    """
    words = Words(*text_bytes(texts))
    many = len(texts)
    doc = np.repeat(np.arange(many), words.count)
    if not len(doc):
        shapes = np.zeros(many, np.uint64)
        key, doc = _hashed(shapes, 7), np.arange(many)
        kept = np.ones(many, bool) if wanted is None else wanted[key]
        return key[kept], np.bincount(doc[kept], minlength=many)
    h = words.hashes()
    with np.errstate(over="ignore"):
        own = h ^ (doc.astype(np.uint64) * _MIX)
    _, first = np.unique(own, return_index=True)
    doc_of, at, size = doc[first], words.at[first], words.size[first]
    docs, keys = [doc_of], [_hashed(h[first], 1)]
    data = words.buffer.tobytes() + bytes(8)
    w8 = np.ndarray((len(data) - 8 + 1,), "<u8", data, strides=(1,))
    for n in (4, 5):
        grams = np.maximum(size - n + 1, 0)
        total = int(grams.sum())
        place = np.arange(total) + np.repeat(at - (np.cumsum(grams) - grams), grams)
        docs.append(np.repeat(doc_of, grams))
        keys.append(_hashed(w8[place] & np.uint64((1 << 8 * n) - 1), n))
    w8_before = np.ndarray((len(data) - 8 + 1,), "<u8", b" " + data, strides=(1,))
    for n in (5, 7):  # a word's beginning, with the space before it
        long = size >= n
        docs.append(doc_of[long])
        keys.append(_hashed(w8_before[at[long]] & np.uint64((1 << 8 * (n + 1)) - 1 if n < 7 else 2**64 - 1), 20 + n))
    # shape: length, share of distinct words, share of signs
    kinds = np.bincount(doc_of, minlength=many)
    signs = np.concatenate([[0], np.cumsum(_SYMBOL[words.buffer])])
    marks = sums(signs[words.at + words.size] - signs[words.at], words.count)
    letters = np.maximum(sums(words.size, words.count), 1)
    n = np.maximum(words.count, 1)
    for kind, value in ((7, np.log2(n + 1)), (8, 16 * kinds / n), (9, 40 * marks / letters)):
        docs.append(np.arange(many))
        keys.append(_hashed(value.astype(np.uint64), kind))
    if wanted is not None:
        kept = [wanted[k] for k in keys]
        docs, keys = [d[m] for d, m in zip(docs, kept)], [k[m] for k, m in zip(keys, kept)]
    doc, key = _distinct(np.concatenate(docs), np.concatenate(keys))
    return key, np.bincount(doc, minlength=many)


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their counts, and the labels (a row a document) of at most `limit` labelled documents.

    The choice is by the hash of doc_id, among labels of documents that are there. Labels with a null id or
    value are left out before it; of several rows with one doc_id one is taken, the least by labels or text.
    Nothing labelled gives empty arrays. Only ids and labels are shuffled, and the chosen rows' texts.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(columns))).dropna()
    y = [f"_y{i}" for i in range(len(columns))]
    given = given.groupBy("doc_id").agg(F.min(F.struct(*y)).alias("_y")).select("doc_id", "_y.*")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    usable = written(given.join(there, "doc_id", "left_semi"), "labelled")
    # the least hashes: a share a little above the limit goes to the final sort, however many labels there are
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, (1.2 * limit + 200) / max(1, usable.count()))
    chosen = usable.where(place < int(share * (1 << 40))).orderBy(place, "doc_id").limit(limit)
    rows = doc_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *y).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            key, count = features(batch.column("text"))
            ends = np.cumsum(count)
            raw = [key[e - n : e].astype("<u4").tobytes() for n, e in zip(count, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), *(batch.column(c) for c in y)], names=["doc_id", "key", *y])

    got = rows.mapInArrow(run, "doc_id long, key binary, " + ", ".join(f"{c} double" for c in y)).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    values = np.stack([got.column(c).to_numpy()[order] for c in y], axis=1) if len(order) else np.zeros((0, len(y)))
    raws = got.column("key").take(order).to_pylist() if len(order) else []
    del got
    pa.default_memory_pool().release_unused()
    return np.frombuffer(b"".join(raws), "<u4").view(np.int32), np.array([len(x) // 4 for x in raws], np.int64), values


class Design:
    """The sample's features with weights: columns are renumbered, and rare features left out."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        seen = np.bincount(key, minlength=1 << BITS)
        used = np.flatnonzero(seen >= LEAST_DOCS)
        column = np.full(1 << BITS, -1, np.int32)
        column[used] = np.arange(len(used))
        column = column[key]
        row = np.repeat(np.arange(len(count), dtype=np.int32), count)
        kept = column >= 0
        self.used, self.column, self.row, self.rows = used, column[kept], row[kept], len(count)

    def only(self, chosen: np.ndarray) -> "Design":
        """The design of the columns where `chosen`; the others get no weight."""
        part = object.__new__(Design)
        number = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
        column = number[self.column]
        kept = column >= 0
        part.used, part.column, part.row, part.rows = self.used[chosen], column[kept], self.row[kept], self.rows
        return part

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.rows).astype(float)

    def transposed(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, errors[self.row], len(self.used)).astype(float)

    def contrast(self, positive: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each column's log ratio of its rates in the rows where `positive` is 1 and where it is 0, and by how
        many standard errors the rates differ; of the rows where `rows` is 1. Both classes must occur."""
        rows = np.ones(self.rows) if rows is None else rows
        n1, n0 = (positive * rows).sum(), ((1 - positive) * rows).sum()
        with_, without = self.transposed(positive * rows), self.transposed((1 - positive) * rows)
        ratio = np.log((with_ + 0.5) / (n1 + 1)) - np.log((without + 0.5) / (n0 + 1))
        rate = (with_ + without) / (n1 + n0)
        error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
        seen = with_ + without > 0
        return np.where(seen, ratio, 0.0), np.where(seen, (with_ / n1 - without / n0) / error, 0.0)

    def full(self, weights: np.ndarray) -> np.ndarray:
        """The weights by feature number."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.used] = weights
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def minimum(loss, start: np.ndarray, steps: int = 300, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Where `loss`, which gives the value and gradient of a convex function, is least: L-BFGS from `start`."""
    x, (value, gradient) = start, loss(start)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0) < tolerance:
            break
        direction, along = -gradient, []
        for s, y, sy in reversed(past):
            along.append(s @ direction / sy)
            direction = direction - along[-1] * y
        direction = direction * (past[-1][2] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(gradient).sum()))
        for (s, y, sy), a in zip(past, reversed(along)):
            direction = direction + (a - y @ direction / sy) * s
        slope, t = gradient @ direction, 1.0
        while True:
            there, turned = loss(x + t * direction)
            if there <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = t * direction, turned - gradient
        if s @ y > 1e-14:
            past = [*past, (s, y, float(s @ y))][-memory:]
        x, value, gradient = x + s, there, turned
    return x


def score(docs: DataFrame, weights: np.ndarray, finish, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, and what `finish` makes of every document's products with `weights`.

    `weights` has a row a model and a column a feature; it is broadcast, and its size is fixed. `finish` gets the
    products, a row a document, and gives the columns of `schema` as arrays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        wanted = (w != 0).any(1)
        for batch in rows_of(batches):
            key, count = features(batch.column("text"), wanted)
            doc = np.repeat(np.arange(len(count)), count)
            products = np.stack([np.bincount(doc, w[key, k], len(count)).astype(float) for k in range(w.shape[1])], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(f"_keep_{c}") for c in keep), *(pa.array(x) for x in finish(products))], names=["doc_id", *keep, *names])

    kinds = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in keep)
    rows = doc_texts(docs, *(F.col(c).alias(f"_keep_{c}") for c in keep))
    return rows.mapInArrow(run, f"doc_id long{kinds}, {schema}")

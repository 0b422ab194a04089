"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams are the 2 to 4 characters (code points) at every place of the lower-cased, space-normalised text,
hashed into 2^BITS buckets. Counts by language cover all training rows; they are summed in each task, then
shuffled as (language, bucket, count). The matrix of log probabilities has 2^BITS rows and a column a
language; it is broadcast for LANGUAGES_AT_ONCE languages, so its size is bounded, and texts pass once for
each such part with the best language so far. A text's n-grams are counted sparsely and multiplied with the
matrix in blocks of at most BLOCK products, however many languages there are and however long the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SLICE_CHARS, doc_texts, rows_of
from lectern.session import written

BITS = 16
GRAMS = (2, 3, 4)
SMOOTHING = 0.5
#: Columns of the matrix that is broadcast at once: 17 MB.
LANGUAGES_AT_ONCE = 64
#: Products that are held at once.
BLOCK = 1 << 22
#: Languages that a task sums at once; beyond it, it hands on what it has.
_HELD = 32
_LATIN = re.compile("[A-Za-z]")
_SPACES = re.compile(r"[\x00-\x20\x7f-\xa0\s]+")


@dataclass
class Model:
    """The languages in order, with their log priors and n-grams; the counts are a table in the shared folder."""

    languages: list[str]
    prior: np.ndarray
    totals: np.ndarray
    counts: DataFrame  # lang, bucket, n

    def log_p(self, part: int) -> np.ndarray:
        """The log probabilities, bucket x language, of the languages of a part."""
        languages = self.languages[part * LANGUAGES_AT_ONCE : (part + 1) * LANGUAGES_AT_ONCE]
        out = np.full((1 << BITS, len(languages)), SMOOTHING, np.float32)
        got = self.counts.where(F.col("lang").isin(languages) & (F.col("bucket") >= 0)).toArrow()
        langs = got.column("lang").combine_chunks().dictionary_encode()
        number = {lang: k for k, lang in enumerate(languages)}
        column = np.array([number[x] for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
        out[got.column("bucket").to_numpy(), column] += got.column("n").to_numpy()
        totals = self.totals[part * LANGUAGES_AT_ONCE : (part + 1) * LANGUAGES_AT_ONCE]
        return np.log(out) - np.log(totals + SMOOTHING * (1 << BITS)).astype(np.float32)


def gram_buckets(plain: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams that begin at the first `starts` letters of each text, one text's after the
    other's, and how many each has."""
    size = np.array([len(t) for t in plain], np.int64)
    letters = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.stack([np.minimum(np.maximum(size - n + 1, 0), starts) for n in GRAMS])
    total = counts.sum(0)
    out = np.empty(int(total.sum()), np.int64)
    begin, base = np.cumsum(size) - size, np.cumsum(total) - total
    gram = np.zeros(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            # the n letters from each place on; those that run over a text's end are left out below
            whole = max(0, len(letters) - n + 1)
            gram[:whole] = (gram[:whole] ^ letters[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
            if n in GRAMS:
                count = counts[GRAMS.index(n)]
                steps = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                mixed = gram[np.repeat(begin, count) + steps] * np.uint64(0xBF58476D1CE4E5B9)
                out[np.repeat(base, count) + steps] = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
                base = base + count
    return out, total


def gram_slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, buckets, how many of each text) for all n-grams, about `most` letters at a time: longer texts in pieces."""
    held: list[tuple[int, str, int]] = []
    size = 0
    for i, text in enumerate(texts):
        plain = _SPACES.sub(" ", text).strip(" ").lower()
        for a in range(0, max(1, len(plain)), most):
            piece = plain[a : a + most + max(GRAMS) - 1]  # its last n-grams begin at its `most`-th letter
            if size and size + len(piece) > most:
                yield np.array([x[0] for x in held]), *gram_buckets([x[1] for x in held], np.array([x[2] for x in held]))
                held, size = [], 0
            held.append((i, piece, most))
            size += len(piece)
    if held:
        yield np.array([x[0] for x in held]), *gram_buckets([x[1] for x in held], np.array([x[2] for x in held]))


def products(buckets: np.ndarray, many: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """The product of the texts' n-gram counts with the matrix: a row a text, summed over blocks of n-grams."""
    out = np.zeros((len(many), log_p.shape[1]))
    ends = np.cumsum(many)
    step = max(1, BLOCK // max(1, log_p.shape[1]))
    for a in range(0, len(buckets), step):
        b = min(a + step, len(buckets))
        texts = np.flatnonzero((ends > a) & (ends - many < b) & (many > 0))
        out[texts] += np.add.reduceat(log_p[buckets[a:b]], np.maximum(ends[texts] - many[texts], a) - a, axis=0, dtype=np.float64)
    return out


def fit(docs: DataFrame, train: Column, label: str = "lang") -> Model:
    """A model from the rows where `train` is true, `label` isn't null and the text isn't null."""
    rows = doc_texts(docs.where(train & F.col(label).isNotNull() & F.col("text").isNotNull()), F.col(label).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang in [*held, *(x for x in seen if x not in held)]:
                counts = held.get(lang, np.zeros(1, np.int64))
                at = np.flatnonzero(counts)
                at, n = np.append(at, -1), np.append(counts[at], seen.get(lang, 0))  # bucket -1: documents
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])
            held.clear()
            seen.clear()

        for batch in rows_of(batches):
            langs = batch.column("lang").dictionary_encode()
            own = langs.indices.to_numpy()
            known = langs.dictionary.to_pylist()
            for texts, buckets, many in gram_slices(batch.column("text").to_pylist()):
                of = np.repeat(own[texts], many)
                for k in np.unique(own[texts]).tolist():
                    if known[k] not in held and len(held) >= _HELD:
                        yield from hand_on()
                    found = np.bincount(buckets[of == k], minlength=1 << BITS)
                    held[known[k]] = held[known[k]] + found if known[k] in held else found
            for k, n in zip(*np.unique(own, return_counts=True)):
                seen[known[k]] = seen.get(known[k], 0) + int(n)
        yield from hand_on()

    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = written(summed, "gram-counts")
    of_all = summed.groupBy("lang").agg(F.sum(F.when(F.col("bucket") >= 0, F.col("n"))).alias("grams"), F.sum(F.when(F.col("bucket") < 0, F.col("n"))).alias("docs")).orderBy("lang").collect()
    docs_of = np.array([r.docs for r in of_all], float)
    return Model([r.lang for r in of_all], np.log(docs_of / docs_of.sum()) if len(docs_of) else docs_of, np.array([r.grams or 0 for r in of_all], float), summed)


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, `more`, lang_pred and score, the posterior probability of lang_pred, for every row.

    A null text, and one without a letter, is `und` with score 0, as all are if nothing was learned. Ties go to
    the language that comes first by name. Rows that repeat a doc_id, or have none, are predicted each for itself.
    An empty table gives no rows. Only the text is an input of a prediction.
    """
    context = docs.sparkSession.sparkContext
    rows = doc_texts(docs, *more)
    names = rows.columns[2:]
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    parts = -(-len(model.languages) // LANGUAGES_AT_ONCE) or 1
    learned = bool(model.languages)
    state = ["_lang", "_best", "_all"]  # the best language so far, its log probability, and that of all so far
    for part in range(parts):
        first = part * LANGUAGES_AT_ONCE
        shared = context.broadcast((model.languages[first : first + LANGUAGES_AT_ONCE], model.prior[first : first + LANGUAGES_AT_ONCE], model.log_p(part)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            languages, prior, log_p = shared.value
            for batch in rows_of(batches):
                n = batch.num_rows
                texts = batch.column("text").to_pylist()
                told = np.array([has_letter(t) for t in texts], bool) & learned
                lang, best, whole = [None] * n, np.full(n, -np.inf), np.full(n, -np.inf)
                if part:
                    lang, best, whole = batch.column("_lang").to_pylist(), *(batch.column(c).to_numpy() for c in state[1:])
                if languages:
                    sums = np.tile(prior, (n, 1))
                    for own, buckets, many in gram_slices(texts):
                        np.add.at(sums, own, products(buckets, many, log_p))
                    at = sums.argmax(1)
                    top = sums.max(1)
                    better = top > best  # ties go to what comes first
                    lang = [languages[k] if new else old for k, new, old in zip(at, better, lang)]
                    best = np.maximum(best, top)
                    whole = np.logaddexp(whole, top + np.log(np.exp(sums - top[:, None]).sum(1)))
                if part + 1 < parts:
                    last = [pa.array(lang, pa.string()), pa.array(best), pa.array(whole)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", *names)), *last], names=["doc_id", "text", *names, *state])
                else:
                    score = np.where(told, np.exp(np.where(told, best - whole, 0.0)), 0.0)
                    pred = [k if ok else "und" for k, ok in zip(lang, told)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", *names, "lang_pred", "score"])

        rows = rows.mapInArrow(run, f"doc_id long, text string{kinds}, _lang string, _best double, _all double" if part + 1 < parts else f"doc_id long{kinds}, lang_pred string, score double")
    return rows

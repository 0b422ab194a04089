"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every training text is a query. A term's impact on an item is its BM25 weight divided by
the item's score against itself, so that a passage scores the matched share of an item, and one threshold
holds for all items. No passage can hold much of an item that is far longer than it, so items of more than
PASSAGE terms are indexed as a whole and as overlapping segments of PASSAGE terms, each scored as an item of
its own; an item's score is the best of these, and it is always verified as a whole. Postings lie in blocks
of item order, each with its greatest impact. The pivot tests of WAND are made for many passages at once: a
passage whose terms' greatest impacts don't add up to the threshold is skipped, as are blocks whose greatest
impacts don't; the items of what is left are scored in full. Found items are verified by the share of their
question's and answer's word n-grams that the text around the passage holds. The search is exact: all items
and segments at or above the threshold are found, with any number of blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, rows_of, small_batches
from lectern.llm.kernels import text_bytes, xxh64
from lectern.llm.token_io import filesystem
from lectern.session import shared_path

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32
BLOCKS = 64
#: The matched share of an item's BM25 mass from which it is looked at.
THRESHOLD = 0.4
GRAM = 3
#: Shares of the question's and of the answer's n-grams that make a leak; a short answer needs the question.
QUESTION, ANSWER = 0.5, 0.5
#: Bytes of items in one index. One is broadcast; several are files in the shared folder, which a task reads in turn
#: for every HELD_BYTES of text, so that the documents are scanned once.
PART_BYTES = 2 << 20
HELD_BYTES = 32 << 20

_WORD = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD[_b] = _b
for _b in range(65, 91):
    _WORD[_b] = _b + 32


class Terms:
    """Hashes of the terms of texts: runs of ASCII letters and digits (A-Z lowered) and non-ASCII bytes."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        x = _WORD[raw]
        black = x != 0
        before, after = np.zeros(len(x), bool), np.zeros(len(x), bool)
        before[1:], after[:-1] = black[:-1], black[1:]
        edge = offsets[1:-1]
        before[edge[edge < len(x)]] = False
        after[edge[edge > 0] - 1] = False
        at, end = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after)
        self.hashes = xxh64(x, at, end - at + 1)
        self.end = end
        self.first = np.searchsorted(at, offsets[:-1])
        self.count = np.diff(np.append(self.first, len(at)))
        self.offsets = offsets

    def of(self, text: int) -> np.ndarray:
        return self.hashes[self.first[text] : self.first[text] + self.count[text]]


def answer_start(text: str) -> int:
    """Where an item's answer begins: after `Answer:` or a line `A:`, else at its last sentence; its length if it is one sentence."""
    import re

    marks = list(re.finditer(r"(?im)\banswer\s*:|^\s*a\s*:", text))
    if marks:
        return marks[-1].end()
    breaks = [m.end() for m in re.finditer(r"[.!?][\"')\]]*\s+(?=\S)|\n+(?=\S)", text.rstrip())]
    return breaks[-1] if breaks else len(text)


def grams(terms: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Distinct hashes of the n-grams of a run of terms; of the whole run if it is shorter."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    n = min(n, len(terms))
    with np.errstate(over="ignore"):
        h = np.zeros(len(terms) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ terms[k : len(terms) - n + 1 + k]) * np.uint64(0x9E3779B185EBCA87)
            h ^= h >> np.uint64(32)
    return np.unique(h)


@dataclass
class Index:
    ids: list[int]
    owner: np.ndarray  # the item of each entry: first the items themselves, then the segments of long ones
    terms: np.ndarray  # sorted hashes
    best: np.ndarray  # greatest impact of each term
    block: int  # entries of a block
    bounds: np.ndarray  # term x block: greatest impact
    start: np.ndarray  # term x block: where its postings begin; those of a term lie together
    items: np.ndarray  # entries
    impacts: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    longest: int


@dataclass
class Statistics:
    """Of all items, for indexes that hold a part of them."""

    many: int
    mean: float
    longest: int
    terms: np.ndarray  # sorted hashes
    df: np.ndarray


def build(ids: list[int], texts: list[str], blocks: int = BLOCKS, stats: Statistics | None = None) -> Index:
    """The index of items, in at most `blocks` blocks of equal size; items without terms are never found.

    Document frequencies and the mean length are those of the items, also for segments: of all items if
    `stats` are given, else of these.
    """
    parts = [answer_start(t) for t in texts]
    whole = Terms(pa.array(texts, pa.string()))
    heads, tails = Terms(pa.array([t[:p] for t, p in zip(texts, parts)], pa.string())), Terms(pa.array([t[p:] for t, p in zip(texts, parts)], pa.string()))
    many = len(texts)
    mean = stats.mean if stats else max(1.0, whole.count.mean()) if many else 1.0
    terms, number = np.unique(whole.hashes, return_inverse=True)
    # the last segment ends with its item
    of, start, stop = passages(np.where(whole.count > PASSAGE, whole.count, 0), whole.first)
    start = stop - PASSAGE
    owner, size = np.concatenate([np.arange(many), of]), np.concatenate([whole.count, stop - start])
    begin = np.concatenate([whole.first, start])
    entries = len(owner)
    entry = np.repeat(np.arange(entries), size)
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pairs, tf = np.unique(number[place] * np.int64(entries) + entry, return_counts=True)  # by term, then entry
    term, entry = pairs // max(entries, 1), pairs % max(entries, 1)
    df = stats.df[np.searchsorted(stats.terms, terms)] if stats else np.bincount(term[entry < many], minlength=len(terms))
    idf = np.log(1 + ((stats.many if stats else many) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[entry] / mean))
    impact = impact / np.bincount(entry, impact, entries)[entry]
    block = max(1, -(-entries // blocks))
    n_blocks = max(1, -(-entries // block))
    bounds = np.zeros((len(terms), n_blocks), np.float32)
    np.maximum.at(bounds, (term, entry // block), np.nextafter(impact.astype(np.float32), np.float32(2)))
    start = np.searchsorted(term * n_blocks + entry // block, np.arange(len(terms) * n_blocks + 1))
    longest = stats.longest if stats else int(whole.count.max()) if many else 0
    return Index(ids, owner, terms, bounds.max(1) if len(terms) else np.zeros(0, np.float32), block, bounds, start, entry, impact, [grams(heads.of(i)) for i in range(many)], [grams(tails.of(i)) for i in range(many)], longest)


def retrieve(index: Index, query: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """The entries of the blocks whose bound reaches the threshold, scored in full over the distinct terms `query`."""
    found = []
    n_blocks = index.bounds.shape[1]
    for k in np.flatnonzero(bounds >= threshold):
        at = query * n_blocks + k
        spans = [slice(a, b) for a, b in zip(index.start[at].tolist(), index.start[at + 1].tolist()) if a < b]
        items = np.concatenate([index.items[x] for x in spans])
        scores = np.bincount(items - k * index.block, np.concatenate([index.impacts[x] for x in spans]))
        found += [(int(i + k * index.block), float(scores[i])) for i in np.flatnonzero(scores >= threshold)]
    return found


def search_passages(index: Index, numbers: np.ndarray, starts: np.ndarray, stops: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, entry, score) of all entries at or above the threshold, for passages given by their spans.

    `numbers` are the index terms at all places, -1 for others. Bounds are tested for all passages at once:
    those over whole posting lists first, then those over blocks.
    """
    slack = threshold - 1e-6
    weight = np.concatenate([[0], np.cumsum(np.where(numbers >= 0, index.best[numbers], 0), dtype=np.float64)])
    live = np.flatnonzero(weight[stops] - weight[starts] >= slack)
    found = []
    for part in np.array_split(live, max(1, len(live) // 2000)):
        size = stops[part] - starts[part]
        place = np.repeat(starts[part], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        of, term = np.repeat(np.arange(len(part)), size), numbers[place]
        pairs = np.unique(of[term >= 0] * np.int64(len(index.terms)) + term[term >= 0])
        of, term = pairs // max(1, len(index.terms)), pairs % max(1, len(index.terms))
        if not len(pairs):
            continue
        own, first = np.unique(of, return_index=True)
        bounds = np.add.reduceat(index.bounds[term], first, axis=0)
        ends = np.append(first[1:], len(of))
        for k in np.flatnonzero((bounds >= slack).any(1)):
            found += [(int(part[own[k]]), item, score) for item, score in retrieve(index, term[first[k] : ends[k]], bounds[k], slack)]
    return found


def verified(index: Index, item: int, nearby: np.ndarray, question: float, answer: float) -> tuple[bool, float, float]:
    """Whether `nearby` (terms) holds the item, and the shares of its question's and answer's n-grams there."""
    have = grams(nearby)
    share = lambda part: float(np.isin(part, have).mean()) if len(part) else 0.0
    q, a = index.question[item], index.answer[item]
    in_q, in_a = share(q), share(a)
    if not len(a) or not len(q):
        return max(in_q, in_a) >= question, in_q, in_a
    both = (in_q * len(q) + in_a * len(a)) / (len(q) + len(a))
    return (in_q >= question and (in_a >= answer or both >= question)) or both >= max(question, answer), in_q, in_a


def passages(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last place of the passages of texts with `counts` terms: PASSAGE terms, every STRIDE."""
    many = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - PASSAGE) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), many)
    start = first[text] + STRIDE * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
    return text, start, np.minimum(start + PASSAGE, (first + counts)[text])


_CANDIDATE = "struct<item_id: bigint, score: double, question: double, answer: double, leak: boolean>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("leak", pa.bool_())]))


def _statistics(items: DataFrame) -> Statistics:
    """Of all items; the driver gets 16 bytes a distinct term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            terms = Terms(batch.column("text"))
            item = np.repeat(np.arange(batch.num_rows), terms.count)
            seen = np.unique(np.stack([item.astype(np.uint64), terms.hashes], axis=1), axis=0)
            own, n = np.unique(seen[:, 1], return_counts=True)
            lengths = [len(terms.hashes), int(terms.count.max(initial=0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(own.view(np.int64), [0, 0])), pa.array(np.append(n, lengths)), pa.array(np.append(np.zeros(len(own), np.int64), [1, 2]))], names=["term", "n", "kind"])

    each = small_batches(items.select("text")).mapInArrow(run, "term long, n long, kind long")
    got = each.groupBy("kind", "term").agg(F.sum("n").alias("total"), F.max("n").alias("most")).toArrow()
    kind, term, total, most = (got.column(c).to_numpy() for c in ("kind", "term", "total", "most"))
    many = items.count()
    terms = term[kind == 0].view(np.uint64)
    order = np.argsort(terms)
    return Statistics(many, max(1.0, total[kind == 1].sum() / max(1, many)), int(most[kind == 2].max(initial=0)), terms[order], total[kind == 0][order])


def _index(items: DataFrame, part: int, parts: int, stats: Statistics | None) -> Index:
    some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    got = some.orderBy("item_id", "text").toArrow()
    return build(got.column("item_id").to_pylist(), got.column("text").to_pylist(), stats=stats)


def _found(ix: Index, texts: pa.Array, threshold: float, question: float, answer: float) -> list[list[dict]]:
    """The candidates of each text."""
    terms = Terms(texts)
    text, starts, stops = passages(terms.count, terms.first)
    best: dict[tuple[int, int], dict] = {}
    if len(ix.terms):
        at = np.searchsorted(ix.terms, terms.hashes)
        at[at == len(ix.terms)] = 0
        numbers = np.where(ix.terms[at] == terms.hashes, at, -1)
        scores: dict[tuple[int, int], float] = {}
        for k, entry, score in search_passages(ix, numbers, starts, stops, threshold):
            at_item = k, int(ix.owner[entry])
            scores[at_item] = max(score, scores.get(at_item, 0.0))
        for (k, item), score in scores.items():
            i = int(text[k])
            x = best.setdefault((i, item), {"item_id": ix.ids[item], "score": 0.0, "question": 0.0, "answer": 0.0, "leak": False})
            x["score"] = max(x["score"], score)
            if not x["leak"]:
                low, high = max(terms.first[i], starts[k] - ix.longest), min(terms.first[i] + terms.count[i], stops[k] + ix.longest)
                leak, q, r = verified(ix, item, terms.hashes[low:high], question, answer)
                x |= {"leak": leak, "question": max(q, x["question"]), "answer": max(r, x["answer"])}
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for (i, _), x in best.items():
        out[i].append(x)
    return out


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, contaminated, item_ids (ascending) and all candidates for every row of `docs`.

    `item_ids` are the items that are verified, `candidates` all that BM25 finds. Null texts and items have no
    terms and match nothing. Rows that repeat a doc_id, or have none, are searched each for itself; equal items
    are found each. Without items, or documents, nothing is found. Items of more than PART_BYTES are indexed in
    parts with the term statistics of all items; every passage is searched against all parts in one scan.
    """
    spark = docs.sparkSession
    pool = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = -(-(pool.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES) or 1
    rows = doc_texts(docs, *(F.col(c).alias(f"_keep_{c}") for c in keep))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    folder, shared = shared_path(spark, "index"), None
    if parts == 1:
        shared = spark.sparkContext.broadcast(_index(pool, 0, 1, None))
    else:
        stats = _statistics(pool)
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        for part in range(parts):
            with files.open_output_stream(f"{root}/{part}", compression=None) as out:
                out.write(pickle.dumps(_index(pool, part, parts, stats), protocol=5))

    def indexes() -> Iterator[Index]:
        if shared is not None:
            yield shared.value
        else:
            files, root = filesystem(folder)
            for part in range(parts):
                with files.open_input_stream(f"{root}/{part}", compression=None) as f:
                    yield pickle.loads(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = [[[] for _ in range(b.num_rows)] for b in held]
            for ix in indexes():
                for batch, mine in zip(held, found):
                    for own, new in zip(mine, _found(ix, batch.column("text"), threshold, question, answer)):
                        own += new
            for batch, mine in zip(held, found):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine, _KIND)], names=[*batch.schema.names, "candidates"])
            held.clear()

        for batch in rows_of(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if parts == 1 or size >= HELD_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    rows = rows.mapInArrow(run, f"{kinds}, candidates array<{_CANDIDATE}>")
    leaks = F.array_sort(F.transform(F.filter("candidates", lambda x: x["leak"]), lambda x: x["item_id"]))
    return rows.select("doc_id", *(F.col(f"_keep_{c}").alias(c) for c in keep), (F.size(leaks) > 0).alias("contaminated"), leaks.alias("item_ids"), "candidates")

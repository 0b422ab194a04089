"""Language-model scoring with a hierarchical log-bilinear model, trained by noise contrast in numpy.

P(word | context) = P(group | context) * P(class | group, context) * P(word | class). Classes are the 2,047
most frequent words, each for itself, 2,048 buckets of all other words by their last three bytes, and the text's
end; they are dealt out to 64 groups of 64 by rank. Groups and classes have vectors of their own; the prediction
vector is the sum of the context classes' vectors, each scaled by its position, and a score is the product with
a vector plus a bias. Two matrix products and softmaxes of 64 normalise a token. Within a bucket, words have their
add-one frequencies, with one share for all unknown words, so the probabilities of all words and the unknown one
add up to 1.

Words are known by the XXH64 of their bytes. All training documents count: word counts are summed over all of
them by a shuffle, and the noise-contrastive training passes over all their tokens. The documents are split by hash
into shards of about SHARD_TOKENS tokens, so there are more as the input grows; each shard is trained from the same
start in the order of its hashes, and the changes are averaged by tokens. So the model follows from the documents
alone, however many tasks there are (to the rounding of a sum). The counts of the HEAD most frequent words are
broadcast (a fixed bound); those of the others, which are none of them hot, come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, rows_of
from lectern.llm.kernels import Words, sums, text_bytes
from lectern.session import written

SINGLES, BUCKETS = 2047, 2048
CLASSES = SINGLES + BUCKETS + 1
GROUPS = 64
SIZE = CLASSES // GROUPS
END, PAD = CLASSES - 1, CLASSES
HEAD = 1 << 18
CONTEXT, WIDTH = 3, 24
NOISE, GROUP_NOISE, BATCH, RATE = 64, 16, 2048, 0.08
SHARD_TOKENS = 1 << 19
_TEXT = 1 << 20
_NEVER = -1e30
#: Distinct words that a task holds before it hands their counts on.
_HELD = 2_000_000


@dataclass
class Vocabulary:
    """Counts of the HEAD most frequent words, in the order of their hashes, and sums over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray  # of frequent words; -1: the bucket's
    tokens: int
    types: int
    docs: int
    mass: np.ndarray  # add-one mass by class; of a bucket with its unknown word, 0 of a class that no word has
    place: np.ndarray  # of a class: its group's number times SIZE, and its number there

    def singles(self) -> "Vocabulary":
        """With the words of a class of their own alone, which is all that training looks up."""
        own = self.classes >= 0
        return replace(self, hashes=self.hashes[own], counts=self.counts[own], classes=self.classes[own])

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.tokens + self.types + 1))


@dataclass
class Weights:
    """Of classes, and of contexts, by their place; of groups by number."""

    context: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    position: np.ndarray
    squares: list = field(default_factory=list)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.output, self.bias, self.group, self.group_bias, self.position]


def start_weights(vocabulary: Vocabulary) -> Weights:
    """Without context effects at first, so that the model starts as its classes' frequencies."""
    rng = np.random.default_rng(11)
    context = rng.normal(0, 0.3, (CLASSES + 1, WIDTH)).astype(np.float32)
    p = np.zeros(CLASSES)
    p[vocabulary.place] = vocabulary.mass / vocabulary.mass.sum()
    position = np.array([[1.0], [0.6], [0.4], [0.3], [0.2]][:CONTEXT], np.float32).repeat(WIDTH, 1)
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), _NEVER).astype(np.float32)
    return Weights(context, np.zeros((CLASSES, WIDTH), np.float32), log(p), np.zeros((GROUPS, WIDTH), np.float32), log(p.reshape(GROUPS, SIZE).sum(1)), position)


def buckets_of(words: Words) -> np.ndarray:
    """A bucket for each word, by its last three bytes."""
    if not len(words.at):
        return np.zeros(0, np.int64)
    data = bytes(3) + words.buffer.tobytes()
    w4 = np.ndarray((len(words.buffer),), "<u4", data, strides=(1,))
    tail = w4[words.at + words.size - 1]  # four bytes that end with the word's last
    tail = np.where(words.size >= 3, tail >> np.uint32(8), np.where(words.size == 2, tail >> np.uint32(16), tail >> np.uint32(24)))
    with np.errstate(over="ignore"):
        mixed = (tail.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, bucket, n): how often each word comes in all texts of `docs`; bucket -1 counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        many = docs_seen = 0

        def merge() -> tuple[np.ndarray, ...]:
            h, b, n = (np.concatenate(x) for x in zip(*held))
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            return keys, b[first], np.bincount(back, n, len(keys)).astype(np.int64)

        def rows(h, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(n)], names=["h", "bucket", "n"])

        for batch in rows_of(batches):
            docs_seen += batch.num_rows
            words = Words(*text_bytes(batch.column("text")))
            if len(words.at):
                keys, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                held.append((keys, buckets_of(words)[first], n))
                many += len(keys)
            if many > _HELD:
                held = [merge()]
                many = len(held[0][0])
                if many > _HELD // 2:
                    yield rows(*held.pop())
                    many = 0
        if held:
            yield rows(*merge())
        if docs_seen:
            yield rows(np.zeros(1, np.uint64), np.array([-1]), np.array([docs_seen]))

    return doc_texts(docs).mapInArrow(run, "h long, bucket int, n long").groupBy("h", "bucket").agg(F.sum("n").alias("n"))


def gather(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The vocabulary of a table of `count_words`: the words from some count on, at most `head` of them."""
    docs = counts.where("bucket = -1").agg(F.sum("n")).first()[0] or 0
    words = counts.where("bucket >= 0")
    # a histogram of the counts on a logarithmic scale tells from which count on there are at most `head` words
    step = F.floor(F.log2("n") * 32).cast("int")
    bins = words.groupBy(step.alias("step")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, types, least, taken = sum(r.n for r in bins), sum(r.words for r in bins), 1 << 30, 0
    for r in bins:
        taken += r.words
        if taken > head:
            break
        least = r.step
    top = words.where(step >= least).toArrow()
    h, n, bucket = (top.column(c).to_numpy() for c in ("h", "n", "bucket"))
    rank = np.lexsort((h, -n))
    classes = np.full(len(h), -1, np.int64)
    single = rank[:SINGLES]
    classes[single] = np.arange(len(single))
    mass = np.ones(CLASSES)
    mass[:SINGLES] = 0
    mass[: len(single)] = n[single] + 1
    mass[END] = docs + 1
    for b, s in words.groupBy("bucket").agg(F.sum(F.col("n") + 1).alias("s")).collect():
        mass[SINGLES + b] += s
    np.subtract.at(mass, SINGLES + bucket[single], n[single] + 1.0)
    place = np.empty(CLASSES, np.int64)
    dealt = np.arange(CLASSES)
    place[np.argsort(-mass, kind="stable")] = dealt % GROUPS * SIZE + dealt // GROUPS
    order = np.argsort(h.view(np.uint64))
    return Vocabulary(h.view(np.uint64)[order], n[order].astype(np.int64), classes[order], int(total) + docs, int(types) + (docs > 0), int(docs), mass, place)


class Sequences:
    """The place of every token's class in a batch's texts, ends included, with its context and its counts."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        words = Words(*text_bytes(texts))
        self.hashes = words.hashes()
        v = vocabulary
        at = np.searchsorted(v.hashes, self.hashes)
        at[at == len(v.hashes)] = 0
        self.known = v.hashes[at] == self.hashes if len(v.hashes) else np.zeros(len(at), bool)
        self.count = np.where(self.known, v.counts[at], 0) if len(v.hashes) else np.zeros(len(at), np.int64)
        own = np.where(self.known, v.classes[at], -1) if len(v.hashes) else np.full(len(at), -1)
        self.word_class = np.where(own >= 0, own, SINGLES + buckets_of(words))
        self.words = words
        # each text's words, then its end
        self.lengths = words.count + 1
        ends = np.cumsum(self.lengths)
        self.classes = np.full(int(ends[-1]) if len(ends) else 0, END, np.int64)
        inner = np.ones(len(self.classes), bool)
        inner[ends - 1] = False
        self.classes[inner] = self.word_class
        self.classes = v.place[self.classes]
        place = np.arange(len(self.classes)) - np.repeat(ends - self.lengths, self.lengths)
        self.context = np.full((CONTEXT, len(self.classes)), PAD, np.int64)
        for i in range(CONTEXT):
            self.context[i, i + 1 :] = self.classes[: -i - 1]
            self.context[i, place <= i] = PAD


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The stable order of small numbers: in 16 bits numpy counts them rather than comparing."""
    return np.argsort(rows.astype(np.uint16), kind="stable")


def _odds(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train(w: Weights, s: Sequences, noise_p: np.ndarray, rng: np.random.Generator) -> None:
    """Noise-contrastive steps with AdaGrad over all tokens, in batches that share their noise classes and groups."""
    if not w.squares:
        w.squares = [np.full_like(x, 1e-2) for x in w.parts()]
    group_p = noise_p.reshape(GROUPS, SIZE).sum(1)

    def step(part: int, rows: np.ndarray, values: np.ndarray, more: tuple[int, np.ndarray] | None = None) -> None:
        """An AdaGrad step of the rows of a part, and of those of a second one."""
        order = _sorted(rows)
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows = rows[first]
        for at, v in ((part, values), *([more] if more else [])):
            g, x, q = np.add.reduceat(v[order], first, axis=0), w.parts()[at], w.squares[at]
            total = q[rows] + g * g
            q[rows] = total
            x[rows] += RATE * g / np.sqrt(total)

    levels = []
    for p, many, vectors, bias in ((noise_p, NOISE, 1, 2), (group_p, GROUP_NOISE, 3, 4)):
        levels.append((np.cumsum(p), np.log(many * np.maximum(p, 1e-300)).astype(np.float32), many, vectors, bias))
    for a in range(0, len(s.classes), BATCH):
        targets, context = s.classes[a : a + BATCH], s.context[:, a : a + BATCH]
        vectors = [w.context[c] for c in context]
        r = sum(v * p for v, p in zip(vectors, w.position))
        g_r = 0
        for (cdf, log_kq, many, at, at_bias), target in zip(levels, (targets, targets // SIZE)):
            table, bias = w.parts()[at], w.parts()[at_bias]
            noise = np.searchsorted(cdf, rng.random(many) * cdf[-1], side="right")
            noise = np.minimum(noise, len(cdf) - 1)
            out = table[target]
            real = (out * r).sum(1) + bias[target] - log_kq[target]
            false = r @ table[noise].T + (bias[noise] - log_kq[noise])
            g_real, g_false = 1 - _odds(real), -_odds(false)
            g_r = g_r + g_real[:, None] * out + g_false @ table[noise]
            both = np.concatenate([target, noise])
            step(at, both, np.concatenate([g_real[:, None] * r, g_false.T @ r]), (at_bias, np.concatenate([g_real, g_false.sum(0)])))
        step(0, context.ravel(), np.concatenate([g_r * p for p in w.position]))
        step(5, np.arange(CONTEXT), np.stack([(g_r * v).sum(0) for v in vectors]))


def fit(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 1, shard_tokens: int = SHARD_TOKENS) -> Weights:
    """Weights from all texts of `docs`: in each round every shard is trained from the last average."""
    w = start_weights(vocabulary)
    shapes = [x.shape for x in w.parts()]
    context = docs.sparkSession.sparkContext
    told = context.broadcast(vocabulary.singles())
    shards = max(1, -(-vocabulary.tokens // shard_tokens))
    key = F.xxhash64("doc_id", "text")
    rows = doc_texts(docs).withColumn("key", key).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism))
    rows = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "key", "doc_id")
    for turn in range(rounds):
        begin = context.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], begin=begin, turn=turn) -> Iterator[pa.RecordBatch]:
            v, b = told.value, begin.value
            noise_p = np.zeros(CLASSES)
            noise_p[v.place] = v.mass / v.mass.sum()
            flat = np.zeros(sum(x.size for x in b.parts()) + 1)
            held: list[str] = []
            size, shard, own, rng, tokens = 0, None, None, None, 0

            def learn() -> None:
                nonlocal size, tokens
                if held:
                    s = Sequences(pa.array(held, pa.large_string()), v)
                    train(own, s, noise_p, rng)
                    tokens += len(s.classes)
                held.clear()
                size = 0

            def close() -> None:
                learn()
                flat[:-1] += np.concatenate([(x - y).ravel() for x, y in zip(own.parts(), b.parts())]).astype(np.float64) * tokens
                flat[-1] += tokens

            for batch in rows_of(batches):
                for text, number in zip(batch.column("text").to_pylist(), batch.column("shard").to_pylist()):
                    if number != shard:
                        if own is not None:
                            close()
                        shard, own, rng, tokens = number, Weights(*(x.copy() for x in b.parts())), np.random.default_rng([turn, number]), 0
                    held.append(text)
                    size += len(text)
                    if size >= _TEXT:
                        learn()
            if own is not None:
                close()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

        summed = rows.select("text", "shard").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        if not summed.num_rows:
            return w
        flat = np.zeros(summed.num_rows)
        flat[summed.column("i").to_numpy()] = summed.column("x").to_numpy()
        flat = flat[:-1] / flat[-1]
        at = 0
        parts = []
        for x, shape in zip(w.parts(), shapes):
            parts.append(x + flat[at : at + x.size].reshape(shape).astype(np.float32))
            at += x.size
        w = Weights(*parts)
    return w


def _log_softmax(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log probability of the chosen row of each column; `scores` is overwritten."""
    target = scores[chosen, np.arange(len(chosen))].astype(np.float64)
    top = scores.max(0)
    scores -= top
    np.exp(scores, out=scores)
    return target - top - np.log(scores.sum(0, dtype=np.float64))


def class_log_probs(w: Weights, s: Sequences, step: int = 1 << 14) -> np.ndarray:
    """log10 P(class | context) of every token: a matrix product and a softmax over the groups, and one over the
    classes of each group for the tokens that it holds."""
    out = np.empty(len(s.classes))
    for a in range(0, len(s.classes), step):
        context, classes = s.context[:, a : a + step], s.classes[a : a + step]
        order = _sorted(classes // SIZE)
        r = sum(w.context[c] * p for c, p in zip(context[:, order], w.position))
        group, inner = np.divmod(classes[order], SIZE)
        own = _log_softmax(w.group @ r.T + w.group_bias[:, None], group)
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        for g, (x, y) in enumerate(zip([0, *ends[:-1]], ends)):
            if x < y:
                part = slice(g * SIZE, (g + 1) * SIZE)
                own[x:y] += _log_softmax(w.output[part] @ r[x:y].T + w.bias[part, None], inner[x:y])
        out[a + order] = own
    return out / np.log(10)


COLUMNS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<long>"


def score_texts(docs: DataFrame, vocabulary: Vocabulary, w: Weights, more: list[Column]) -> DataFrame:
    """Scores but for the counts of words outside the head, whose hashes are in `tail`."""
    context = docs.sparkSession.sparkContext
    told, weights = context.broadcast(vocabulary), context.broadcast(w)
    rows = doc_texts(docs, *more)
    names = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = told.value, weights.value
        row = TaskContext.get().partitionId() << 36
        log_mass = np.log10(np.maximum(v.mass, 1))
        for batch in rows_of(batches):
            s = Sequences(batch.column("text"), v)
            many = s.words.count
            model = sums(class_log_probs(w, s), s.lengths)
            in_bucket = (s.word_class >= SINGLES) * 1.0
            added = np.log10(s.count + 1.0)
            model += sums(np.where(in_bucket, added - log_mass[s.word_class], 0), many)
            base = sums(added, many) + np.log10(v.docs + 1) - v.base_norm * s.lengths
            known = sums(s.known.astype(np.int64), many) + (v.docs > 0)
            tail = ~s.known
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums(tail.astype(np.int64), many))]).astype(np.int32)), pa.array(s.hashes[tail].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), *(pa.array(x) for x in (s.lengths, known, base, model)), lists, *(batch.column(c) for c in names)],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail", *names],
            )
            row += batch.num_rows

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, COLUMNS + kinds)


def score(docs: DataFrame, train_rows: Column, *more: Column, rounds: int = 1, head: int = HEAD) -> DataFrame:
    """doc_id, `more`, n_tokens, n_known, train_tokens, base_score and score for every row of `docs`.

    The model learns from the rows where `train_rows` is true. Null texts are empty: an end alone. Rows that
    repeat a doc_id, or have none, are scored each for itself. With no training rows all words are unknown
    and all classes equally likely. An empty table gives no rows. Other columns are ignored.
    """
    learned = docs.where(train_rows)
    counts = written(count_words(learned), "word-counts")
    vocabulary = gather(counts, head)
    w = fit(learned, vocabulary, rounds)
    scored = written(score_texts(docs, vocabulary, w, list(more)), "scored")
    words = counts.where("bucket >= 0").select("h", F.col("n").alias("c"))
    # an unknown word adds nothing: log10(0 + 1)
    rare = scored.select("row", F.explode("tail").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k")).join(words.hint("merge"), "h")
    rare = rare.groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("added"))
    names = [c for c in scored.columns if c not in {x.split()[0] for x in COLUMNS.split(", ")}]
    out = scored.drop("tail").join(rare, "row", "left")
    added = F.coalesce("added", F.lit(0.0))
    return out.select(
        "doc_id", *names, "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + added).alias("base_score"), (F.col("score") + added).alias("score"),
    )

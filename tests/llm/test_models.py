import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, lbl
from lectern.llm.common import split_remainder

RNG = random.Random(9)
TONGUES = {"aa": "bana lomi tuka".split(), "bb": "schrek pfund kraut".split(), "cc": "voxi quez ñandu".split()}


def sentence(lang, n=30):
    return " ".join(RNG.choice(TONGUES[lang]) + RNG.choice(["", "r", "s", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sentence(lang), lang) for i in range(240) for lang in [RNG.choice(list(TONGUES))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "aa"), (903, "bana " * 40_000, None), (904, sentence("cc"), None), (904, sentence("bb"), None), (None, sentence("aa"), "aa")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, score string, n_tokens int")


def test_remainders(docs):
    for r in docs.select("doc_id", split_remainder(7).alias("m")).collect():
        assert r.m == zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7


def brute_grams(text):
    """The 2- to 4-character grams of the normalised text, as strings."""
    plain = " ".join(re.split(r"[\x00-\x20\x7f-\xa0\s]+", text)).strip().lower()
    return [plain[i : i + n] for n in (2, 3, 4) for i in range(len(plain) - n + 1)]


def brute_bucket(gram):
    """The bucket of one gram, letter by letter in Python integers."""
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return h * 0xBF58476D1CE4E5B9 % 2**64 >> 48


@pytest.mark.parametrize("most", [4, 17, 1000])
def test_grams_by_brute_force(most):
    texts = ["ab", "c", "", " x  yz\n", "né", "Straße 語 \U0001f600 end", "\x00\t", "a" * 90]
    got = [[] for _ in texts]
    for own, buckets, many in langid.gram_slices(texts, most):
        at = 0
        for i, n in zip(own, many):
            got[i] += buckets[at : at + n].tolist()
            at += n
    assert [sorted(x) for x in got] == [sorted(map(brute_bucket, brute_grams(t))) for t in texts]


@pytest.mark.parametrize("at_once", [64, 2])
def test_language_against_brute_force_bayes(docs, at_once, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", at_once)
    monkeypatch.setattr(langid, "BLOCK", 1000)
    model = langid.fit(docs, split_remainder(5) != 0)
    rows = docs.select("doc_id", "text", "lang", (split_remainder(5) != 0).alias("train")).collect()
    counts, seen = {x: Counter() for x in TONGUES}, Counter()
    grams = lambda text: Counter(map(brute_bucket, brute_grams(text)))
    for r in rows:
        if r.train and r.text is not None and r.lang:
            seen[r.lang] += 1
            counts[r.lang].update(grams(r.text))
    assert model.languages == sorted(seen)
    for got in langid.predict(docs, model, F.col("lang").alias("told"), F.col("text").alias("t")).collect():
        if not got.t or got.t == "12 34 !!":
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        own = grams(got.t)
        logs = [math.log(seen[x] / sum(seen.values())) + sum(n * math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536)) for g, n in own.items()) for x in model.languages]
        top = max(logs)
        assert got.lang_pred == model.languages[logs.index(top)]
        assert got.score == pytest.approx(1 / sum(math.exp(x - top) for x in logs), abs=1e-3) and got.score > 0.99
        assert got.told in (None, got.lang_pred)


def test_many_languages_in_bounded_memory():
    """A thousand languages at once: products are held a block at a time, and one text may be long."""
    rng = np.random.default_rng(0)
    log_p = rng.normal(0, 1, (1 << 16, 1000)).astype(np.float32)
    text = "".join(map(chr, rng.integers(97, 123, 30_000)))
    (_, buckets, many) = next(langid.gram_slices([text]))
    tracemalloc.start()
    got = langid.products(buckets, many, log_p)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20  # all at once: 360 MB and more
    tracemalloc.stop()
    assert np.allclose(got[0], np.bincount(buckets, minlength=1 << 16) @ log_p.astype(np.float64), rtol=1e-6, atol=1e-3)


def test_nothing_learned_and_hundreds_of_languages(docs):
    empty = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    each = docs.where("doc_id < 240").withColumn("lang", F.format_string("l%03d", "doc_id")).withColumn("text", F.concat(F.repeat(F.concat(F.hex(F.xxhash64("doc_id")), F.lit("g ")), 9), "text"))
    model = langid.fit(each, F.lit(True))
    assert len(model.languages) == 240 > 3 * langid.LANGUAGES_AT_ONCE
    assert all(r.told == r.lang_pred for r in langid.predict(each, model, F.col("lang").alias("told")).collect())


def brute_base(rows):
    words = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for r in rows:
        if r.train:
            c.update([*words(r.text), None])
    n, v = sum(c.values()), len(c)
    return n, {(r.doc_id, r.text): (len(words(r.text)) + 1, sum(c[w] > 0 for w in [*words(r.text), None]), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(r.text), None])) for r in rows}


@pytest.mark.parametrize("head", [lbl.HEAD, 5])
def test_counts_and_base_by_brute_force(docs, head):
    train = split_remainder(7) != 2
    n, want = brute_base(docs.select("doc_id", "text", train.alias("train")).collect())
    got = lbl.score(docs, train, F.col("text").alias("t"), (~train).alias("held_out"), head=head).collect()
    assert len(got) == docs.count()
    for r in got:
        tokens, known, base = want[r.doc_id, r.t]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5


def test_probabilities_add_up_to_one(docs):
    counts = lbl.count_words(docs).cache()
    v = lbl.gather(counts, 4)
    w = lbl.fit(docs, v)
    rows = [r for r in counts.collect() if r.bucket >= 0]
    head = dict(zip(v.hashes.view(np.int64).tolist(), v.classes.tolist()))
    assert sum(r.n for r in rows) + docs.count() == v.tokens and len(rows) + 1 == v.types
    share = np.zeros(lbl.CLASSES)
    for r in rows:
        k = head.get(r.h, -1)
        share[k if k >= 0 else lbl.SINGLES + r.bucket] += (r.n + 1) / v.mass[k if k >= 0 else lbl.SINGLES + r.bucket]
    share[lbl.SINGLES : lbl.END] += 1 / v.mass[lbl.SINGLES : lbl.END]  # the unknown word of a bucket
    share[lbl.END] += 1
    used = {k for k in head.values() if k >= 0}
    s = lbl.Sequences(pa.array(["bana lomi kraut"]), v)
    totals = np.zeros(len(s.classes))
    for k in range(lbl.CLASSES):
        s.classes = np.full(len(s.classes), v.place[k])
        p = 10 ** lbl.class_log_probs(w, s)
        if k < lbl.SINGLES and k not in used:
            assert v.mass[k] == 0 and p.max() < 1e-12  # an empty class, which no word has
        totals += p * share[k]
    assert np.abs(totals - 1).max() < 1e-6


def test_scores_do_not_depend_on_the_tasks(docs):
    train = split_remainder(7) != 2
    one, many = (sorted((r.n_tokens, r.score) for r in lbl.score(docs.repartition(n), train).collect()) for n in (1, 9))
    assert [x[0] for x in one] == [x[0] for x in many] and np.allclose([x[1] for x in one], [x[1] for x in many], rtol=1e-5)


def test_more_text_is_more_shards(docs):
    """With shards of 500 tokens the same table is trained in many, and the model still gains on its classes' frequencies."""
    counts = lbl.count_words(docs).cache()
    v = lbl.gather(counts)
    s = lbl.Sequences(pa.array([r.text for r in docs.where("doc_id < 200 AND text IS NOT NULL").collect()]), v)
    start, some = (lbl.class_log_probs(w, s).mean() for w in (lbl.start_weights(v), lbl.fit(docs, v, shard_tokens=5000)))
    assert some > start


def test_empty_tables(docs):
    assert lbl.score(docs.limit(0), F.lit(True)).collect() == []
    none = lbl.score(docs.where("doc_id < 3"), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in none] == [(0, 0, 0.0)] * 3 and all(r.score < 0 for r in none)

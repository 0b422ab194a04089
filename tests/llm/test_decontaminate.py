import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import decontaminate as de

RNG = random.Random(2)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(VOCAB[min(399, int(RNG.expovariate(0.02)))] for _ in range(n))


ITEMS = [(i, prose(RNG.randrange(12, 50)) + ". " + prose(6) + ".") for i in range(90)] + [(200, None), (201, ""), (202, "?!"), (None, prose(20)), (203, "Question: who? Answer: nobody"), (5, prose(30))]
BASE = [t or "" for _, t in ITEMS]
DOCS = [(i, prose(RNG.randrange(1, 400))) for i in range(60)]
DOCS += [(100 + k, prose(50) + "\n" + BASE[k].upper().replace(" ", "  ") + "!\n" + prose(80)) for k in range(20)]
DOCS += [(300, None), (301, ""), (302, "?"), (302, BASE[3]), (302, BASE[3]), (None, BASE[4]), (303, prose(60_000) + " " + BASE[7] + " " + prose(100))]


def words(t):
    return re.findall("[a-z0-9]+", t.lower())


def brute_scores(passage):
    docs = [words(t) for t in BASE]
    mean = max(1, sum(map(len, docs)) / len(docs))
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for i, d in enumerate(docs):
        tf = Counter(d)
        impact = {w: idf[w] * n * (de.K1 + 1) / (n + de.K1 * (1 - de.B + de.B * len(d) / mean)) for w, n in tf.items()}
        if impact:
            out[i] = sum(impact.get(w, 0) for w in set(passage)) / sum(impact.values())
    return out


@pytest.mark.parametrize("blocks", [1, 7, 64])
@pytest.mark.parametrize("threshold", [0.15, 0.4])
def test_search_finds_all_above_the_threshold(blocks, threshold):
    index = de.build(list(range(len(BASE))), BASE, blocks)
    texts = [t or "" for _, t in DOCS if not t or len(t) < 10_000]
    terms = de.Terms(pa.array(texts))
    assert [len(words(t)) for t in texts] == terms.count.tolist()
    at = np.minimum(np.searchsorted(index.terms, terms.hashes), len(index.terms) - 1)
    numbers = np.where(index.terms[at] == terms.hashes, at, -1)
    text, starts, stops = de.passages(terms.count, terms.first)
    got = {(k, i): s for k, i, s in de.search_passages(index, numbers, starts, stops, threshold)}
    want = {}
    for k, (t, a, b) in enumerate(zip(text, starts, stops)):
        own = words(texts[t])[a - terms.first[t] : b - terms.first[t]]
        want |= {(k, i): s for i, s in brute_scores(own).items() if s >= threshold}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-5) for x in want)
    covered = [set() for _ in texts]
    for t, a, b in zip(text, starts, stops):
        covered[t] |= set(range(a, b))
    assert [len(c) for c in covered] == terms.count.tolist()


def test_documents(spark):
    docs = spark.createDataFrame([(*d, "x", "y", True) for d in DOCS], "doc_id long, text string, source string, item_ids string, contaminated boolean")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    got = de.search(docs, items, keep=("source",)).collect()
    assert len(got) == len(DOCS)
    for r in got:
        planted = {d for d, _ in DOCS if d is None or 100 <= d < 120 or d == 303}
        if r.doc_id in planted:
            want = {None: 4, 303: 7}.get(r.doc_id, (r.doc_id or 0) - 100)
            assert r.contaminated and want in r.item_ids
        elif r.doc_id != 302:
            assert not r.contaminated, r
    assert sorted(r.item_ids == [3] for r in got if r.doc_id == 302) == [False, True, True]
    assert not any(r.contaminated for r in de.search(docs, items.limit(0)).collect())
    assert de.search(docs.limit(0), items).collect() == []
    part = de.PART_BYTES
    try:
        de.PART_BYTES = 9000
        again = {(r.doc_id, tuple(r.item_ids)) for r in de.search(docs, items).collect()}
        assert again == {(r.doc_id, tuple(r.item_ids)) for r in got}
    finally:
        de.PART_BYTES = part


@pytest.mark.parametrize("length", [65, 100, 200, 300, 500, 1000])
def test_long_items(length):
    texts = [" ".join(f"{w}x{RNG.randrange(40)}" for w in prose(length).split()) for _ in range(8)]
    index = de.build(list(range(len(BASE) + len(texts))), BASE + texts)
    for share in (1, 0.6):
        part = math.ceil(share * length)
        for at in {0, (length - part) // 2, length - part}:
            docs = [prose(RNG.randrange(150)) + " " + " ".join(t.split()[at : at + part]) + " " + prose(70) for t in texts]
            for k, found in enumerate(de._found(index, pa.array([*docs, prose(900)]), de.THRESHOLD, de.QUESTION, de.ANSWER)):
                leaks = [x["item_id"] for x in found if x["leak"]]
                assert leaks == ([len(BASE) + k] if k < len(texts) else [])
                assert all(x["score"] >= de.THRESHOLD - 1e-5 for x in found)


def test_parts_score_as_one_index(spark, monkeypatch):
    docs = spark.createDataFrame([d for d in DOCS if len(d[1] or "") < 10_000], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([*ITEMS, (300, prose(150))], "item_id long, text string")
    found = lambda: sorted((str(r.doc_id), len(r.candidates), str(sorted((str(x.item_id), round(x.score, 6), x.question, x.answer, x.leak) for x in r.candidates))) for r in de.search(docs, items, threshold=0.2).collect())
    one = found()
    monkeypatch.setattr(de, "PART_BYTES", 9000)
    assert found() == one and any(r[1] > 1 for r in one)


def test_answers():
    assert [t[de.answer_start(t) :] for t in ["One two? Three.", "One two", "Q: a\nA: b c", "Answer: x answer: y", "First.\nSecond line"]] == ["Three.", "", " b c", " y", "Second line"]

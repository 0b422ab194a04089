import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import simhash
from lectern.llm.components import components
from lectern.llm.kernels import Words, text_bytes, xxh64


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(texts):
    """For each text the index of the first in its component."""
    prints = [brute_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            group[i] = min(group[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2)
    return group


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (prints[i] ^ prints[j]).bit_count() <= 2] for i in range(len(rows))]
    seen = {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= dict.fromkeys(group, min(ids, default=None))
    return sorted(((d, f"{p:016x}", len(n), seen[i]) for i, ((d, _), p, n) in enumerate(zip(rows, prints, near))), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbÉ語 \t\n\x0b\x1c\xa0."), max_size=30), max_size=8))
def test_words_of_texts(texts):
    words = Words(*text_bytes(pa.array(texts, pa.string())))
    at = 0
    for text, n in zip(texts, words.count):
        want = text.encode().lower().split()
        got = [words.buffer[a : a + s].tobytes() for a, s in zip(words.at[at : at + n], words.size[at : at + n])]
        assert got == want
        at += n
    assert at == len(words.at)


def test_hashes_of_all_sizes():
    data = np.frombuffer(random.Random(1).randbytes(20_000), np.uint8)
    at = np.tile(np.arange(150), 60)
    size = np.repeat(np.arange(60) * 3, 150)
    got = xxh64(data, at, size, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + s].tobytes(), 42) for a, s in zip(at, size)]


def rows_with_copies():
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 5].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, "  \n".join(words).upper()))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (503, "one"), (504, "one two"), (None, "one two"), (None, base[0]), (None, "only here at all"), (600, "x " * 70_000)]
    return rows


@pytest.mark.parametrize("part", ["all", "empty"])
def test_against_brute_force(spark, part):
    rows = rows_with_copies() if part == "all" else []
    docs = spark.createDataFrame([(d, t, "fp", 3) for d, t in rows], "doc_id long, text string, fp string, n long")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_a_chain_of_links(spark):
    prints = [0, 1, 3, 7, 15, 31, 1 << 63, (1 << 63) | (1 << 40), -1 & (2**64 - 1)]
    classes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {(r.x & (2**64 - 1), r.y & (2**64 - 1)) for r in simhash.links(classes).collect()}
    want = {(a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert got <= want and {frozenset(p) for p in got} == {frozenset(p) for p in want} and len(got) * 2 == len(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (70, 71), (71, 70), (70, 71)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(300)}, 70: 70, 71: 70}
    assert components(spark.createDataFrame([(3, 3)], "x long, y long")).collect() == []


def brute_kept(rows):
    """The rows (id, text) that stay: the least of each component by id, then by digest."""
    groups, out = brute_components([t for _, t in rows]), {}
    for (d, t), g in zip(rows, groups):
        key = (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())
        out[g] = min(out.get(g, (key, d, t)), (key, d, t), key=lambda x: x[0])
    return sorted(((d, t or "") for _, d, t in out.values()), key=str)


def test_one_of_each_group_stays(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, _keys string, fp long")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == brute_kept(rows)
    assert simhash.representatives(docs.limit(0)).collect() == []


def test_a_repeated_id_with_another_text_is_not_lost(spark):
    a, b, c = (" ".join(f"{x}{i * 7919 % 83}" for i in range(60)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (9, c), (9, c), (None, b), (None, None), (7, "")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, a), (5, b), (7, ""), (9, c)]

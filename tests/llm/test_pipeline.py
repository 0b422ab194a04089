"""Each stage against a brute-force version over its own input."""

import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from lectern.llm import line_rules
from lectern.llm.queries import tokenizer
from lectern.llm.tokens import Encoder
from lectern.session import table, written
from tests.llm.test_line_rules import brute as brute_rules
from tests.llm.test_simhash import brute as brute_groups


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = [docs]
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), "stage")
        seen.append(docs)
    return [d.toPandas() for d in seen]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "toxicity", "near duplicates", "decontamination", "packing"]
    for before, after in zip(stages, stages[1:-1]):
        assert list(after.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(after.doc_id) <= set(before.doc_id) and (after.n_chars == after.text.str.len()).all()


def test_quality(stages):
    rows = list(zip(stages[0].doc_id, stages[0].text, stages[0].source))
    want = {r[0]: r[10] for r in brute_rules(rows, line_rules.MIN_DOCS, line_rules.LEAST_KEPT) if r[9]}
    assert dict(zip(stages[1].doc_id, stages[1].text)) == want


def test_toxicity(stages, sf):
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    toxic, clean = (set(labels.doc_id[labels.toxic == k]) & set(stages[1].doc_id) for k in (1, 0))
    kept = set(stages[2].doc_id)
    assert clean <= kept and len(toxic & kept) <= 0.2 * len(toxic)


def test_near_duplicates(stages):
    rows = list(zip(stages[2].doc_id, stages[2].text))
    assert sorted(stages[3].doc_id) == sorted({c for _, _, _, c in brute_groups(rows)})


def test_decontamination(stages, sf):
    plain = lambda t: " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower()))
    items = [plain(t) for t in pq.read_table(f"{sf}/benchmark.parquet").column("text").to_pylist()]
    leaked = {d for d, t in zip(stages[3].doc_id, stages[3].text) if any(i in plain(t) for i in items)}
    assert set(stages[3].doc_id) - set(stages[4].doc_id) == leaked


def test_packing(stages):
    enc = Encoder(tokenizer("word_bpe_49k.json"), memo=False)
    ids = defaultdict(bytes)
    for r in stages[5].sort_values(["doc_id", "start"]).itertuples():
        ids[r.doc_id] += r.tokens
    assert ids == {d: enc.encode(t) + np.array([2], "<u4").tobytes() for d, t in zip(stages[4].doc_id, stages[4].text)}


def test_run(spark, sf, stages):
    assert cp.run(spark, sf).groupBy("doc_id").count().count() == len(stages[4])

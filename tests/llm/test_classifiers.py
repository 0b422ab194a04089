import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import chains, linear, ordinal

RNG = random.Random(5)
CLEAN = [f"plain{i}" for i in range(300)]


def text(*extra):
    return " ".join([*RNG.sample(CLEAN, 40), *extra])


def test_features_are_distinct_words_and_grams():
    key, count = linear.features(pa.array(["abcdef ABCDEF", "", "abcd", "\t\n"]))
    assert count.tolist() == [1 + 3 + 2 + 3, 3, 1 + 1 + 0 + 3, 3] or count[1] == count[3]
    one, _ = linear.features(pa.array(["abcdef abcdef"]))
    assert key[: count[0]].tolist() == one.tolist()


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = [], []
    for i in range(900):
        rude, threat = RNG.random() < 0.3, RNG.random() < 0.2
        grade = RNG.randrange(4)
        words = ["grobian" + RNG.choice("abc")] * rude + ["drohung" + RNG.choice("xyz")] * (threat and rude) + [f"stufe{k}" for k in range(grade)]
        rows.append((i, text(*words), "x", 0.5))
        if i < 600:
            labels.append((i, int(rude), int(threat and rude), grade, i % 2))
    rows += [(5000, None, None, None), (5001, "", "x", 1.0), (5001, "grobiana " * 30_000, "x", 1.0), (None, "grobiana", "x", 1.0)]
    labels += [(None, 1, 1, 1, 1), (7, None, None, None, 0), (99999, 1, 1, 1, 1), (8, 1, 1, 3, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, key string, p_rude double"),
        spark.createDataFrame(labels, "doc_id long, rude int, threat int, grade int, text int"),
    )


def test_chain_on_held_out_documents(spark, corpus):
    docs, labels = corpus
    names = {"rude": "rude", "threat": "threat"}
    chain = chains.fit_chain(docs, labels, names)
    assert chain.links[1].shape == (1,) and chain.links[1][0] > 0
    got = chains.predict(docs, chain, list(names), keep=("key",)).collect()
    assert len(got) == docs.count() and {len(r) for r in got} == {6}
    texts = {r.doc_id: r.text for r in docs.where("doc_id between 600 and 899").collect()}
    wrong = sum((r.is_rude != ("grobian" in texts[r.doc_id])) + (r.is_threat != ("drohung" in texts[r.doc_id])) for r in got if r.doc_id in texts)
    assert wrong <= 6
    assert [r.is_rude for r in got if r.doc_id is None] == [True]
    # far-apart tables: nothing labelled
    none = chains.fit_chain(docs, labels.where("doc_id > 90000"), names)
    assert none is None and not any(r.is_rude for r in chains.predict(docs.limit(5), none, list(names)).collect())
    assert chains.predict(docs.limit(0), chain, list(names)).collect() == []
    alone = chains.fit_chain(docs, labels.where("rude = 0"), names)
    assert not any(r.is_rude for r in chains.predict(docs.where("doc_id < 50"), alone, list(names)).collect())


def test_ordinal_on_held_out_documents(corpus):
    docs, labels = corpus
    model = ordinal.fit_ordinal(docs, labels, "grade")
    assert model.grades.tolist() == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in ordinal.predict(docs, model, target=2).collect() if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in docs.where("doc_id between 600 and 899").collect()}
    off = [abs(got[i].expected_grade - sum(f"stufe{k}" in t for k in range(3))) for i, t in texts.items()]
    assert np.mean(off) < 0.35
    assert np.mean([got[i].selected == ("stufe1" in t) for i, t in texts.items()]) > 0.95
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 3 for r in got.values())
    one = ordinal.fit_ordinal(docs, labels.where("grade = 2"), "grade")
    assert {r.expected_grade for r in ordinal.predict(docs.limit(9), one).collect()} == {2.0}
    assert ordinal.fit_ordinal(docs, labels.limit(0), "grade") is None
    assert {(r.expected_grade, r.selected) for r in ordinal.predict(docs.limit(9), None).collect()} == {(None, False)}
    assert ordinal.predict(docs.limit(0), model).collect() == []


def dense(rows, seed=0, columns=40):
    rng = np.random.default_rng(seed)
    x = rng.random((rows, columns)) < rng.uniform(0.05, 0.5, columns)
    return x, linear.Design(np.nonzero(x)[1], x.sum(1))


def brute_contrast(x, y):
    """Log ratios and z values, a column at a time."""
    ratio, z = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        a, b, n1, n0 = x[y == 1, j].sum(), x[y == 0, j].sum(), (y == 1).sum(), (y == 0).sum()
        if a + b and x[:, j].sum() >= linear.LEAST_DOCS:
            p = (a + b) / (n1 + n0)
            ratio[j] = np.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5))
            z[j] = (a / n1 - b / n0) / max(1e-6, np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))
    return ratio, z


def newton_logistic(x, y, links):
    """The ridge logistic regression by Newton steps on dense columns: f of every row as a function."""
    ratio, z = brute_contrast(x, y)
    some = (z >= linear.LEAST_Z) & (ratio >= chains.LEAST_ODDS)
    columns = lambda x, links: np.column_stack([x[:, some] * ratio[some], links, np.ones(len(x))])
    X = columns(x, links)
    ridge = np.full(X.shape[1], linear.RIDGE)
    ridge[-1] = 0
    w = np.zeros(X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(X @ w)))
        h = (X * (p * (1 - p))[:, None]).T @ X / len(y) + np.diag(ridge) + 1e-12 * np.eye(len(w))
        w = w - np.linalg.solve(h, X.T @ (p - y) / len(y) + ridge * w) * 0.7
    return lambda x, links: 1 / (1 + np.exp(-(columns(x, links) @ w)))


def test_chain_is_the_brute_force_one():
    x, design = dense(400)
    rng = np.random.default_rng(1)
    noise = lambda: rng.normal(0, 1.2, len(x))
    first = (2 * x[:, :4].sum(1) + noise() > 2).astype(float)
    second = (2.5 * first + x[:, 4:7].sum(1) + noise() > 3.2).astype(float)
    chain = chains.chain_of(design, np.column_stack([first, second]), ["a", "b"])
    none = np.zeros((len(x), 0))
    p1 = newton_logistic(x, first, none)(x, none)
    fold = np.arange(len(x)) % chains.FOLDS
    out = np.zeros(len(x))
    for f in range(chains.FOLDS):
        fit = newton_logistic(x[fold != f], first[fold != f], none[fold != f])
        out[fold == f] = fit(x[fold == f], none[fold == f])
    p2 = newton_logistic(x, second, out[:, None])(x, p1[:, None])
    products = np.column_stack([design.times(w[design.used]) for w in chain.weights])
    assert np.abs(chain.probabilities(products) - np.column_stack([p1, p2])).max() < 1e-3
    assert chain.links[1][0] > 0.1


def test_ordinal_fit_is_the_brute_force_one():
    x, design = dense(300, 3)
    y = np.clip((x[:, :5].sum(1) + np.random.default_rng(0).normal(0, 0.9, 300)).astype(int), 0, 3)
    weights, t = ordinal.fit_thresholds(design, y, 4)
    assert (np.diff(t) > 0).all()
    # plain gradient steps on dense columns with thresholds of their own
    cuts = [brute_contrast(x, (y > k).astype(int)) for k in range(3)]
    some = np.max([abs(z) for _, z in cuts], axis=0) >= linear.LEAST_Z
    X = x[:, some] * (sum(r for r, _ in cuts) / 3)[some]
    cdf = lambda v: 1 / (1 + np.exp(-v))

    def loss(p):
        w, cut = p[:-3], np.concatenate([[-np.inf], p[-3:], [np.inf]])
        f = X @ w
        return -np.log(cdf(cut[y + 1] - f) - cdf(cut[y] - f)).mean() + linear.RIDGE / 2 * w @ w

    def numeric(p, h=1e-5):
        return np.array([(loss(p + h * e) - loss(p - h * e)) / (2 * h) for e in np.eye(len(p))])

    p = np.concatenate([np.zeros(X.shape[1]), [-1.0, 0.0, 1.0]])
    for _ in range(12):  # Newton with a Hessian of differences
        g = numeric(p)
        hess = np.array([(numeric(p + 1e-4 * e) - g) / 1e-4 for e in np.eye(len(p))])
        p = p - np.linalg.solve((hess + hess.T) / 2 + 1e-6 * np.eye(len(p)), g)
    want = cdf((X @ p[:-3])[:, None] - p[-3:])
    got = 1 / (1 + np.exp(-(design.times(weights)[:, None] - t)))
    assert np.abs(got - want).max() < 1e-3


def test_few_labels_do_not_overrule_their_own_documents(spark, sf):
    """All of 87 labelled documents, 11 of them toxic: none that was fitted on as clean is called toxic."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.is_toxic for r in chains.predict(docs, chains.fit_chain(docs, labels, {"junk": "1 - quality", "toxic": "toxic"}), ["junk", "toxic"]).collect()}
    assert all(got[r.doc_id] == (r.toxic == 1) for r in labels.collect() if r.doc_id in got)


def test_scores_at_the_threshold_are_flagged(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    even = chains.Chain(["x"], np.zeros((1, 1 << linear.BITS)), np.zeros(1), [np.zeros(0)])
    assert [(r.p_x, r.is_x) for r in chains.predict(docs, even, ["x"]).collect()] == [(0.5, True)] * 2
    model = ordinal.Ordinal(np.zeros(1 << linear.BITS, np.float32), np.zeros(1), np.array([0.0, 1.0]))
    assert [r.selected for r in ordinal.predict(docs, model, threshold=0.5).collect()] == [True, True]


def test_labels_choice_is_bounded(corpus):
    docs, labels = corpus
    key, count, y = linear.labelled(docs, labels, ["rude", "grade"], 50)
    assert len(count) == 50 and y.shape == (50, 2) and len(key) == count.sum()


def test_labels_are_counted_after_the_join(spark):
    """Null labels, repeats, and labels of documents that aren't there don't use up the sample."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(200_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS y")
    assert len(linear.labelled(docs, labels, ["y"], 1000)[1]) == 1000
    null = labels.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN y END AS y").where("doc_id < 3000")
    assert len(linear.labelled(docs, null.unionAll(null), ["y"], 1400)[1]) == 1400
    assert len(linear.labelled(docs, null, ["y"], 4000)[1]) == 1500
    two = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, y int")  # of unlike labels the least counts
    assert linear.labelled(docs, two, ["y"], 10)[2].tolist() == [[0.0], [1.0]]

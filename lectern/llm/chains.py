"""Toxicity by a chain of classifiers: each category's model sees the earlier categories' probabilities.

Categories are predicted in turn. The model of a category is a logistic regression over hashed text
features, scaled by their log odds, and over the probabilities of all earlier categories. In training these
come from models fitted without the document's fold, since a model's own training rows would look far too sure.
A category is told by what speaks for it: features that speak against it have no weight, or a long text's
plain words would add up to a no.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.linear import BITS, LEAST_Z, RIDGE, SAMPLE, Design, labelled, minimum, score, sigmoid

FOLDS = 3
THRESHOLD = 0.5
#: The least log odds of a feature with weight: others are in most texts of both kinds.
LEAST_ODDS = 0.7


@dataclass
class Chain:
    """For each category: weights by feature, bias, and weights of the earlier categories' probabilities."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    links: list[np.ndarray]

    def probabilities(self, products: np.ndarray) -> np.ndarray:
        out = np.zeros_like(products)
        for k in range(len(self.names)):
            out[:, k] = sigmoid(products[:, k] + self.bias[k] + out[:, :k] @ self.links[k])
        return out


def fit_link(whole: Design, earlier: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by feature number, bias and link weights from the rows where `rows` is 1.

    They are least for the mean log loss and RIDGE / 2 times the squared weights, those of features before scaling.
    """
    n, k = max(rows.sum(), 1), earlier.shape[1]
    if not 0 < (y * rows).sum() < rows.sum():  # one class alone: its rate for all
        p = np.clip((y * rows).sum() / n, 1e-4, 1 - 1e-4)
        return np.zeros(1 << BITS), float(np.log(p / (1 - p))), np.zeros(k)
    scale, z = whole.contrast(y, rows)
    chosen = (z >= LEAST_Z) & (scale >= LEAST_ODDS)
    design, scale = whole.only(chosen), scale[chosen]
    d = len(scale)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias, link = x[:d], x[d], x[d + 1 :]
        f = design.times(w * scale) + bias + earlier @ link
        error = (sigmoid(f) - y) * rows / n
        value = ((np.logaddexp(0, f) - y * f) * rows).sum() / n + RIDGE / 2 * (w @ w + link @ link)
        return value, np.concatenate([design.transposed(error) * scale + RIDGE * w, [error.sum()], earlier.T @ error + RIDGE * link])

    rate = (y * rows).sum() / n
    x = minimum(loss, np.concatenate([np.zeros(d), [np.log(rate / (1 - rate))], np.zeros(k)]))
    return design.full(x[:d] * scale), float(x[d]), x[d + 1 :]


def chain_of(design: Design, y: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """A chain for the rows of `design` and their categories `y`, a column each; row i is in fold i mod `folds`."""
    rows = len(y)
    fold, earlier, all_rows = np.arange(rows) % folds, np.zeros((rows, 0)), np.ones(rows)
    weights, biases, links = [], [], []
    for k in range(len(names)):
        w, bias, link = fit_link(design, earlier, y[:, k], all_rows)
        weights.append(w)
        biases.append(bias)
        links.append(link)
        if k + 1 < len(names):
            out_of_fold = np.zeros(rows)
            for f in range(folds):
                w, bias, link = fit_link(design, earlier, y[:, k], (fold != f).astype(float))
                out_of_fold = np.where(fold == f, sigmoid(design.times(w[design.used]) + bias + earlier @ link), out_of_fold)
            earlier = np.column_stack([earlier, out_of_fold])
    return Chain(names, np.array(weights), np.array(biases), links)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], folds: int = FOLDS, sample: int = SAMPLE) -> Chain | None:
    """A chain over `categories`, in order: name to a SQL expression over `labels` that is 1, 0 or null.

    None without any labelled document.
    """
    marked = labels.selectExpr("doc_id", *(f"cast({sql} AS double) AS `{name}`" for name, sql in categories.items()))
    key, count, y = labelled(docs, marked, list(categories), sample)
    return chain_of(Design(key, count), y, list(categories), folds) if len(count) else None


def predict(docs: DataFrame, chain: Chain | None, names: list[str], threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, p_<category> (double) and is_<category> (p >= `threshold`) for every row of `docs`.

    Null texts count as empty. Rows that repeat a doc_id, or have none, are scored each for itself. Without a
    chain the probabilities are null and nothing is flagged. An empty table gives no rows.
    """
    schema = ", ".join([f"p_{n} double" for n in names] + [f"is_{n} boolean" for n in names])
    weights = chain.weights if chain else np.zeros((len(names), 1 << BITS), np.float32)

    def finish(products: np.ndarray) -> list:
        if chain is None:
            return [[None] * len(products)] * len(names) + [np.zeros(len(products), bool)] * len(names)
        p = chain.probabilities(products)
        return [*(np.ascontiguousarray(p[:, k]) for k in range(len(names))), *(p[:, k] >= threshold for k in range(len(names)))]

    return score(docs, weights, finish, schema, keep)

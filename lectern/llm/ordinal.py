"""A quality classifier for graded ratings: ordinal regression with cumulative links.

P(grade > k) = sigmoid(f - t_k), where f is one linear score over hashed text features for all grades and
the thresholds t_k ascend. From it come the expected grade and the tail probability of a target grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.linear import BITS, LEAST_Z, RIDGE, SAMPLE, Design, labelled, minimum, score, sigmoid

#: Tail probability from which a document is selected: in doubt it is kept.
THRESHOLD = 0.3
COLUMNS = "expected_grade double, tail_probability double, selected boolean"


@dataclass
class Ordinal:
    """Weights by feature, ascending thresholds, and the grades' values."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def above(self, f: np.ndarray) -> np.ndarray:
        """P(grade > k-th) for each row and threshold."""
        return sigmoid(f[:, None] - self.thresholds)

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.grades[0] + above @ np.diff(self.grades)


def fit_thresholds(design: Design, y: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the design's columns and thresholds for y in 0..grades-1.

    They are least for the mean negative log likelihood and RIDGE / 2 times the squared weights before scaling
    by the features' mean log odds over all cuts of the scale. Features that differ at no cut have no weight.
    """
    n = len(y)
    rates = np.array([(y > k).mean() for k in range(grades - 1)])
    start = -np.log(rates / (1 - rates))
    cuts = [design.contrast((y > k).astype(float)) for k in range(grades - 1)]
    scale = sum(ratio for ratio, _ in cuts) / (grades - 1)
    chosen = np.max([np.abs(z) for _, z in cuts], axis=0) >= LEAST_Z
    design, scale = design.only(chosen), scale[chosen]
    d = len(scale)

    def thresholds(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[:1], x[0] + np.cumsum(np.exp(x[1:]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        t = thresholds(x[d:])
        f = design.times(x[:d] * scale)
        up = np.concatenate([np.ones((n, 1)), sigmoid(f[:, None] - t), np.zeros((n, 1))], axis=1)  # P(y >= k)
        slope = up * (1 - up)
        r = np.arange(n)
        p = np.maximum(up[r, y] - up[r, y + 1], 1e-12)
        by_f = -(slope[r, y] - slope[r, y + 1]) / p / n
        by_t = np.zeros((n, grades + 1))
        by_t[r, y] += slope[r, y] / p / n
        by_t[r, y + 1] -= slope[r, y + 1] / p / n
        per = by_t.sum(0)[1:grades]
        steps = np.exp(x[d + 1 :]) * per[::-1].cumsum()[::-1][1:]
        value = -np.log(p).mean() + RIDGE / 2 * (x[:d] @ x[:d])
        return value, np.concatenate([design.transposed(by_f) * scale + RIDGE * x[:d], [per.sum()], steps])

    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    x = minimum(loss, np.concatenate([np.zeros(d), start[:1], gaps]))
    weights = np.zeros(len(chosen))
    weights[chosen] = x[:d] * scale
    return weights, thresholds(x[d:])


def fit_ordinal(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Ordinal | None:
    """A model of the grades in `labels`; None without any labelled document. One grade alone is predicted for all."""
    key, count, y = labelled(docs, labels, [column], sample)
    if not len(count):
        return None
    grades, y = np.unique(y[:, 0], return_inverse=True)
    if len(grades) == 1:
        return Ordinal(np.zeros(1 << BITS, np.float32), np.zeros(0), grades)
    design = Design(key, count)
    weights, thresholds = fit_thresholds(design, y, len(grades))
    return Ordinal(design.full(weights), thresholds, grades)


def predict(docs: DataFrame, model: Ordinal | None, target: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of grades >= `target`, the highest by default) and selected.

    Null texts count as empty. Rows that repeat a doc_id, or have none, are scored each for itself. Without a
    model grades are null and nothing is selected. An empty table gives no rows.
    """
    weights = model.weights if model else np.zeros(1 << BITS, np.float32)

    def finish(products: np.ndarray) -> list:
        n = len(products)
        if model is None:
            return [[None] * n, [None] * n, np.zeros(n, bool)]
        above = model.above(products[:, 0])
        goal = model.grades[-1] if target is None else target
        k = int(np.searchsorted(model.grades, goal))
        tail = np.ones(n) if k == 0 else np.zeros(n) if k >= len(model.grades) else np.ascontiguousarray(above[:, k - 1])
        return [model.expected(above), tail, tail >= threshold]

    return score(docs, weights[None], finish, COLUMNS)

"""Small retrieval models trained in numpy, one configuration a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPERATURE, NEGATIVES, EPOCHS, HIDDEN = 0.07, 128, 5, 512
#: Training sets are bounded samples: at most so many labelled rows, the first by a hash, are fitted.
MOST_ROWS = 20_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


@dataclass
class Adam:
    """Adam with decoupled weight decay over a list of arrays."""

    rate: float
    decay: float

    def __post_init__(self):
        self.state, self.t = {}, 0

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for i, (p, g) in enumerate(zip(params, grads)):
            m, v = self.state.get(i, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.state[i] = m, v
            p *= 1 - self.rate * self.decay
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def contrastive_gradient(z: np.ndarray, items: np.ndarray, temperature: float = TEMPERATURE) -> tuple[float, np.ndarray]:
    """Mean loss and gradient for unit vectors z of a batch; items[b, 0] is the right vector of z[b], the others wrong ones."""
    score = np.einsum("bd,bnd->bn", z, items) / temperature
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[:, 0] + 1e-12).mean()
    p[:, 0] -= 1
    return float(loss), np.einsum("bn,bnd->bd", p, items) / (temperature * len(z))


def train_query_model(q: np.ndarray, items: np.ndarray, right: np.ndarray, rate: float, decay: float, epochs: int = EPOCHS, hidden: int = HIDDEN, negatives: int = NEGATIVES, batch: int = 64, seed: int = 42):
    """A two-layer network from query to item space; returns a function of queries and the mean losses by epoch."""
    rng = np.random.default_rng(seed)
    a = rng.normal(0, np.sqrt(2 / q.shape[1]), (q.shape[1], hidden))
    c = rng.normal(0, np.sqrt(1 / hidden), (hidden, items.shape[1]))
    b, d = np.zeros(hidden), np.zeros(items.shape[1])
    params, adam, losses = [a, b, c, d], Adam(rate, decay), []
    for _ in range(epochs):
        order, total, steps = rng.permutation(len(q)), 0.0, 0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            wrong = rng.integers(0, len(items), (len(rows), negatives))
            wrong = np.where(wrong == right[rows, None], (wrong + 1) % len(items), wrong)
            h = np.maximum(q[rows] @ a + b, 0)
            y = h @ c + d
            n = np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
            z = y / n
            loss, g = contrastive_gradient(z, items[np.c_[right[rows], wrong]])
            g = (g - z * (g * z).sum(1, keepdims=True)) / n
            back = (g @ c.T) * (h > 0)
            adam.step(params, [q[rows].T @ back, back.sum(0), h.T @ g, g.sum(0)])
            total, steps = total + loss, steps + 1
        losses.append(total / max(steps, 1))
    return (lambda x: unit(np.maximum(x @ a + b, 0) @ c + d)), losses


def propagation(n: int, src: np.ndarray, dst: np.ndarray):
    """A function that applies the normalised adjacency with loops to the rows of a matrix."""
    degree = np.bincount(dst, minlength=n) + 1.0
    w = 1 / np.sqrt(degree[src] * degree[dst])

    def apply(x):
        out = x / degree[:, None]
        np.add.at(out, dst, w[:, None] * x[src])
        return out

    return apply


def refine(x: np.ndarray, spread, w1: np.ndarray, w2: np.ndarray, alpha: float) -> np.ndarray:
    """x plus alpha, held within -1 and 1, times two propagation layers; alpha 0 leaves unit vectors as they are."""
    return unit(x + np.clip(alpha, -1, 1) * (spread(np.maximum(spread(x @ w1), 0) @ w2)))


def grid_search(configs: list[tuple[float, float]], labelled: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(run, rate, decay, loss_first, loss_last, mrr, recall_1, recall_5) for each configuration, trained side by side.

    labelled(q ARRAY, item ARRAY, item_id) holds a query vector and its right item. At most most rows, the least by a hash,
    are fitted and sent to the tasks; a fifth of them is held out for the metrics.
    """
    spark = labelled.sparkSession
    rows = labelled.orderBy(F.xxhash64("item_id", F.col("q")), "item_id").limit(most).toPandas()
    q = np.array(rows["q"].tolist(), np.float64).reshape(len(rows), -1)
    ids, right = np.unique(rows["item_id"].to_numpy(), return_inverse=True) if len(rows) else (np.zeros(0), np.zeros(0, int))
    items = np.zeros((len(ids), len(rows["item"].iloc[0]) if len(rows) else 0))
    if len(rows):
        items[right] = np.array(rows["item"].tolist(), np.float64)
        items = unit(items)
    cut = len(rows) - len(rows) // 5
    schema = "run int, rate double, decay double, loss_first double, loss_last double, mrr double, recall_1 double, recall_5 double"

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if not len(q):
                    continue
                model, losses = train_query_model(q[:cut], items, right[:cut], r.rate, r.decay)
                held = slice(cut, None) if cut < len(q) else slice(0, None)
                score = model(q[held]) @ items.T
                own = score[np.arange(len(score)), right[held]]
                rank = 1 + (score > own[:, None]).sum(1)
                yield pd.DataFrame([(r.run, r.rate, r.decay, losses[0], losses[-1], float((1 / rank).mean()), float((rank <= 1).mean()), float((rank <= 5).mean()))], columns=[c.split()[0] for c in schema.split(", ")])

    grid = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(configs)], "run int, rate double, decay double")
    return grid.repartition(max(1, len(configs))).mapInPandas(run, schema)


def best_run(results: DataFrame, by: str = "mrr") -> DataFrame:
    """The run with the highest value, the first of equal ones."""
    return results.orderBy(F.desc(by), "run").limit(1)

"""Models over the symbol graph: layers with given weights on all nodes, and models fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.operators.cases import modal_source
from equarry.operators.corpus import case_text, equation_text
from equarry.operators.encoding import encode, hashed_terms
from equarry.operators.graph import propagate_all, spread, tied_classes
from equarry.operators.learning import EPOCHS, NEGATIVES, TEMPERATURE, Adam, contrastive_gradient, train_query_model, unit
from equarry.operators.retrieval import indexed, positives, source_split
from equarry.operators.svd import TfIdfSvd
from equarry.session import materialize

#: Bounds of the sample that models are fitted on: cases, and equations as nodes of the graph; the first by a hash.
MOST_CASES, MOST_NODES = 5_000, 3_000
#: Learning rates and weight decays of the query model and of the refiner.
QUERY_GRID = ((1e-3, 0.0), (5e-4, 0.0), (2e-4, 0.0), (1e-3, 1e-4), (5e-4, 1e-4), (2e-4, 1e-4), (1e-3, 1e-3), (5e-4, 1e-3))
REFINER_GRID = ((5e-4, 1e-4), (2e-4, 1e-4), (5e-4, 1e-3))
DROPOUT = 0.1
RESULTS = "run int, method string, rate double, decay double, loss_first double, loss_last double, alpha double, " + ", ".join(f"{s}_{m} {'bigint' if m == 'n' else 'double'}" for s in ("val", "test") for m in ("n", "mrr", "recall_1", "recall_3", "recall_5", "recall_10"))


def _matrix(c: pd.Series) -> np.ndarray:
    return np.array(c.tolist(), np.float64).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def dense(vectors: DataFrame, weight: np.ndarray, bias: np.ndarray | float = 0.0, positive: bool = False) -> DataFrame:
    """vectors(node, x) times weight plus bias, with positive first cut off at 0. The weights go to every task; they don't grow with the data."""

    def run(batches):
        for pdf in batches:
            x = _matrix(pdf["x"])
            yield pd.DataFrame({"node": pdf["node"], "x": list((np.maximum(x, 0) if positive else x) @ weight + bias) if len(pdf) else []})

    return vectors.select("node", "x").mapInPandas(run, "node bigint, x array<double>")


def two_layers(arcs: DataFrame, vectors: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """(node, x): two graph convolutions with the given weights and a rectifier between them, for the nodes of vectors(node, x)."""
    own = materialize(arcs, "arcs")
    hidden = materialize(spread(own, materialize(dense(vectors, first), "layer"), first.shape[1]), "hidden")
    return spread(own, materialize(dense(hidden, second, positive=True), "layer"), second.shape[1])


@dataclass
class Refiner:
    """x plus alpha, held within -1 and 1, times two graph convolutions of x; rows then have length 1."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    alpha: np.ndarray

    @classmethod
    def fresh(cls, dims: int, rng: np.random.Generator) -> Refiner:
        bound = np.sqrt(6 / (2 * dims))
        return cls(rng.uniform(-bound, bound, (dims, dims)), np.zeros(dims), rng.uniform(-bound, bound, (dims, dims)), np.zeros(dims), np.zeros(1))

    def params(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2, self.alpha]

    def forward(self, x: np.ndarray, p: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[np.ndarray, tuple]:
        """The refined rows, and what the gradient needs; p is the normalised adjacency, keep the mask of a dropout."""
        h1 = p @ (x @ self.w1) + self.b1
        r = np.maximum(h1, 0) * keep
        h2 = p @ (r @ self.w2) + self.b2
        y = x + np.clip(self.alpha, -1, 1) * h2
        n = np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
        return y / n, (x, p, keep, h1, r, h2, n)

    def gradients(self, e: np.ndarray, de: np.ndarray, kept: tuple) -> list[np.ndarray]:
        x, p, keep, h1, r, h2, n = kept
        dy = (de - e * (e * de).sum(1, keepdims=True)) / n
        inside = abs(float(self.alpha[0])) <= 1
        d2 = np.clip(self.alpha, -1, 1) * dy
        s2 = p.T @ d2
        d1 = (s2 @ self.w2.T) * keep * (h1 > 0)
        return [x.T @ (p.T @ d1), d1.sum(0), r.T @ s2, d2.sum(0), np.array([(dy * h2).sum() if inside else 0.0])]


def train_refiner(x: np.ndarray, p: np.ndarray, q: np.ndarray, right: list[np.ndarray], rate: float, decay: float, epochs: int = EPOCHS, negatives: int = NEGATIVES, batch: int = 64, dropout: float = DROPOUT, temperature: float = TEMPERATURE, seed: int = 42) -> tuple[Refiner, list[float]]:
    """A refiner fitted to queries q of length 1 and their right rows of x by sampled contrastive loss; and the mean losses by epoch."""
    rng = np.random.default_rng(seed)
    model, losses = Refiner.fresh(x.shape[1], rng), []
    adam = Adam(rate, decay)
    for _ in range(epochs):
        order, total, steps = rng.permutation(len(q)), 0.0, 0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            keep = (rng.random((len(x), model.b1.size)) >= dropout) / (1 - dropout) if dropout else 1.0
            e, kept = model.forward(x, p, keep)
            picked = np.array([[rng.choice(right[i]), *_wrong(rng, len(x), right[i], negatives)] for i in rows])
            score = np.einsum("bd,bnd->bn", q[rows], e[picked]) / temperature
            score -= score.max(1, keepdims=True)
            share = np.exp(score)
            share /= share.sum(1, keepdims=True)
            total, steps = total - float(np.log(share[:, 0] + 1e-12).mean()), steps + 1
            share[:, 0] -= 1
            de = np.zeros_like(e)
            np.add.at(de, picked.ravel(), ((share / (temperature * len(rows)))[:, :, None] * q[rows][:, None]).reshape(-1, x.shape[1]))
            adam.step(model.params(), model.gradients(e, de, kept))
        losses.append(total / max(steps, 1))
    return model, losses


def _wrong(rng: np.random.Generator, n: int, right: np.ndarray, k: int) -> np.ndarray:
    """k rows drawn with replacement that aren't right ones; where all are right any."""
    if len(right) >= n:
        return rng.integers(0, n, k)
    out = rng.integers(0, n, k)
    while (bad := np.isin(out, right)).any():
        out[bad] = rng.integers(0, n, int(bad.sum()))
    return out


def adjacency(symbols: list[list[str]]) -> np.ndarray:
    """The symmetrically normalised adjacency with loops of nodes that share a symbol."""
    names = {s: i for i, s in enumerate(dict.fromkeys(s for x in symbols for s in x))}
    has = np.zeros((len(symbols), len(names)), np.float32)
    for i, x in enumerate(symbols):
        has[i, [names[s] for s in x]] = 1
    a = (has @ has.T > 0).astype(np.float64)
    np.fill_diagonal(a, 1)
    d = 1 / np.sqrt(a.sum(1))
    return a * d[:, None] * d


def ranks(score: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """The place of the best right row for each query, equal scores by row."""
    out = []
    for s, r in zip(score, right):
        best = r[np.lexsort((r, -s[r]))[0]]
        out.append(1 + int(((s > s[best]) | (s == s[best]) & (np.arange(len(s)) < best)).sum()))
    return np.array(out, np.int64)


def _measured(rank: np.ndarray) -> list:
    if not len(rank):
        return [0, 0.0, 0.0, 0.0, 0.0, 0.0]
    return [len(rank), float((1 / rank).mean()), *[float((rank <= k).mean()) for k in (1, 3, 5, 10)]]


@dataclass
class Sample:
    """Cases and equations that models are fitted on: vectors of the nodes in two spaces, their symbols, and of the cases their
    vectors, right nodes and splits."""

    ids: np.ndarray
    x: np.ndarray
    items: np.ndarray
    symbols: list[list[str]]
    q: np.ndarray
    right: list[np.ndarray]
    split: np.ndarray

    def part(self, name: str) -> np.ndarray:
        return np.flatnonzero(self.split == name)


def sample_of(cases: DataFrame, equations: DataFrame, dims: int = 64, rounds: int = 3, load=None, most_cases: int = MOST_CASES, most_nodes: int = MOST_NODES) -> tuple[Sample, TfIdfSvd]:
    """The sample: at most most_cases cases that name an equation of the corpus, and at most most_nodes equations, those they name
    first. Both are the least by a hash, so they repeat. Texts have singular vectors and, by load, an encoder's. A case belongs to the
    split of its source; splits are by source, so no source is in two. Vocabulary and singular vectors are of all equations."""
    svd = TfIdfSvd(equations, dims, rounds)
    rows = indexed(equations)
    right = materialize(positives(cases, rows), "samplepositives")
    split = modal_source(cases).join(source_split(equations), "source", "left").select("row_id", F.coalesce("split", F.lit("train")).alias("split"))
    asked = materialize(right.select("row_id").distinct().orderBy(F.xxhash64("row_id"), "row_id").limit(most_cases), "samplecases")
    named = right.join(asked, "row_id")
    nodes = rows.join(named.select("idx").distinct().withColumn("named", F.lit(1)), "idx", "left").orderBy(F.desc_nulls_last("named"), F.xxhash64("idx"), "idx").limit(most_nodes)
    nodes = materialize(nodes.select(F.col("idx").alias("node"), equation_text().alias("text"), F.coalesce(F.map_keys("variables"), F.array().cast("array<string>")).alias("symbols")), "samplenodes")
    as_texts = nodes.select(F.col("node").alias("id"), "text")
    of_nodes = nodes.select("node", "symbols").join(svd.vectors(as_texts), "node").join(encode(nodes, load or hashed_terms(dims)).withColumnRenamed("x", "item"), "node").toPandas().sort_values("node", ignore_index=True)
    ids = of_nodes["node"].to_numpy(np.int64)
    texts = cases.join(asked, "row_id").select(F.col("row_id").alias("id"), case_text().alias("text"))
    of_cases = svd.vectors(texts).join(split.withColumnRenamed("row_id", "node"), "node").join(named.groupBy(F.col("row_id").alias("node")).agg(F.collect_set("idx").alias("right")), "node").toPandas().sort_values("node", ignore_index=True)
    found = [np.searchsorted(ids, np.intersect1d(np.asarray(r, np.int64), ids)) for r in of_cases["right"]]
    there = np.array([i for i, r in enumerate(found) if len(r)], np.int64)
    return Sample(ids, _matrix(of_nodes["x"]), _matrix(of_nodes["item"]), [list(s) for s in of_nodes["symbols"]], _matrix(of_cases["x"])[there], [found[i] for i in there], of_cases["split"].to_numpy(str)[there]), svd


def model_grid(sample: Sample, spark, query_grid=QUERY_GRID, refiner_grid=REFINER_GRID, epochs: int = EPOCHS) -> DataFrame:
    """RESULTS, a row for each configuration, trained side by side on the training sources: the query model from the cases' singular
    vectors to the encoder's space, and the refiner of the equations' singular vectors. Validation and test sources are only
    measured. Without training cases there are no rows."""
    names = [c.split()[0] for c in RESULTS.split(", ")]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                fit = sample.part("train")
                if not len(fit):
                    continue
                if r.method == "q_mlp_to_x":
                    items = unit(sample.items)
                    model, losses = train_query_model(sample.q[fit], items, np.array([sample.right[i][0] for i in fit]), r.rate, r.decay, epochs)
                    score, alpha = model(sample.q) @ items.T, None
                else:
                    p = adjacency(sample.symbols)
                    model, losses = train_refiner(unit(sample.x), p, unit(sample.q)[fit], [sample.right[i] for i in fit], r.rate, r.decay, epochs)
                    score, alpha = unit(sample.q) @ model.forward(unit(sample.x), p)[0].T, float(model.alpha[0])
                said = [_measured(ranks(score[some], [sample.right[i] for i in some])) for some in (sample.part("val"), sample.part("test"))]
                yield pd.DataFrame([[r.run, r.method, r.rate, r.decay, losses[0], losses[-1], alpha, *said[0], *said[1]]], columns=names)

    grid = [("q_mlp_to_x", *x) for x in query_grid] + [("gnn_refine_svd_residual", *x) for x in refiner_grid]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(grid)], "run int, method string, rate double, decay double")
    return table.repartition(max(1, len(grid))).mapInPandas(run, RESULTS)


def refined(equations: DataFrame, vectors: DataFrame, model: Refiner) -> DataFrame:
    """(node, x): a fitted refiner applied to vectors(node, x) of all equations, over their whole graph."""
    tied = tied_classes(equations)
    hidden = propagate_all(equations, materialize(dense(vectors, model.w1), "refiner"), None, tied)
    hidden = materialize(dense(hidden, np.eye(len(model.b1)), model.b1), "hidden")
    far = propagate_all(equations, materialize(dense(hidden, model.w2, positive=True), "refiner"), None, tied)
    alpha, bias = float(np.clip(model.alpha[0], -1, 1)), model.b2

    def run(batches):
        for pdf in batches:
            x, h = _matrix(pdf["x"]), _matrix(pdf["h"])
            yield pd.DataFrame({"node": pdf["node"], "x": list(unit(x + alpha * (h + bias))) if len(pdf) else []})

    return vectors.select("node", "x").join(far.withColumnRenamed("x", "h"), "node").mapInPandas(run, "node bigint, x array<double>")

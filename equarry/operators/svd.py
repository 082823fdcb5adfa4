"""Truncated SVD of the equations' TF-IDF matrix, and ranks by cosine in its space."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.operators.blocks import Block, Vocabulary, best_ranks, in_blocks
from equarry.operators.corpus import case_text, equation_text
from equarry.operators.retrieval import DIGITS, VOCABULARY, indexed, positives
from equarry.session import drop_table, materialize

DIMS, OVERSAMPLED, ROUNDS, SEED = 256, 10, 5, 42
#: The most frequent terms are multiplied as a dense matrix; rows multiplied at once; terms in a row of partial sums.
HEAD, ROWS, SLICE = 1024, 2000, 4096
#: Columns multiplied by a job: bounds what tasks hold and write.
COLUMNS = 67
#: Cases sent to each task at once.
BLOCK = 4096


def _runs(key: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the number of equal ones before it."""
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return np.arange(len(key)) - np.repeat(at, np.diff(np.r_[at, len(key)]))


def _steps(rank: np.ndarray) -> list[np.ndarray]:
    """Places of the elements by rank: each step has at most one element of a key."""
    order = np.argsort(rank, kind="stable")
    return np.split(order, np.cumsum(np.bincount(rank))[:-1]) if len(rank) else []


class Weights:
    """TF-IDF vectors of length 1 of some texts, given as term numbers and counts; product with a matrix and its transpose."""

    def __init__(self, t: list, c: list, idf: np.ndarray, head: int = HEAD):
        n, head = np.array([len(x) for x in t], np.int64), min(head, len(idf))
        row = np.repeat(np.arange(len(t)), n)
        term = np.concatenate([np.zeros(0, np.int64), *t]).astype(np.int64)
        w = np.concatenate([np.zeros(0), *c]) * idf[term]
        w = (w / np.sqrt(np.bincount(row, w * w, len(t)))[row]).astype(np.float32)
        self.dense, far = np.zeros((len(t), head), np.float32), term >= head
        self.dense[row[~far], term[~far]] = w[~far]
        self.row, self.term, self.w = row[far], term[far], w[far, None]

    def times(self, m: np.ndarray) -> np.ndarray:
        out = self.dense @ m[: self.dense.shape[1]]
        for i in _steps(_runs(self.row)):
            out[self.row[i]] += m[self.term[i]] * self.w[i]
        return out

    def add_transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        """Adds the transpose times y to out."""
        out[: self.dense.shape[1]] += self.dense.T @ y
        order = np.argsort(self.term, kind="stable")
        for i in _steps(_runs(self.term[order])):
            i = order[i]
            out[self.term[i]] += y[self.row[i]] * self.w[i]


def blocks(pdf: pd.DataFrame, idf: np.ndarray, head: int = HEAD):
    for at in range(0, len(pdf), ROWS):
        part = pdf.iloc[at : at + ROWS]
        yield part, Weights(part["t"].tolist(), part["c"].tolist(), idf, head)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The transpose of a times b, added up in double precision a slice at a time."""
    return sum(a[at : at + SLICE].T.astype(np.float64) @ b[at : at + SLICE].astype(np.float64) for at in range(0, len(a), SLICE))


def orthonormal(m: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, without directions that are nothing but rounding; overwrites m."""
    for _ in range(2):
        value, basis = np.linalg.eigh(product(m, m))
        keep = value > max(value[-1], 1e-30) * 1e-12
        turn = (basis[:, keep] / np.sqrt(value[keep])).astype(np.float32)
        for at in range(0, len(m), SLICE):
            m[at : at + SLICE, : turn.shape[1]] = m[at : at + SLICE] @ turn
        m = m if keep.all() else m[:, : turn.shape[1]].copy()
    return m


class TfIdfSvd:
    """The dims largest singular values and right singular vectors of the candidates' uncentred TF-IDF matrix, by subspace iteration.

    A round multiplies the matrix' Gram matrix with terms x (dims + OVERSAMPLED) numbers; as the vocabulary is capped these are
    bounded. Each task adds up its rows, and there are as many tasks as cores whatever the number of rows.
    """

    def __init__(self, equations: DataFrame, dims: int = DIMS, rounds: int = ROUNDS, size: int = VOCABULARY, head: int = HEAD):
        self.candidates, self.head = materialize(indexed(equations).select("idx", "key", equation_text().alias("text")), "candidates"), head
        texts = self.candidates.select(F.col("idx").alias("id"), "text")
        self.sc, self.vocabulary = texts.sparkSession.sparkContext, Vocabulary(texts, size)
        self.idf, self.counted = self.vocabulary.idf, self.vocabulary.counted
        self.rows = materialize(self.counted(texts), "tfidf")
        m = np.random.default_rng(SEED).standard_normal((len(self.idf), min(dims + OVERSAMPLED, len(self.idf))), np.float32)
        for _ in range(rounds):
            m = orthonormal(m)
            for at, x in self._gram_times(m):
                m[:, at : at + COLUMNS] = x
        m = orthonormal(m)
        value, basis = np.linalg.eigh(np.concatenate([product(m, x) for _, x in self._gram_times(m)], 1))
        order = np.argsort(-value)[:dims]
        turn = basis[:, order].astype(np.float32)
        for at in range(0, len(m), SLICE):
            m[at : at + SLICE, : turn.shape[1]] = m[at : at + SLICE] @ turn
        self.values, self.basis = np.sqrt(np.maximum(value[order], 0)), m[:, : turn.shape[1]].copy()

    def _gram_times(self, m: np.ndarray):
        """The Gram matrix times COLUMNS columns of m at a time, which may be overwritten then: the driver holds one matrix."""
        for at in range(0, m.shape[1], COLUMNS):
            yield at, self._columns_times(np.ascontiguousarray(m[:, at : at + COLUMNS]))

    def _columns_times(self, m: np.ndarray) -> np.ndarray:
        sent, idf, head = self.sc.broadcast(m), self.idf, self.head

        def run(batches):
            m, total = sent.value, None
            for pdf in batches:
                for _, x in blocks(pdf, idf, head):
                    total = np.zeros_like(m) if total is None else total
                    x.add_transposed(x.times(m), total)
            if total is not None:
                for at in range(0, len(total), SLICE):
                    yield pd.DataFrame({"at": [at], "v": [total[at : at + SLICE].tobytes()]})

        sums = materialize(self.rows.coalesce(self.sc.defaultParallelism).mapInPandas(run, "at int, v binary"), "svdsums")
        out = np.zeros_like(m)
        for r in sums.toLocalIterator():
            v = np.frombuffer(r["v"], np.float32).reshape(-1, m.shape[1])
            out[r["at"] : r["at"] + len(v)] += v
        sent.destroy()
        drop_table(sums)
        return out

    def vectors(self, texts: DataFrame) -> DataFrame:
        """(node, x): texts(id, text) in the space of the singular vectors, of length 1; 0 for a text without a known term."""
        self.sent = sent = self.sc.broadcast(self.basis)
        idf, head = self.idf, self.head

        def run(batches):
            for pdf in batches:
                for part, x in blocks(pdf, idf, head):
                    yield pd.DataFrame({"node": part["id"], "x": list(unit(x.times(sent.value)))})

        return self.counted(texts).mapInPandas(run, "node bigint, x array<float>")

    def drop(self) -> None:
        """Removes the stored texts and their terms; vectors() needs neither."""
        drop_table(self.candidates)
        drop_table(self.rows)

    def stored_vectors(self, texts: DataFrame) -> DataFrame:
        """vectors() as a stored table; the singular vectors are then removed from all machines' disks."""
        out = materialize(self.vectors(texts), "nodevectors")
        self.sent.destroy()
        return out

    def best_ranks(self, cases: DataFrame) -> DataFrame:
        """(row_id, best_rank): the place of a case's best positive among all candidates by cosine, rounded, equal ones by idx."""
        right = materialize(positives(cases, self.candidates), "positives")
        texts = cases.join(right.select("row_id").distinct(), "row_id", "left_semi").select(F.col("row_id").alias("id"), case_text().alias("text"))
        sent, idf, head = self.sc.broadcast(self.basis), self.idf, self.head

        def asked():
            for pdf in in_blocks(materialize(self.counted(texts), "askedterms"), BLOCK):
                q = np.concatenate([unit(x.times(self.basis)) for _, x in blocks(pdf, idf, head)])

                def scores(pdf, q=q):
                    for part, x in blocks(pdf, idf, head):
                        yield part, np.round(unit(x.times(sent.value)) @ q.T, DIGITS)

                yield Block(pdf["id"].to_numpy(np.int64), scores)

        return best_ranks(self.rows, right, asked())

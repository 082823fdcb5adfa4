"""Dense vectors: cosine search, singular vectors, principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVERY, DIGITS = 100, 6
#: Query vectors sent to each task at once.
BLOCK = 4096


def cosine_top(vectors: DataFrame, k: int = 10, every: int = EVERY) -> DataFrame:
    """(query, place, vec_id, score): for every row whose id is divisible by every the k nearest others of all rows by cosine, equal
    scores by id. Queries go to the tasks in blocks; a task keeps k of its rows for each query."""
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    ids = [r[0] for r in queries.select("vec_id").orderBy("vec_id").collect()]
    out = None
    for at in range(0, max(len(ids), 1), BLOCK):
        block = queries.where(F.col("vec_id").between(ids[at], ids[min(at + BLOCK, len(ids)) - 1])).orderBy("vec_id").toPandas() if ids else pd.DataFrame({"vec_id": [], "embedding": []})
        q_ids = block["vec_id"].to_numpy(np.int64)
        q = np.array(block["embedding"].tolist(), np.float64).reshape(len(q_ids), -1)
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-12

        def nearest(batches, q=q, q_ids=q_ids):
            for pdf in batches:
                if not len(pdf) or not len(q_ids):
                    continue
                v = np.array(pdf["embedding"].tolist(), np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
                score, own = np.round(q @ v.T, DIGITS), pdf["vec_id"].to_numpy()
                score[q_ids[:, None] == own[None]] = -np.inf
                n = min(k, len(own))
                order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :n]
                yield pd.DataFrame({"query": np.repeat(q_ids, n), "vec_id": own[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})

        part = vectors.select("vec_id", "embedding").mapInPandas(nearest, "query bigint, vec_id bigint, score double").where("score >= -2")
        out = part if out is None else out.unionByName(part)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def _gram(batches):
    total = None
    for pdf in batches:
        x = np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), -1)
        if not len(x):
            continue
        part = np.c_[np.r_[[x.sum(0)], x.T @ x], np.zeros(x.shape[1] + 1)]
        part[0, -1] = len(x)
        total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"i": np.repeat(np.arange(total.shape[0]), total.shape[1]), "j": np.tile(np.arange(total.shape[1]), total.shape[0]), "v": total.ravel()})


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and Gram matrix of vectors(x): one dims by dims matrix from each task, added up."""
    rows = vectors.select("x").mapInPandas(_gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(rows):
        return 0, np.zeros(0), np.zeros((0, 0))
    m = np.zeros((rows["i"].max() + 1, rows["j"].max() + 1))
    m[rows["i"], rows["j"]] = rows["v"]
    return int(m[0, -1]), m[0, :-1], m[1:, :-1]


def singular_basis(vectors: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The d largest singular values and right singular vectors (columns) of the uncentred rows; signs make the largest part positive."""
    _, _, gram = moments(vectors)
    value, basis = np.linalg.eigh(gram)
    order = np.argsort(-value)[:d]
    basis = basis[:, order]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return np.sqrt(np.maximum(value[order], 0)), basis


def principal_components(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(node, pc1, pc2, ...): rows of vectors(node, x) less their mean, on the k directions of most variance."""
    n, total, gram = moments(vectors)
    mean = total / max(n, 1)
    value, basis = np.linalg.eigh(gram - n * np.outer(mean, mean))
    basis = basis[:, np.argsort(-value)[:k]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return project(vectors, basis, mean, "pc")


def project(vectors: DataFrame, basis: np.ndarray, mean: np.ndarray | float = 0.0, name: str = "c") -> DataFrame:
    k = basis.shape[1]

    def run(batches):
        for pdf in batches:
            x = (np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), -1) - mean) @ basis if len(pdf) else np.zeros((0, k))
            yield pd.DataFrame({"node": pdf["node"], **{f"{name}{i + 1}": np.round(x[:, i], DIGITS) for i in range(k)}})

    return vectors.select("node", "x").mapInPandas(run, "node bigint, " + ", ".join(f"{name}{i + 1} double" for i in range(k)))

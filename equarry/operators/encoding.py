"""Vectors of texts by an encoder that is handed in, or by hashed terms where there is none."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMS, BATCH, LENGTH = 768, 16, 256


@lru_cache(100_000)
def _place(term: str, dims: int) -> tuple[int, int]:
    h = int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little")
    return h % dims, 1 if h >> 63 else -1


def hashed_terms(dims: int = DIMS, length: int = LENGTH) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder without a model: each of the first length words of a text adds 1 or -1 at a place given by its hash; vectors have
    length 1, those of texts without words are 0."""

    def load():
        def encode(texts):
            out = np.zeros((len(texts), dims), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split()[:length]:
                    at, sign = _place(w, dims)
                    out[i, at] += sign
            return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)

        return encode

    return load


def encode(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, batch: int = BATCH) -> DataFrame:
    """(node, x) of texts(node, text). load is called once in each task and returns a function from batch texts to their vectors,
    such as a pre-trained model's; null texts are read as empty ones. Without load terms are hashed."""
    load = load or hashed_terms()

    def run(batches):
        model = load()
        for pdf in batches:
            said = ["" if t is None else t for t in pdf["text"]]
            rows = [v for at in range(0, len(said), batch) for v in np.asarray(model(said[at : at + batch]), np.float32)]
            yield pd.DataFrame({"node": pdf["node"], "x": rows})

    return texts.select("node", "text").mapInPandas(run, "node bigint, x array<float>")

"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the vocabulary below the folder of public tokenizers, or a path of one's own to a file of ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_lengths(documents: DataFrame, columns: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """columns and n_tokens BIGINT for each document whose text isn't null or empty; texts are read whole."""
    kept = documents.where("text <> ''").select(*columns, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", n_tokens bigint"

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, schema)

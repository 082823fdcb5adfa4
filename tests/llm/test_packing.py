import random
from collections import Counter

import pytest

from equarry.llm import packing, tokens


def check(spark, lengths, capacity):
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, capacity).collect()
    held, used = {}, Counter()
    for r in rows:
        held.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"], r["part"]))
        used[r["container_id"]] += r["n_tokens"]
    assert max(used.values(), default=0) <= capacity
    for i, n in enumerate(lengths):
        parts = sorted(held.get(i, []))
        assert sum(p[1] for p in parts) == n and len(parts) == -(-n // capacity)
        assert [p[0] for p in parts] == [k * capacity for k in range(len(parts))]
    assert sorted(used) == list(range(len(used)))
    return len(used), -(-sum(lengths) // capacity)


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_lengths(spark, seed):
    rng = random.Random(seed)
    lengths = [int(rng.lognormvariate(4, 1.2)) for _ in range(1500)] + [64] * 500 + [0, 1, 256, 257, 1000]
    n, least = check(spark, lengths, 256)
    assert n <= least * 1.02 + 2


def test_only_large_only_small_equal_and_none(spark):
    assert check(spark, [130] * 40, 256)[0] == 40
    assert check(spark, [128] * 41, 256)[0] == 21
    assert check(spark, [3] * 500, 256)[0] == 6
    assert check(spark, [256] * 3 + [600], 256)[0] == 6
    assert check(spark, [], 256)[0] == 0 and check(spark, [0, 0], 256)[0] == 0


def test_configurations_meet_the_demand():
    plan = packing.configurations([70, 50, 35], [9, 14, 23], 128)
    assert [sum(n * p[i] for n, p in plan) for i in range(3)] == [9, 14, 23]
    assert all(70 * p[0] + 50 * p[1] + 35 * p[2] <= 128 for _, p in plan)


def test_documents(spark):
    df = spark.createDataFrame([(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 3000, "x"), (5, "naïve Ω <|endoftext|>", "x")], "doc_id bigint, text string, n string")
    got = packing.pack_documents(df).collect()
    enc = tokens.encoding(tokens.VOCABULARY)
    sums = Counter()
    for r in got:
        sums[r["doc_id"]] += r["n_tokens"]
    assert sums == {1: len(enc.encode_ordinary("one two three")), 4: len(enc.encode_ordinary("word " * 3000)), 5: len(enc.encode_ordinary("naïve Ω <|endoftext|>"))}
    assert packing.fill_report(packing.pack_documents(df.limit(0))).first()["n_containers"] == 0

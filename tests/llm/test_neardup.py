import random
import re
from itertools import combinations

import numpy as np

from equarry.llm import neardup

SCHEMA = "row_id bigint, equation string, context_text string, words string, n int"


def brute(rows):
    sets = {r[0]: set(re.findall(r"[^\W_]+", f"{r[1] or ''} {r[2]}".lower())) for r in rows if r[2] and r[2].strip()}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b]) and (sets[a] or sets[b] or True)}


def sample():
    rng, vocabulary, rows = random.Random(11), [f"w{i}x" for i in range(400)], []
    for i in range(60):
        base = rng.sample(vocabulary, 50)
        for k in range(3):
            words = base[: 50 - 2 * k] + rng.sample(vocabulary, 2 * k)
            rng.shuffle(words)
            rows.append((len(rows), f"x_{i}", " ".join(words) + ".", None, 1))
    return rows + [(500, None, rows[0][2].upper(), "q", 2), (501, "a", None, None, None), (502, "a", " \t", None, None), (503, "", "tiny", "z", 0), (504, None, "tiny!", "z", 0), (505, "", "é" * 5000, "z", 0)]


def test_all_pairs_of_brute_force(spark):
    rows = sample()
    got = {tuple(r) for r in neardup.near_duplicate_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_groups_have_each_row_once(spark):
    rows = sample()
    got = {r["row_id"]: r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == sorted(r[0] for r in rows if r[2] and r[2].strip())
    for a, b in brute(rows):
        assert got[a]["group_id"] == got[b]["group_id"]
    assert got[503]["class_id"] == 503 == got[504]["class_id"] and got[504]["n_copies"] == 2


def test_texts_without_words_and_empty_table(spark):
    df = spark.createDataFrame([(1, "", "..."), (2, None, "?!"), (3, "", "a")], "row_id bigint, equation string, context_text string")
    assert {tuple(r) for r in neardup.near_duplicate_rows(df).collect()} == {(1, 2)}
    assert neardup.near_duplicate_rows(df.limit(0)).collect() == [] and neardup.near_duplicate_groups(df.limit(0)).collect() == []


def test_chance_missed():
    assert neardup.chance_missed(0.7) < 1e-3 and neardup.chance_missed(0.77) < 1e-6


def test_large_classes_are_cut(spark):
    rows = spark.createDataFrame([(i, 0 if i < 25 else 25, 25 if i < 25 else 7) for i in range(32)], "row_id bigint, rep bigint, n bigint")
    classes = spark.createDataFrame([(0, 25), (25, 7)], "rep bigint, n bigint")
    links = spark.createDataFrame([(0, 25)], "a bigint, b bigint")
    got = [tuple(r) for r in neardup.rows_of_links(rows, classes, links, block=3).collect()]
    assert sorted(got) == [(a, b) for a in range(25) for b in range(25, 32)]


def test_index_is_never_broadcast(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    _, reps = neardup.class_of_rows(neardup.word_sets(df))
    plans = []
    held = neardup.materialize
    try:
        neardup.materialize = lambda x, name: plans.append(x._jdf.queryExecution().toString()) or held(x, name)
        neardup.similar_classes(reps)
    finally:
        neardup.materialize = held
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_signatures_share_bytes_as_the_similarity_says():
    rng = np.random.default_rng(3)
    pool, sets, similarity = rng.integers(0, 1 << 63, 400, dtype=np.uint64), [], []
    for _ in range(2000):
        union = rng.choice(400, int(rng.integers(40, 140)), replace=False)
        common = union[: round(0.75 * len(union))]
        half = (len(union) - len(common)) // 2
        sets += [pool[np.r_[common, union[len(common) :][:half]]], pool[np.r_[common, union[len(common) + half :]]]]
        similarity.append(len(common) / len(union))
    sizes = np.array([len(x) for x in sets])
    keys = neardup.signatures(np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    shared = (keys[::2] == keys[1::2]).sum(1)
    assert abs(shared.mean() / (neardup.BLOCKS * np.mean(np.array(similarity) ** neardup.ROWS)) - 1) < 0.05


def test_index_is_cut_and_pairs_of_frequent_words_are_not_stored(spark, monkeypatch):
    """Of the 3,160 pairs of 80 sets that share a third of their words some 160 share a run: all of them were tallied and shuffled."""
    rng, vocabulary = random.Random(5), [f"v{i}x" for i in range(9000)]
    rows = sample() + [(1000 + i, "", " ".join([f"often{k}" for k in range(40)] + rng.sample(vocabulary, 40)), None, 1) for i in range(80)]
    stored, held = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda x, name: stored.setdefault(name, []).append(y := held(x, name)) or y)
    monkeypatch.setattr(neardup, "PASS_CLASSES", 40)
    got = {tuple(r) for r in neardup.near_duplicate_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert 1 < len(stored["tally"]) <= neardup.PASSES
    assert sum(x.where("a >= 1000 and b >= 1000").count() for x in stored["tally"]) < 40

"""Bounds of scores: no pair is above its bound, and few bounds reach what a query's right row scores."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from equarry.operators import blocks

SCHEMA = pa.schema([("id", pa.int64()), ("t", pa.list_(pa.int32())), ("c", pa.list_(pa.int32())), ("symbols", pa.list_(pa.string()))])


def made(n_rows=1200, n_queries=60, size=3000):
    """Rows of words that all share and of rare ones; a query is part of a row, each tenth has no text and each seventh no symbol."""
    rng = np.random.default_rng(6)
    idf = np.log(1 + np.arange(size, 0, -1) / 3)[::-1] + 1
    texts = [np.unique(np.r_[rng.integers(0, 40, 25), (rng.pareto(0.6, 30) * 40).astype(np.int64) % size]) for _ in range(n_rows)]
    symbols = [sorted({f"s{x}" for x in rng.integers(0, 90, rng.integers(0, 7))}) for _ in range(n_rows)]
    rows = pa.Table.from_pylist([{"id": 5 * i, "t": t.tolist(), "c": rng.integers(1, 4, len(t)).tolist(), "symbols": s} for i, (t, s) in enumerate(zip(texts, symbols))], SCHEMA).combine_chunks().to_batches()[0]
    of = rng.permutation(n_rows)[:n_queries]
    t = [np.sort(rng.permutation(texts[i])[: 0 if k % 10 == 9 else 15]) for k, i in enumerate(of)]
    asked = pd.DataFrame({"id": np.arange(n_queries), "t": t, "c": [np.ones(len(x), np.int32) for x in t], "symbols": [[] if k % 7 == 6 else symbols[i] for k, i in enumerate(of)]})
    return rows, asked, idf, of


@pytest.mark.parametrize("near, directions, part", [(512, 64, 2048), (30, 4, 7), (3000, 1, 16)])
def test_no_score_is_above_its_bound(monkeypatch, near, directions, part):
    monkeypatch.setattr(blocks, "NEAR", near)
    monkeypatch.setattr(blocks, "DIRECTIONS", directions)
    monkeypatch.setattr(blocks, "PART", part)
    rows, asked, idf, of = made()
    group = blocks.Group(asked, idf, 0.7, 0.3)
    x, some = blocks._Rows(rows, group), np.arange(0, len(asked), 3)
    n = len(x.ids)
    exact = x.exact(np.repeat(np.arange(n), len(asked)), np.tile(np.arange(len(asked)), n)).reshape(n, -1)
    seen = np.zeros(exact.shape, bool)
    for at, places, m in blocks.Bounds(group, some).of(x):
        assert (m >= exact[at : at + len(m), places] - blocks.SLACK + blocks.HALF).all()
        seen[at : at + len(m), places] = True
    assert seen[:, some].all() and seen.sum() == n * len(some)
    part_of = group.only(some)
    assert np.array_equal(x.under(part_of).exact(np.arange(len(some)), np.arange(len(some))), exact[np.arange(len(some)), some])


def test_few_pairs_are_left_to_be_computed():
    """Before, the score of every pair was estimated from all of its terms."""
    rows, asked, idf, of = made()
    group = blocks.Group(asked, idf, 0.7, 0.3)
    x = blocks._Rows(rows, group)
    right = x.exact(of, np.arange(len(asked)))
    sharp = blocks.Bounds(group).sharp(x, right.astype(np.float32))
    assert sharp[right > 0.5].mean() > 0.8 and not sharp[right < 0.05].any()


def test_places_of_queries_terms_are_found_once():
    """They were searched for each block of pairs that was scored exactly."""
    rows, asked, idf, of = made()
    group = blocks.Group(asked, idf, 0.7, 0.3)
    x, found = blocks._Rows(rows, group), group.begins()
    with_text = group.only(np.flatnonzero(asked["t"].map(len) > 0))
    y = x.under(with_text)
    score = y.exact(of[: len(with_text.ids)], np.arange(len(with_text.ids)))
    assert group.begins() is found and with_text.begins() is with_text.starts and with_text.begins() is not found
    assert np.array_equal(score, x.exact(of[: len(with_text.ids)], with_text.ids))


@pytest.mark.parametrize("gathered", [1, 50, 2_000_000])
def test_terms_are_counted_as_numbers(spark, monkeypatch, gathered):
    """They were counted as texts, one at a time; now in whole batches, of which some are put together."""
    monkeypatch.setattr(blocks, "GATHERED", gathered)
    rng = np.random.default_rng(3)
    lists = [[f"w{min(x, 40)}" for x in rng.pareto(0.5, rng.integers(0, 9)).astype(int)] for _ in range(300)] + [[], ["w1", "w1", "w1"]]
    grams = [[*g, *(f"{a} {b}" for a, b in zip(g, g[1:]))] for g in lists]
    tf, df = Counter(x for g in grams for x in g), Counter(x for g in grams for x in set(g))
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["g"])
    got_tf, got_df = Counter(), Counter()
    for part in blocks._gathered((batch.slice(i, 7) for i in range(0, len(batch), 7)), "g", gathered):
        x = blocks._Terms(part.column("g"))
        words, size = x.words.to_pylist(), len(x.words)
        for key, n, k in (*zip(*blocks._tallied(x.code, x.row, len(part))), *zip(*blocks._tallied(size + x.pairs(x.code, size), x.row[x.first], len(part)))):
            name = words[key] if key < size else f"{words[(key - size) // size]} {words[(key - size) % size]}"
            got_tf[name] += int(n)
            got_df[name] += int(k)
    assert (got_tf, got_df) == (tf, df)
    texts = spark.createDataFrame([(i, " ".join(g)) for i, g in enumerate(lists)], "id bigint, text string")
    assert {r["term"]: (r["tf"], r["df"]) for r in blocks.term_totals(texts).collect()} == {x: (tf[x], df[x]) for x in tf}
    vocabulary = blocks.Vocabulary(texts, 25)
    number = vocabulary.number.value
    assert list(number) == sorted(tf, key=lambda x: (-tf[x], x))[:25]
    for r in vocabulary.counted(texts).collect():
        assert dict(zip(r["t"], r["c"])) == Counter(number[x] for x in grams[r["id"]] if x in number) and r["t"] == sorted(r["t"])


def test_keys_too_large_to_hold_a_row_are_counted():
    key, row = np.array([2**61, 5, 2**61, 5, 2**61]), np.array([0, 1, 0, 2, 3])
    assert [x.tolist() for x in blocks._tallied(key, row, 4)] == [[5, 2**61], [2, 3], [2, 2]]


def test_queries_are_divided_once_in_a_process():
    """Bounds of all queries were made again for each task; what shared symbols may count is added without a pass over all pairs."""
    rows, asked, idf, of = made()
    group = blocks.Group(asked, idf, 0.7, 0.3)
    x, low = blocks._Rows(rows, group), np.full(len(asked), 0.4, np.float32)
    first = group.divided(x, low)
    assert group.divided(x, low) is first and group.__getstate__()["split"] is None
    bounds, blunt, rest = first
    places = np.concatenate([own for own, *_ in bounds.parts])
    assert sorted([*places, *blunt]) == list(range(len(asked))) and np.array_equal(rest.ids, group.ids[blunt])
    q = np.arange(len(asked))
    for at, own, m in bounds.of(x):
        r, j = np.divmod(np.arange(m.size), m.shape[1])
        assert (m.reshape(-1) >= x.exact(at + r, q[own[j]]) - blocks.SLACK + blocks.HALF).all()
    met = np.random.default_rng(1).random((700, 5)) < 0.9
    assert np.array_equal(blocks._many(met), met.sum(0)) and np.array_equal(blocks._many(met[:0]), np.zeros(5))


@pytest.mark.parametrize("k", [1, 5])
def test_best_rows_over_several_choices(spark, k):
    """The best so far are chosen again where many better ones are held, and what isn't among them is dropped before that."""
    rows, asked, idf, _ = made(5200, 60)
    group = blocks.Group(asked, idf, 0.7, 0.3)
    x = blocks._Rows(rows, group)
    n = len(x.ids)
    exact = x.exact(np.repeat(np.arange(n), len(asked)), np.tile(np.arange(len(asked)), n)).reshape(n, -1)
    want = {}
    for q in range(len(asked)):
        order = np.lexsort((x.ids, -exact[:, q]))[:k]
        want[q] = [(int(x.ids[i]), exact[i, q]) for i in order if exact[i, q] > 0]
    df = spark.createDataFrame(pa.Table.from_batches([rows]).to_pandas()[["id", "t", "c", "symbols"]], "id bigint, t array<int>, c array<int>, symbols array<string>").coalesce(1)
    got = {}
    for r in blocks.group_top(df, [group], k).orderBy("row_id", "place").collect():
        got.setdefault(r["row_id"], []).append((r["idx"], r["score"]))
    assert got == {q: x for q, x in want.items() if x}


def test_exact_scores_of_pairs_in_any_order():
    """They are those of single pairs, also where rows come again and in parts."""
    rows, asked, idf, _ = made(200, 40)
    group = blocks.Group(asked, idf, 0.7, 0.3)
    x, rng = blocks._Rows(rows, group), np.random.default_rng(2)
    r, q = rng.integers(0, 200, 3000), rng.integers(0, 40, 3000)
    term = [dict(zip(x.term[a:b].tolist(), x.w[a:b].tolist())) for a, b in zip(x.ends, x.ends[1:])]
    of = [dict(zip(group.term[group.row == i].tolist(), group.w[group.row == i].tolist())) for i in range(40)]
    names = [set(s.as_py()) for s in rows.column("symbols")]
    for i, j, got in zip(r, q, x.exact(r, q)):
        text = sum(w * term[i].get(t, 0.0) for t, w in of[j].items())
        both, either = names[i] & set(asked["symbols"][j]), names[i] | set(asked["symbols"][j])
        assert got == pytest.approx(0.7 * text + 0.3 * (len(both) / max(len(either), 1)), abs=1.1e-6)
    assert not any(grid.any() for grid in x.grids.values())

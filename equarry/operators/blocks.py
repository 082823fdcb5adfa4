"""Queries in blocks against all rows: scores as matrices, ranks by counting, the best k of each task."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equarry.functions.text import terms
from equarry.session import materialize

#: Queries of a block, and rows scored at once.
BLOCK, ROWS = 512, 500
#: Queries sent to the tasks at once, those scored at once, and terms that are multiplied as a dense matrix.
GROUP, PART, HEAD = 32_768, 2048, 256
#: Terms whose weights are bounded, directions in which they are multiplied, rows that show which queries' bounds leave less than LEFT of the pairs,
#: and what single precision may take from a bound.
NEAR, DIRECTIONS, SHOWN, LEFT, SLACK = 512, 64, 500, 0.01, 2e-5
#: Words whose terms are counted at once.
GATHERED = 2_000_000
#: Pairs that are scored exactly at once, rows whose terms are laid out for that, and better pairs that are held before the best are chosen again.
SETTLED, LAID, BETTER = 50_000, 32, 200_000
#: The unit of single precision, and what rounding to DIGITS may move a score by, doubled.
SINGLE, HALF = 2.0**-23, 1.2e-6
DIGITS = 6


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Non-negative numbers to so many digits, halves up."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _gathered(batches, column: str, least: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches put together until their lists in a column have so many elements."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch.column(column).flatten())
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Terms:
    """The words of texts in an Arrow batch as numbers, and where the next word is one of the same text."""

    def __init__(self, words: pa.Array):
        lists = _Lists(words)
        coded = lists.values.dictionary_encode()
        self.words, self.code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists.n)), lists.n)
        self.first = np.flatnonzero(self.row[1:] == self.row[:-1])

    def pairs(self, code: np.ndarray, size: int) -> np.ndarray:
        """The pairs of neighbouring words, one number each, where words have numbers below size."""
        return code[self.first] * size + code[self.first + 1]


def _tallied(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, how often each is there, and in how many rows."""
    names = None
    if len(key) and int(key.max()) >= 2**62 // rows:
        names, key = np.unique(key, return_inverse=True)
    both = np.sort(key * rows + row)
    of = both // max(rows, 1)
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    if not len(begin):
        return begin, begin, begin
    return of[begin] if names is None else names[of[begin]], np.diff(np.r_[begin, len(of)]), np.add.reduceat(np.r_[True, both[1:] != both[:-1]].astype(np.int64), begin)


def term_totals(texts: DataFrame) -> DataFrame:
    """(term, tf, df) of texts(id, text): added up in each Arrow batch first, so that what is shuffled isn't a row for each text's term. Terms
    are counted as numbers and made into texts again when they are sent."""

    def run(batches):
        for batch in _gathered(batches, "g"):
            x, rows = _Terms(batch.column("g")), len(batch)
            size = len(x.words)
            key, tf, df = _tallied(x.code, x.row, rows)
            yield _table("term, tf, df", x.words.take(pa.array(key)), tf, df)
            key, tf, df = _tallied(x.pairs(x.code, size), x.row[x.first], rows)
            if len(key):
                yield _table("term, tf, df", pc.binary_join_element_wise(x.words.take(pa.array(key // size)), x.words.take(pa.array(key % size)), " "), tf, df)

    return texts.select(terms(F.col("text")).alias("g")).mapInArrow(run, "term string, tf bigint, df bigint").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


class _Numbers:
    """A vocabulary's words, and its pairs of words in order, each with its number."""

    def __init__(self, number: dict[str, int]):
        self.words = {}
        pairs = [(self.words.setdefault(a, len(self.words)), self.words.setdefault(b, len(self.words)), i) for (a, _, b), i in ((x.partition(" "), i) for x, i in number.items()) if b]
        self.size = len(self.words)
        pairs = np.array(sorted((a * self.size + b, i) for a, b, i in pairs), np.int64).reshape(-1, 2)
        self.number, self.pair, self.pair_number = number, pairs[:, 0], pairs[:, 1]

    def of(self, x: _Terms) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of each word and pair that the vocabulary has."""
        words = x.words.to_pylist()
        own = np.array([self.number.get(w, -1) for w in words] + [-1], np.int64)[x.code]
        part = np.array([self.words.get(w, -1) for w in words] + [-1], np.int64)[x.code]
        first, known = x.first[(part[x.first] >= 0) & (part[x.first + 1] >= 0)], own >= 0
        key = part[first] * self.size + part[first + 1]
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        met = self.pair[at] == key if len(self.pair) else np.zeros(len(key), bool)
        return np.r_[x.row[known], x.row[first[met]]], np.r_[own[known], self.pair_number[at[met]]]


class Vocabulary:
    """The size terms most frequent in texts(id, text), equally frequent ones by term, numbered in that order; the cap bounds what is
    collected and sent to the tasks."""

    def __init__(self, texts: DataFrame, size: int):
        top = term_totals(texts).orderBy(F.desc("tf"), "term").limit(size).toPandas().sort_values(["tf", "term"], ascending=[False, True])
        self.idf = np.log((1 + texts.count()) / (1 + top["df"].to_numpy(np.float64))) + 1
        self.number = texts.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(top["term"])})

    def counted(self, texts: DataFrame, *carry: str) -> DataFrame:
        """(id, t, c) of texts(id, text) and carry's columns: the numbers of the text's terms in the vocabulary and their counts."""
        number, size = self.number, len(self.idf)
        kept = texts.select("id", terms(F.col("text")).alias("g"), *carry)
        schema = "id bigint, t array<int>, c array<int>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in carry)
        names = ["id", "t", "c", *[f.name for f in kept.schema if f.name in carry]]

        def run(batches):
            numbers = _Numbers(number.value)
            for batch in batches:
                row, t = numbers.of(_Terms(batch.column("g")))
                key, c, _ = _tallied(row * size + t, np.zeros(len(row), np.int64), 1)
                ends = np.searchsorted(key, np.arange(len(batch) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in (key % max(size, 1), c)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *lists, *[batch.column(x) for x in names[3:]]], names)

        return kept.mapInArrow(run, schema)


@dataclass
class Block:
    """Queries in the order of their ids, and a function from rows to (rows, scores of rows x queries), a part at a time."""

    ids: np.ndarray
    scores: Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, np.ndarray]]]


def in_blocks(asked: DataFrame, size: int = BLOCK) -> Iterator[pd.DataFrame]:
    """asked(id, ...), a stored table, in blocks of about size rows by ranges of id; one block is fetched at a time, its lists as arrays."""
    ids = np.sort(asked.select("id").toArrow().column("id").to_numpy())
    for k in range(0, len(ids), size):
        part = ids[k : k + size]
        yield asked.where(F.col("id").between(int(part[0]), int(part[-1]))).toArrow().to_pandas().sort_values("id", ignore_index=True)


def best_ranks(rows: DataFrame, right: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """(row_id, best_rank): the place of each query's best right row among all of rows(id, ...) by score, equal ones by id.

    right(row_id, idx) holds the right rows of queries. A task counts the rows above each query's best right row, so nothing
    is sorted and no pair is written.
    """
    spark = rows.sparkSession
    out, tasks = None, spark.sparkContext.defaultParallelism
    for block in blocks:
        ids, scores = block.ids, block.scores

        def own(batches, ids=ids, scores=scores):
            for pdf in batches:
                for part, m in scores(pdf):
                    for i, asking in enumerate(part["asking"]):
                        yield pd.DataFrame({"row_id": asking, "idx": part["id"].iloc[i], "score": m[i, np.searchsorted(ids, asking)]})

        named = right.where(F.col("row_id").between(int(ids[0]), int(ids[-1]))).groupBy(F.col("idx").alias("id")).agg(F.collect_list("row_id").alias("asking"))
        found = rows.join(named, "id").mapInPandas(own, "row_id bigint, idx bigint, score double").toPandas()
        best = found.sort_values(["row_id", "score", "idx"], ascending=[True, False, True]).drop_duplicates("row_id")
        at = np.searchsorted(ids, best["row_id"].to_numpy(np.int64))
        score_of, idx_of = best["score"].to_numpy(np.float64), best["idx"].to_numpy(np.int64)

        def above(batches, ids=ids[at], at=at, scores=scores, score_of=score_of, idx_of=idx_of):
            n = np.zeros(len(ids), np.int64)
            for pdf in batches:
                for part, m in scores(pdf):
                    m, idx = m[:, at], part["id"].to_numpy(np.int64)[:, None]
                    n += ((m > score_of) & (idx != idx_of) | (m == score_of) & (idx < idx_of)).sum(0)
            yield pd.DataFrame({"row_id": ids, "n": n})

        part = rows.coalesce(tasks).mapInPandas(above, "row_id bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "row_id bigint, best_rank bigint")
    return out.groupBy("row_id").agg((F.sum("n") + 1).alias("best_rank"))


def top(rows: DataFrame, blocks: Iterator[Block], k: int) -> DataFrame:
    """(row_id, idx, score, place): the k best of rows(id, ...) with a score above 0 for each query, equal ones by id. A batch keeps k
    rows for each query."""
    out = None
    for block in blocks:

        def best(batches, block=block):
            for pdf in batches:
                kept = None
                for part, m in block.scores(pdf):
                    own = np.broadcast_to(part["id"].to_numpy(np.int64)[:, None], m.shape)
                    if kept is not None:
                        own, m = np.concatenate([kept[0], own]), np.concatenate([kept[1], m])
                    order = np.lexsort((own, -m), axis=0)[:k]
                    kept = np.take_along_axis(own, order, 0), np.take_along_axis(m, order, 0)
                if kept is not None:
                    good = kept[1] > 0
                    yield pd.DataFrame({"row_id": np.broadcast_to(block.ids, good.shape)[good], "idx": kept[0][good], "score": kept[1][good]})

        part = rows.mapInPandas(best, "row_id bigint, idx bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "row_id bigint, idx bigint, score double, place int")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "idx"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The elements of lists in one array, and the list of each."""
    n = np.array([0 if x is None else len(x) for x in lists], np.int64)
    return np.repeat(np.arange(len(n)), n), np.concatenate([np.zeros(0, np.int64), *[x for x in lists if x is not None and len(x)]])


def unit_weights(t, c, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight): TF-IDF weights of texts given as term numbers and counts, each text's of length 1."""
    row, term = _flat(t)
    term = term.astype(np.int64)
    w = _flat(c)[1] * idf[term]
    return row, term, w / np.sqrt(np.bincount(row, w * w, len(t)))[row]


def _times(n: int, row: np.ndarray, col: np.ndarray, w: np.ndarray | None, m: np.ndarray) -> np.ndarray:
    """A sparse matrix of n rows, its elements in the order of rows, times m."""
    out = np.zeros((n, m.shape[1]))
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(m[col] if w is None else m[col] * w[:, None], first, axis=0)
    return out


class Overlap:
    """Candidates' texts and symbols, ready to be scored against cases: text times the cosine of TF-IDF weights and symbol times the
    Jaccard overlap of symbols, rounded. Both are products of a part of the rows with a block's matrix, so frequent terms and
    symbols need no join."""

    def __init__(self, texts: DataFrame, size: int, with_text: bool = True):
        """texts(id, text, symbols); without with_text only symbols can be scored, and no text is read."""
        self.vocabulary = Vocabulary(texts, size) if with_text else None
        self.rows = materialize(self._counted(texts), "overlaprows")

    def _counted(self, texts: DataFrame) -> DataFrame:
        if self.vocabulary:
            return self.vocabulary.counted(texts, "symbols")
        none = F.array().cast("array<int>")
        return texts.select("id", none.alias("t"), none.alias("c"), "symbols")

    def blocks(self, asked: DataFrame, text: float, symbol: float, size: int = BLOCK) -> Iterator[Block]:
        """asked(id, text, symbols)"""
        idf = self.vocabulary.idf if self.vocabulary else np.zeros(0)
        for q in in_blocks(materialize(self._counted(asked), "asked"), size):
            row, term, w = unit_weights(q["t"].tolist(), q["c"].tolist(), idf)
            known = np.unique(term)
            weights = np.zeros((len(known), len(q)))
            weights[np.searchsorted(known, term), row] = w
            s_row, s = _flat(q["symbols"])
            names, s = np.unique(s.astype(str) if len(s) else np.zeros(0, str), return_inverse=True)
            has = np.zeros((len(names), len(q)))
            has[s, s_row] = 1
            yield Block(q["id"].to_numpy(np.int64), _Scores(idf, known, weights, {x: i for i, x in enumerate(names.tolist())}, has, text, symbol))

    def groups(self, asked: DataFrame, text: float, symbol: float, size: int = GROUP) -> Iterator[Group]:
        """asked(id, text, symbols), a group for each pass over the rows."""
        idf = self.vocabulary.idf if self.vocabulary else np.zeros(0)
        for q in in_blocks(materialize(self._counted(asked), "asked"), size):
            yield Group(q, idf, text, symbol)


def _expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of n."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Lists:
    """A column of lists in an Arrow batch: its elements and where each list begins."""

    def __init__(self, column: pa.Array):
        self.ends = np.asarray(column.offsets).astype(np.int64)
        self.values = column.values[self.ends[0] : self.ends[-1]]
        self.ends = self.ends - self.ends[0]
        self.n = np.diff(self.ends)


class _Postings:
    """For each number below size the places of the queries that have it, with a weight."""

    def __init__(self, key: np.ndarray, place: np.ndarray, weight: np.ndarray, size: int):
        order = np.argsort(key, kind="stable")
        self.n = np.bincount(key, minlength=size)
        self.start = np.cumsum(self.n) - self.n
        self.place, self.weight = place[order].astype(np.int64), weight[order].astype(np.float32)

    def add_to(self, out: np.ndarray, row: np.ndarray, key: np.ndarray, weight: np.ndarray | None, most: bool = False) -> None:
        """Adds weight times the queries' weights to out, rows x queries, for each (row, key); or with most the lesser of both."""
        n = self.n[key]
        met = np.flatnonzero(n)
        row, key, n = row[met], key[met], n[met]
        i = _expanded(self.start[key], n)
        v = self.weight[i]
        if weight is not None:
            (np.minimum if most else np.multiply)(v, np.repeat(weight[met], n), out=v)
        np.add.at(out.reshape(-1), np.repeat(row * out.shape[1], n) + self.place[i], v)


class Group:
    """Queries with their weights and symbols. Scores of all pairs are estimated in single precision: HEAD terms that most pairs share as
    a product of dense matrices, other terms and symbols by adding up what is shared. An estimate is off by no more than the unit of
    single precision for each shared term, so only scores within this bound of the one they are compared with are computed exactly."""

    def __init__(self, q: pd.DataFrame, idf: np.ndarray, text: float, symbol: float):
        self.ids, self.idf, self.text, self.symbol = q["id"].to_numpy(np.int64), idf, text if len(idf) else 0.0, symbol
        self.row, self.term, self.w = unit_weights(q["t"].tolist(), q["c"].tolist(), idf) if self.text else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        s_row, s = _flat(q["symbols"])
        names, s = np.unique(s.astype(str) if len(s) else np.zeros(0, str), return_inverse=True)
        order = np.lexsort((s, s_row))
        self.names, self.s_row, self.s = {x: i for i, x in enumerate(names.tolist())}, s_row[order], s[order].astype(np.int64)
        self.n = np.bincount(self.row, minlength=len(q))
        self.m = np.bincount(self.s_row, minlength=len(q))
        often = np.bincount(self.term, minlength=len(idf)) * np.exp(-idf)
        self.order = np.argsort(-often, kind="stable")[: max(HEAD, NEAR)]
        self.head = self.order[:HEAD]
        self.parts = self.starts = self.split = None

    def margin(self, score: np.ndarray, some=slice(None)) -> np.ndarray:
        """How far an estimate may lie from score without telling on which side of it the rounded exact one is."""
        return HALF + SINGLE * (self.n[some] + 16) * (score + 1e-3)

    def prepared(self):
        """The queries' parts, made once in a task: (from, to, head matrix, postings of other terms, postings of symbols)."""
        if self.parts is None:
            place = np.full(len(self.idf), -1)
            place[self.head] = np.arange(len(self.head))
            self.parts = []
            for at in range(0, len(self.ids), PART):
                to = min(at + PART, len(self.ids))
                a, b = np.searchsorted(self.row, (at, to))
                row, term, w = self.row[a:b] - at, self.term[a:b], self.w[a:b] * self.text
                far = place[term] < 0
                dense = np.zeros((len(self.head), to - at), np.float32)
                dense[place[term[~far]], row[~far]] = w[~far]
                a, b = np.searchsorted(self.s_row, (at, to))
                self.parts.append((at, to, dense, _Postings(term[far], row[far], w[far], len(self.idf)), _Postings(self.s[a:b], self.s_row[a:b] - at, np.ones(b - a), len(self.names))))
            self.place = place
        return self.parts

    def begins(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's terms and symbols begin."""
        if self.starts is None:
            every = np.arange(len(self.ids) + 1)
            self.starts = np.searchsorted(self.row, every), np.searchsorted(self.s_row, every)
        return self.starts

    def only(self, some: np.ndarray) -> Group:
        """The queries at some places, which are in order."""
        out, at = copy.copy(self), np.full(len(self.ids), -1)
        at[some] = np.arange(len(some))
        t, s = at[self.row] >= 0, at[self.s_row] >= 0
        out.ids, out.n, out.m, out.parts, out.starts, out.split = self.ids[some], self.n[some], self.m[some], None, None, None
        out.row, out.term, out.w, out.s_row, out.s = at[self.row[t]], self.term[t], self.w[t], at[self.s_row[s]], self.s[s]
        return out

    def divided(self, x: _Rows, low: np.ndarray) -> tuple[Bounds | None, np.ndarray, Group]:
        """The bounds of queries that leave few pairs above low, as far as some rows show, and the other queries' places and group; made once in a
        process, as any division gives the same counts."""
        if self.split is None:
            sharp, bounds = np.zeros(len(self.ids), bool), None
            if self.text:
                bounds = Bounds(self)
                sharp = bounds.sharp(x, low)
                bounds = Bounds(self, np.flatnonzero(sharp), bounds.turn)
            blunt = np.flatnonzero(~sharp)
            self.split = bounds, blunt, self.only(blunt)
        return self.split

    def __getstate__(self):
        return self.__dict__ | {"parts": None, "starts": None, "split": None}


class Bounds:
    """Upper bounds of the scores of a group's queries. Of NEAR terms that most pairs share, the weights are multiplied in the DIRECTIONS in which the
    queries' are longest; what lies outside of these adds no more than the product of its lengths. All else is added up as in an estimate. A query
    whose right row scores well leaves hardly a pair above its score, and only those are computed exactly."""

    def __init__(self, group: Group, some: np.ndarray | None = None, turn: np.ndarray | None = None):
        """some: places of queries, in order, or all; turn: the directions if they are known."""
        self.near, self.place = group.order[:NEAR], np.full(len(group.idf), -1)
        self.place[self.near] = np.arange(len(self.near))
        self.turn = self._directions(group) if turn is None else turn
        some, begin, s_begin = np.arange(len(group.ids)) if some is None else some, *group.begins()
        self.parts, self.held = [], np.empty(ROWS * min(PART, len(some)), np.float32)
        for at in range(0, len(some), PART):
            own = some[at : at + PART]
            n = begin[own + 1] - begin[own]
            i, row = _expanded(begin[own], n), np.repeat(np.arange(len(own)), n)
            term, w = group.term[i], group.w[i] * group.text
            far = self.place[term] < 0
            sent = self._turned(row[~far], term[~far], w[~far], len(own)).T.copy()
            n = group.m[own]
            i = _expanded(s_begin[own], n)
            symbols = _Postings(group.s[i], np.repeat(np.arange(len(own)), n), np.repeat(group.symbol / np.maximum(n, 1) * (1 + SINGLE), n), len(group.names))
            self.parts.append((own, sent, _Postings(term[far], row[far], w[far], len(group.idf)), symbols))

    def _dense(self, row, term, w, n) -> np.ndarray:
        out = np.zeros((n, len(self.near)), np.float32)
        out[row, self.place[term]] = w
        return out

    def _directions(self, group: Group) -> np.ndarray:
        square = np.zeros((len(self.near), len(self.near)))
        near = self.place[group.term] >= 0
        row, term, w = group.row[near], group.term[near], group.w[near]
        for at in range(0, len(group.ids), PART):
            a, b = np.searchsorted(row, (at, at + PART))
            x = self._dense(row[a:b] - at, term[a:b], w[a:b], PART)
            square += x.T @ x
        return np.linalg.eigh(square)[1][:, ::-1][:, :DIRECTIONS].astype(np.float32)

    def _turned(self, row, term, w, n) -> np.ndarray:
        """Weights in the directions, and the length of what is left, in which single precision may hide as much as is added."""
        x = self._dense(row, term, w, n)
        y = x @ self.turn
        length = np.square(x, dtype=np.float64).sum(1)
        left = np.sqrt(np.maximum(length - np.square(y, dtype=np.float64).sum(1), 0) + 4e-6 * length)
        return np.c_[y, left.astype(np.float32)]

    def of(self, x: _Rows, most: int | None = None):
        """(rows from, places of queries, bounds of rows x queries), of the first rows only if most is given. The bounds are overwritten by the next ones."""
        for at in range(0, len(x.ids) if most is None else min(most, len(x.ids)), ROWS):
            to = min(at + ROWS, len(x.ids))
            own = slice(x.ends[at], x.ends[to])
            row, term, w = x.row[own] - at, x.term[own], x.w[own].astype(np.float32)
            near = self.place[term] >= 0
            turned = self._turned(row[near], term[near], w[near], to - at)
            row, term, w = row[~near], term[~near], w[~near]
            for places, sent, terms_of, symbols_of in self.parts:
                m = np.matmul(turned, sent, out=self.held[: (to - at) * len(places)].reshape(to - at, -1))
                terms_of.add_to(m, row, term, w)
                x.bound_symbols(m, at, to, symbols_of)
                yield at, places, m

    def sharp(self, x: _Rows, low: np.ndarray) -> np.ndarray:
        """Which queries' bounds reach low for less than LEFT of some rows."""
        n, of = np.zeros(len(low)), min(SHOWN, len(x.ids))
        for _, places, m in self.of(x, of):
            n[places] += (m >= low[places] - SLACK).sum(0)
        return n <= LEFT * of


class _Rows:
    """An Arrow batch of rows(id, t, c, symbols) under a group of queries."""

    def __init__(self, batch: pa.RecordBatch, group: Group):
        self.group = group
        self.ids = np.asarray(batch.column("id")).astype(np.int64)
        t, c, s = (_Lists(batch.column(x)) for x in ("t", "c", "symbols"))
        self.row = np.repeat(np.arange(len(self.ids)), t.n)
        self.ends, self.term = t.ends, np.asarray(t.values).astype(np.int64)
        if group.text:
            w = np.asarray(c.values) * group.idf[self.term]
            self.w = w / np.sqrt(np.bincount(self.row, w * w, len(self.ids)))[self.row]
        coded = s.values.dictionary_encode()
        code = np.array([group.names.get(x, -1) for x in coded.dictionary.to_pylist()] + [-1], np.int64)[np.asarray(coded.indices)] if len(s.values) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(self.ids)), s.n)
        self.m, known = s.n, code >= 0
        self.s_row, self.s = row[known], code[known]
        self.s_ends, self.grids, self.used = np.searchsorted(self.s_row, np.arange(len(self.ids) + 1)), {}, {}

    def estimates(self):
        """(rows from, queries from, to, estimates of rows x queries)"""
        g = self.group
        for at in range(0, len(self.ids), ROWS):
            to = min(at + ROWS, len(self.ids))
            parts = g.prepared()
            if g.text:
                own = slice(self.ends[at], self.ends[to])
                row, term, w = self.row[own] - at, self.term[own], self.w[own].astype(np.float32)
                near = g.place[term] >= 0
                dense = np.zeros((to - at, len(g.head)), np.float32)
                dense[row[near], g.place[term[near]]] = w[near]
                row, term, w = row[~near], term[~near], w[~near]
            for first, last, head, terms_of, symbols_of in parts:
                m = dense @ head if g.text else np.zeros((to - at, last - first), np.float32)
                if g.text:
                    terms_of.add_to(m, row, term, w)
                self.add_symbols(m, at, to, symbols_of, g.m[first:last])
                yield at, first, last, m

    def under(self, group: Group) -> _Rows:
        """The same rows under some queries of the group."""
        out = copy.copy(self)
        out.group = group
        return out

    def add_symbols(self, out: np.ndarray, at: int, to: int, postings: _Postings, sizes: np.ndarray) -> None:
        """Adds what shared symbols count for rows from at to to and queries of so many symbols."""
        a, b = np.searchsorted(self.s_row, (at, to))
        if self.group.symbol and b > a:
            both = np.zeros(out.shape, np.float32)
            postings.add_to(both, self.s_row[a:b] - at, self.s[a:b], None)
            either = self.m[at:to, None].astype(np.float32) + sizes.astype(np.float32)
            either -= both
            both /= np.maximum(either, 1, out=either)
            both *= np.float32(self.group.symbol)
            out += both

    def bound_symbols(self, out: np.ndarray, at: int, to: int, postings: _Postings) -> None:
        """Adds no less than what shared symbols count: of sets of n and m symbols that share k, k / max(n, m) is at least k / (n + m - k)."""
        a, b = np.searchsorted(self.s_row, (at, to))
        if self.group.symbol and b > a:
            each = (self.group.symbol / self.m[self.s_row[a:b]] * (1 + SINGLE)).astype(np.float32)
            postings.add_to(out, self.s_row[a:b] - at, self.s[a:b], each, most=True)

    def exact(self, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The rounded scores of pairs of a row's place and a query's place. LAID rows at a time are laid out by term and by symbol, so what a
        query has is looked up and not searched for."""
        g, out = self.group, np.zeros(len(r))
        order = np.argsort(r, kind="stable")
        rows = r[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
        for k in range(0, len(starts), LAID):
            own, ends = rows[starts[k : k + LAID]], np.r_[starts[k : k + LAID], starts[k + LAID] if k + LAID < len(starts) else len(rows)]
            local = np.repeat(np.arange(len(own)), np.diff(ends))
            with_text, with_symbols = g.text and len(self.term), g.symbol and len(self.s)
            if with_text:
                terms = self._laid("terms", own, self.ends, self.term, self.w, len(g.idf))
            if with_symbols:
                symbols = self._laid("symbols", own, self.s_ends, self.s, 1, len(g.names))
            for at in range(ends[0], ends[-1], SETTLED):
                pairs = order[at : min(at + SETTLED, ends[-1])]
                i, b = local[at - ends[0] :][: len(pairs)], q[pairs]
                score = np.zeros(len(pairs))
                if with_text:
                    pair, place, j = self._places(i, b, g.begins()[0], g.term, len(g.idf))
                    score += g.text * np.bincount(pair, terms[place] * g.w[j], len(pairs))
                if with_symbols:
                    pair, place, _ = self._places(i, b, g.begins()[1], g.s, len(g.names))
                    both = np.bincount(pair, symbols[place], len(pairs))
                    score += g.symbol * (both / np.maximum(self.m[r[pairs]] + g.m[b] - both, 1))
                out[pairs] = score
            self._cleared("terms")
            self._cleared("symbols")
        return rounded(out)

    def _laid(self, name: str, own: np.ndarray, ends: np.ndarray, key: np.ndarray, weight, size: int) -> np.ndarray:
        """What each of some rows has for each key, in one array of rows x size that is used again."""
        if len(self.grids.get(name, ())) != LAID * size:
            self.grids[name] = np.zeros(LAID * size, np.float64 if name == "terms" else np.uint8)
        n = ends[own + 1] - ends[own]
        i = _expanded(ends[own], n)
        self.used[name] = np.repeat(np.arange(len(own)) * size, n) + key[i]
        self.grids[name][self.used[name]] = weight if np.isscalar(weight) else weight[i]
        return self.grids[name]

    def _cleared(self, name: str) -> None:
        if name in self.used:
            self.grids[name][self.used.pop(name)] = 0

    @staticmethod
    def _places(i, b, start, key, size):
        """For pairs of a laid row i and a query b: the pair, the place in the laid rows and the query's element, for each element of the query."""
        n = start[b + 1] - start[b]
        j = _expanded(start[b], n)
        return np.repeat(np.arange(len(i)), n), np.repeat(i * size, n) + key[j], j


def _many(met: np.ndarray) -> np.ndarray:
    """How many of each column are true, counted in bytes."""
    return sum((met[i : i + 255].view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(met), 255)), np.zeros(met.shape[1], np.int64))


def _table(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in schema.split(", ")])


def group_ranks(rows: DataFrame, right: DataFrame, groups: Iterator[Group]) -> DataFrame:
    """(row_id, best_rank) as best_ranks, for groups of queries. The rows are read twice for each group: for the scores of the right ones, and
    to count those above the best of them. A group's ranks are stored before the next group is sent, so the driver and the tasks hold one group,
    however many queries there are."""
    spark, out = rows.sparkSession, None
    counted = "row_id bigint, n bigint"
    for group in groups:
        sent = spark.sparkContext.broadcast(group)

        def own(batches, sent=sent):
            for batch in batches:
                if len(batch):
                    asking = np.asarray(batch.column("row_id")).astype(np.int64)
                    x = _Rows(batch, sent.value)
                    yield _table("row_id, idx, score", asking, x.ids, x.exact(np.arange(len(asking)), np.searchsorted(sent.value.ids, asking)))

        named = right.where(F.col("row_id").between(int(group.ids[0]), int(group.ids[-1]))).select("row_id", F.col("idx").alias("id"))
        found = rows.join(F.broadcast(named), "id").mapInArrow(own, "row_id bigint, idx bigint, score double").toPandas()  # a group's names
        best = found.sort_values(["row_id", "score", "idx"], ascending=[True, False, True]).drop_duplicates("row_id")
        at = np.searchsorted(group.ids, best["row_id"].to_numpy(np.int64))
        score_of, idx_of = np.full(len(group.ids), np.inf), np.zeros(len(group.ids), np.int64)
        score_of[at], idx_of[at] = best["score"].to_numpy(np.float64), best["idx"].to_numpy(np.int64)

        def above(batches, sent=sent, at=at, score_of=score_of, idx_of=idx_of):
            group, n = sent.value, np.zeros(len(score_of), np.int64)
            far = group.margin(np.where(np.isfinite(score_of), score_of, 0.0))
            high, low = (score_of + far).astype(np.float32), np.maximum(score_of - far, 1e-30).astype(np.float32)
            held = []

            def settle(x, some=None):
                """Counts the pairs of rows' and queries' places that are held, of all queries or of some."""
                if held:
                    i, j = (np.concatenate(y) for y in zip(*held))
                    held.clear()
                    score, q = x.exact(i, j), j if some is None else some[j]
                    counts = (x.ids[i] != idx_of[q]) & ((score > score_of[q]) | (score == score_of[q]) & (x.ids[i] < idx_of[q]))
                    np.add.at(n, q[counts], 1)

            for batch in batches:
                if not len(batch):
                    continue
                x = _Rows(batch, group)
                bounds, own, blunt = group.divided(x, low)
                own_high, own_low, none = high[own], low[own], np.flatnonzero(score_of[own] == 0)
                for r, places, m in bounds.of(x) if bounds else ():
                    i, j = np.divmod(np.flatnonzero(m >= low[places] - SLACK), m.shape[1])
                    held.append((r + i, places[j]))
                    if sum(len(i) for i, _ in held) > SETTLED:
                        settle(x)
                settle(x)
                y = x.under(blunt)
                for r, first, last, m in y.estimates():
                    over, reached = _many(m > own_high[first:last]), _many(m >= own_low[first:last])
                    n[own[first:last]] += over
                    q = np.flatnonzero(over != reached)
                    i, j = np.nonzero((m[:, q] >= own_low[first:last][q]) & (m[:, q] <= own_high[first:last][q]))
                    held.append((r + i, first + q[j]))
                    if sum(len(i) for i, _ in held) > SETTLED:
                        settle(y, own)
                    if (q := none[(none >= first) & (none < last)] - first).size:
                        n[own[first + q]] += ((m[:, q] == 0) & (x.ids[r : r + len(m), None] < idx_of[own[first + q]])).sum(0)
                settle(y, own)
            yield _table(counted, group.ids[at], n[at])

        part = materialize(rows.mapInArrow(above, counted).groupBy("row_id").agg((F.sum("n") + 1).alias("best_rank")), "groupranks")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "row_id bigint, best_rank bigint") if out is None else out


def group_top(rows: DataFrame, groups: Iterator[Group], k: int) -> DataFrame:
    """(row_id, idx, score, place) as top, for groups of queries; a task keeps k rows for each query. A group's rows are stored before the
    next group is sent, so the driver and the tasks hold one group, however many queries there are."""
    spark, out = rows.sparkSession, None
    schema, place = "row_id bigint, idx bigint, score double", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "idx"))
    for group in groups:
        sent = spark.sparkContext.broadcast(group)

        def best(batches, sent=sent):
            group = sent.value
            last_of = np.zeros(len(group.ids))  # the score of the k-th kept, or 0
            kept, held = [], []  # (query, row, score) in arrays, the first of them the best so far; pairs that aren't scored yet

            def settle():
                every = [np.concatenate(x) for x in zip(*kept)]
                order = np.lexsort((every[1], -every[2], every[0]))
                query = every[0][order]
                begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
                place = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
                order, place = order[place < k], place[place < k]
                kept[:] = [tuple(x[order] for x in every)]
                full = order[place == k - 1]
                last_of[every[0][full]] = every[2][full]

            def score(x):
                """Keeps the held pairs of rows' and queries' places that are among the best so far."""
                if held:
                    i, j = (np.concatenate(y) for y in zip(*held))
                    held.clear()
                    score = x.exact(i, j)
                    good = (score > 0) & (score >= last_of[j])
                    if good.any():
                        kept.append((j[good], x.ids[i[good]], score[good]))
                        if len(kept) > 1 and not last_of.any() or sum(len(y[0]) for y in kept[1:]) > BETTER:
                            settle()

            for batch in batches:
                x, at = _Rows(batch, group), 0
                for r, first, last, m in x.estimates():
                    if r > at or sum(len(i) for i, _ in held) > SETTLED:
                        at = r
                        score(x)
                    far = group.margin(last_of[first:last], slice(first, last))
                    low = np.maximum(last_of[first:last] - far, 1e-30).astype(np.float32)
                    many = np.flatnonzero(_many(m >= low) > 3 * k)
                    if many.size and len(m) > k:
                        own = np.partition(m[:, many], len(m) - k, axis=0)[len(m) - k].astype(np.float64)
                        low[many] = np.maximum(low[many], (own - 2 * group.margin(own, first + many)).astype(np.float32))
                    i, j = np.divmod(np.flatnonzero(m >= low), m.shape[1])
                    held.append((r + i, first + j))
                score(x)
            if kept:
                settle()
                query, row, found = kept[0]
                yield _table(schema, group.ids[query], row, found)

        part = materialize(rows.mapInArrow(best, schema).withColumn("place", place).where(F.col("place") <= k), "grouptop")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema + ", place int") if out is None else out


@dataclass
class _Scores:
    idf: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    names: dict[str, int]
    has: np.ndarray
    text: float
    symbol: float

    def __call__(self, pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for at in range(0, len(pdf), ROWS):
            part = pdf.iloc[at : at + ROWS]
            m = np.zeros((len(part), self.has.shape[1]))
            if self.text and len(self.known):
                row, term, w = unit_weights(part["t"].tolist(), part["c"].tolist(), self.idf)
                col = np.minimum(np.searchsorted(self.known, term), len(self.known) - 1)
                met = self.known[col] == term
                m += self.text * _times(len(part), row[met], col[met], w[met], self.weights)
            if self.symbol and len(self.names):
                lists = [[] if x is None else list(x) for x in part["symbols"]]
                row, col = _flat([[self.names[s] for s in x if s in self.names] for x in lists])
                both = _times(len(part), row, col.astype(np.int64), None, self.has)
                either = np.array([len(x) for x in lists])[:, None] + self.has.sum(0) - both
                m += self.symbol * (both / np.maximum(either, 1))
            yield part, rounded(m)

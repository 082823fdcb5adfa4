"""Ranked retrieval: TF-IDF, set overlap, mixed scores, ranks without a sort, metrics, source splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equarry.functions.text import filled, filled_items, norm, terms
from equarry.operators.blocks import Block, Group, Overlap, group_ranks, group_top
from equarry.operators.cases import case_symbols
from equarry.operators.corpus import candidates, equation_text, keyed_equations
from equarry.operators.skew import places, running_total, slices_for
from equarry.session import materialize

VOCABULARY, TEXT_WEIGHT, SYMBOL_WEIGHT, DIGITS = 50_000, 0.7, 0.3, 6
#: Negatives of a training case, and the increment and factors of the generator (SplitMix64) that draws them.
NEGATIVES, GAMMA, MIX = 128, 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Up to so many candidates' ids go to the tasks as one array; more are joined to the draws.
MOST_SENT = 5_000_000
#: Case rows that serve as queries: every row whose id is divisible by this, against all equations.
EVERY = 100


def grams(t: Column) -> Column:
    """The terms of an array and the pairs of neighbouring ones."""
    pairs = F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat(F.get(t, i - 1), F.lit(" "), F.get(t, i))))
    return F.concat(t, F.coalesce(pairs, F.array().cast("array<string>")))


def term_counts(texts: DataFrame) -> DataFrame:
    """(id, term, tf) of texts(id, text)."""
    return texts.select("id", terms(F.col("text")).alias("t")).select("id", F.explode(grams(F.col("t"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_texts: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(term, tf, idf): the size terms most frequent in the corpus, equally frequent ones by term; idf is ln((1+n)/(1+df))+1."""
    by = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    n = n_texts.agg(F.count(F.lit(1)).alias("n_texts"))  # one row
    return by.orderBy(F.desc("tf"), "term").limit(size).crossJoin(F.broadcast(n)).select("term", "tf", (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, w): tf times idf, each text's vector of length 1; terms outside the vocabulary are dropped before that."""
    raw = counts.drop("df").withColumnRenamed("tf", "c").join(vocab.select("term", "idf"), "term").withColumn("r", F.col("c") * F.col("idf"))
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("length"))
    return raw.join(length, "id").select("id", "term", (F.col("r") / F.col("length")).alias("w"))


def indexed(equations: DataFrame) -> DataFrame:
    """Candidates: one equation for each key, with idx, its place in loading order."""
    return candidates(equations).withColumnRenamed("row_id", "idx")


def query_cases(cases: DataFrame, every: int = EVERY) -> DataFrame:
    return cases.where(F.col("row_id") % every == 0)


class Index:
    """Texts and symbols of the candidates, ready to score cases."""

    def __init__(self, equations: DataFrame):
        self.rows = materialize(indexed(equations), "indexed")
        texts = self.rows.select(F.col("idx").alias("id"), equation_text().alias("text"))
        self.texts, self._stored = texts, {}
        self.symbols = self.rows.select("idx", F.array_distinct(F.filter(F.transform(F.map_keys("variables"), norm), lambda x: x != "")).alias("s")).select("idx", F.explode("s").alias("symbol"), F.size("s").alias("n"))

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = materialize(make(), name)
        return self._stored[name]

    @property
    def counts(self) -> DataFrame:
        return self._once("counts", lambda: term_counts(self.texts))

    @property
    def vocab(self) -> DataFrame:
        return self._once("vocab", lambda: vocabulary(self.counts, self.texts))

    @property
    def weights(self) -> DataFrame:
        return self._once("weights", lambda: weights(self.counts, self.vocab))

    def blocks(self, cases: DataFrame, text: float = TEXT_WEIGHT, symbol: float = SYMBOL_WEIGHT) -> tuple[DataFrame, Iterator[Block]]:
        """The candidates as rows to score, and the cases in blocks with their scores: text times the cosine of the texts and symbol
        times the overlap of the symbols, for those who want every score."""
        rows, overlap, asked = self._asked(cases, text)
        return rows, overlap.blocks(asked, text, symbol)

    def groups(self, cases: DataFrame, text: float = TEXT_WEIGHT, symbol: float = SYMBOL_WEIGHT) -> tuple[DataFrame, Iterator[Group]]:
        """As blocks, but for groups that estimate scores. This is what ranks and best candidates are counted by; the score tables below
        are for those who want every pair."""
        rows, overlap, asked = self._asked(cases, text)
        return rows, overlap.groups(asked, text, symbol)

    def _asked(self, cases: DataFrame, text: float) -> tuple[DataFrame, Overlap, DataFrame]:
        name = "overlap" if text else "overlapsymbols"
        if name not in self._stored:
            symbols = F.array_distinct(F.filter(F.transform(F.map_keys("variables"), norm), lambda x: x != ""))
            self._stored[name] = Overlap(self.rows.select(F.col("idx").alias("id"), equation_text().alias("text"), symbols.alias("symbols")), VOCABULARY, bool(text))
        asked = cases.select(F.col("row_id").alias("id"), norm("context").alias("text"), case_symbols().alias("symbols"))
        return self._stored[name].rows, self._stored[name], asked

    def best(self, cases: DataFrame, k: int, text: float = TEXT_WEIGHT, symbol: float = SYMBOL_WEIGHT) -> DataFrame:
        """(row_id, idx, score, place): the k best candidates of each case."""
        return group_top(*self.groups(cases, text, symbol), k)

    def ranks(self, cases: DataFrame, text: float = TEXT_WEIGHT, symbol: float = SYMBOL_WEIGHT) -> DataFrame:
        """(row_id, best_rank) for each case that names a candidate."""
        right = materialize(positives(cases, self.rows), "positives")
        rows, groups = self.groups(cases.join(right.select("row_id").distinct(), "row_id", "left_semi"), text, symbol)
        return group_ranks(rows, right, groups)

    def text_scores(self, cases: DataFrame) -> DataFrame:
        """(row_id, idx, text_score) for pairs that share a term."""
        q = weights(term_counts(cases.select(F.col("row_id").alias("id"), norm("context").alias("text"))), self.vocab)
        pairs = q.select(F.col("id").alias("row_id"), "term", F.col("w").alias("q")).join(self.weights.select(F.col("id").alias("idx"), "term", "w"), "term")
        return pairs.groupBy("row_id", "idx").agg(F.sum(F.col("q") * F.col("w")).alias("text_score"))

    def symbol_scores(self, cases: DataFrame) -> DataFrame:
        """(row_id, idx, symbol_score): the Jaccard overlap of pairs that share a symbol."""
        q = cases.select("row_id", case_symbols().alias("s")).select("row_id", F.explode("s").alias("symbol"), F.size("s").alias("m"))
        both = q.join(self.symbols, "symbol").groupBy("row_id", "idx").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m"), F.first("n").alias("n"))
        return both.select("row_id", "idx", (F.col("k") / (F.col("m") + F.col("n") - F.col("k"))).alias("symbol_score"))

    def mixed_scores(self, cases: DataFrame, text: float = TEXT_WEIGHT, symbol: float = SYMBOL_WEIGHT) -> DataFrame:
        """(row_id, idx, score), rounded: scores of pairs that share a term or a symbol; all others score 0."""
        both = self.text_scores(cases).join(self.symbol_scores(cases), ["row_id", "idx"], "full")
        return both.select("row_id", "idx", F.round(text * F.coalesce("text_score", F.lit(0.0)) + symbol * F.coalesce("symbol_score", F.lit(0.0)), DIGITS).alias("score"))


def top(scores: DataFrame, k: int, score: str = "score", by: str = "row_id", item: str = "idx") -> DataFrame:
    """The k best items for each by, equal scores in the order of item."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def positives(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, idx): the candidates a case names."""
    ids = cases.select("row_id", F.explode(F.array_distinct(filled_items("correct_model_ids"))).alias("key"))
    return ids.join(rows.select("key", "idx"), "key").select("row_id", "idx")


def best_ranks(scores: DataFrame, right: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, best_rank): the place of the best positive among all candidates by score, equal scores by idx; no sort is needed.

    Candidates without a score have 0. The best positive has the highest score and then the least idx; before it are the
    scored ones above it, and if its own score is 0 also the unscored ones with a smaller idx, counted by its place.
    """
    placed, scores = places(rows.select("idx"), "idx"), materialize(scores, "scores")  # read twice below
    own = right.join(scores, ["row_id", "idx"], "left").select("row_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))
    best = own.groupBy("row_id").agg(F.max(F.struct("score", (-F.col("idx")).alias("i"))).alias("b")).select("row_id", F.col("b.score").alias("s"), (-F.col("b.i")).alias("i"))
    best = best.join(placed.select(F.col("idx").alias("i"), "at"), "i")
    met = scores.where("score > 0").join(best, "row_id", "right")
    above = F.count_if((F.col("score") > F.col("s")) | (F.col("score") == F.col("s")) & (F.col("idx") < F.col("i")))
    before = F.count_if(F.col("idx") < F.col("i"))
    out = met.groupBy("row_id", "s", "at").agg(above.alias("above"), before.alias("before"))
    return out.select("row_id", (F.col("above") + F.when(F.col("s") > 0, 0).otherwise(F.col("at") - F.col("before")) + 1).cast("bigint").alias("best_rank"))


def metrics(ranks: DataFrame, *group: str) -> DataFrame:
    """n, MRR and Recall@1, 3, 5, 10; without rows one row of zeros where there is no group."""
    share = lambda k: F.coalesce(F.round(F.avg(F.when(F.col("best_rank") <= k, 1.0).otherwise(0.0)), DIGITS), F.lit(0.0)).alias(f"recall_{k}")
    return ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg(1.0 / F.col("best_rank")), DIGITS), F.lit(0.0)).alias("mrr"), *map(share, (1, 3, 5, 10)))


def source_split(equations: DataFrame, test: float = 0.2, validation: float = 0.2, seed: str = "42") -> DataFrame:
    """(source, split): sources in the order of a seeded MD5, the first part test, the next validation, the rest train.

    Parts are rounded half to even and hold at least one source, but with validation 0 there are two parts. Places are counted over ranges of the hash, so no task
    holds all sources.
    """
    sources = keyed_equations(equations).select(F.coalesce(filled("source_id"), F.lit("unknown")).alias("source")).distinct()
    n = sources.count()
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "source")), 1, 15), 16, 10).cast("bigint") * 8
    placed = running_total(sources.withColumn("one", F.lit(1)).withColumn("o", order), [], "one", "o", "source", slices_for(n), "at")
    n_test, n_validation = max(1, round(n * test)), max(1, round(n * validation)) if validation else 0
    return placed.select("source", F.when(F.col("at") < n_test, "test").when(F.col("at") < n_test + n_validation, "val").otherwise("train").alias("split"))


def sampled_negatives(cases: DataFrame, rows: DataFrame, n: int = 5, tries: int = 20, seed: str = "42") -> DataFrame:
    """(row_id, place, idx): n candidates for each case drawn with replacement by a hash, positives rejected; a case that names
    nearly all candidates may get fewer. Draws are places, so an equi-join finds them."""
    count = rows.count()
    placed = places(rows.select("idx"), "idx")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string"), F.lit("|"), F.col("t").cast("string"))), 1, 12), 16, 10).cast("bigint") % max(count, 1)
    draws = cases.select("row_id", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("t")).withColumn("at", draw)
    kept = draws.join(placed, "at").join(positives(cases, rows), ["row_id", "idx"], "left_anti")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy("t"))
    return kept.withColumn("place", place).where(F.col("place") <= n).select("row_id", "place", "idx")


def mix64(z: np.ndarray) -> np.ndarray:
    """SplitMix64's output function on unsigned 64-bit numbers."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    return z ^ (z >> np.uint64(31))


def drawn_places(row_ids: np.ndarray, taken: list[np.ndarray], count: int, n: int) -> list[np.ndarray]:
    """For each case the first n draws among count places that aren't taken, with replacement; none where all places are taken.

    Draw t of a case is mix64(mix64(row_id) + t GAMMA) modulo count. Cases that lack some are drawn for again until they have n.
    """
    start, out = mix64(row_ids.astype(np.int64).view(np.uint64)), [np.zeros(0, np.int64) for _ in row_ids]
    left, done, width = np.array([i for i, x in enumerate(taken) if len(x) < count], np.int64), 0, n + 16
    while len(left):
        for part in np.array_split(left, -(-len(left) * width // 1_000_000)):
            t = np.arange(done + 1, done + width + 1, dtype=np.uint64) * np.uint64(GAMMA)
            at = (mix64(start[part, None] + t) % np.uint64(count)).astype(np.int64)
            ban = np.sort(np.concatenate([i * count + np.asarray(taken[r], np.int64) for i, r in enumerate(part)]))
            key = np.arange(len(part))[:, None] * count + at
            free = ban[np.minimum(np.searchsorted(ban, key), len(ban) - 1)] != key if len(ban) else np.ones(at.shape, bool)
            kept, ends = at[free], np.cumsum(free.sum(1))
            for r, x in zip(part, np.split(kept, ends[:-1])):
                out[r] = np.concatenate([out[r], x])[:n] if len(out[r]) else x[:n]
        left, done, width = np.array([r for r in left if len(out[r]) < n], np.int64), done + width, min(width * 2, 65_536)
    return out


def negatives(cases: DataFrame, rows: DataFrame, n: int = NEGATIVES, most_sent: int = MOST_SENT) -> DataFrame:
    """(row_id, negatives): for every case the idx of n candidates that it doesn't name, drawn with replacement, in the order of draws.

    It is empty only where a case names all candidates. A case's draws depend on nothing but its row_id and the candidates.
    """
    placed = places(rows.select("key", "idx"), "idx")
    count = placed.count()
    right = cases.select("row_id", F.explode(F.array_distinct(filled_items("correct_model_ids"))).alias("key")).join(placed.select("key", "at"), "key")
    each = cases.select("row_id").join(right.groupBy("row_id").agg(F.collect_list("at").alias("taken")), "row_id", "left")
    sent = placed.sparkSession.sparkContext.broadcast(np.sort(rows.select("idx").toPandas()["idx"].to_numpy(np.int64))) if count <= most_sent else None

    def run(batches):
        for pdf in batches:
            drawn = drawn_places(pdf["row_id"].to_numpy(), [() if x is None else x for x in pdf["taken"]], count, n)
            yield pd.DataFrame({"row_id": pdf["row_id"], "negatives": [sent.value[x] for x in drawn] if sent else drawn})

    out = each.mapInPandas(run, "row_id bigint, negatives array<bigint>")
    if sent:
        return out
    found = out.select("row_id", F.posexplode("negatives").alias("t", "at")).join(placed.select("at", "idx"), "at").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("t", "idx"))).alias("x"))
    return cases.select("row_id").join(found, "row_id", "left").select("row_id", F.coalesce(F.transform("x", lambda x: x["idx"]), F.array().cast("array<bigint>")).alias("negatives"))

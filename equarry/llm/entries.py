"""Freely typed values mapped to the entries of a reference list by a BK-tree under an edit metric."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import filled, words
from equarry.operators.skew import salted_lookup
from equarry.session import materialize

#: Words without a meaning of their own that an inversion inserts ("rate of drying"); a parameter.
LINKING = ("of", "the")
#: Letters kept of a shortened word that ends with a point.
SHORT = (3, 4, 5)
#: A list with more forms than FORMS is cut into shards by entry; VALUES values at once visit a shard.
FORMS, VALUES = 20_000, 20_000
#: No reading is matched at a larger Levenshtein distance.
MOST_EDITS = 6
#: Costs of values that are read loosely count from here until shards are merged.
LOOSE = 10
#: A qualifier is learned if it has at most WORDS words and stands next to the names of at least ENTRIES entries, in at least a
#: PART-th of the rows of the most frequent one and a LEAST-th of all rows with a name and something beside it.
WORDS, ENTRIES, PART, LEAST = 4, 3, 4, 1000


def split_words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.lower())


def distance(a: str, b: str) -> int:
    """Levenshtein's edit distance, a metric; whole columns are bits of an integer."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return _distance(where, len(a), b)


def _distance(where: dict[str, int], n: int, b: str) -> int:
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for ch in b:
        eq = where.get(ch, 0)
        x = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(diag | up) & full, up & diag
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(x | rise)) & full, rise & x & full
    return score


def typing_distance(a: str, b: str) -> int:
    """Edit distance in which two neighbours exchanged count as one edit; only ranks what the tree has found."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


class BKTree:
    """Strings by their distance to the string above; search returns all within a radius, by the triangle inequality."""

    def __init__(self, strings):
        self.root: tuple[str, dict] | None = None
        for s in strings:
            if self.root is None:
                self.root = (s, {})
                continue
            node = self.root
            while d := distance(s, node[0]):
                if d not in node[1]:
                    node[1][d] = (s, {})
                    break
                node = node[1][d]

    def search(self, query: str, radius: int) -> list[tuple[int, str]]:
        if self.root is None:
            return []
        if not query:
            return []
        where: dict[str, int] = {}
        for i, ch in enumerate(query):
            where[ch] = where.get(ch, 0) | 1 << i
        n, found, stack = len(query), [], [self.root]
        while stack:
            s, below = stack.pop()
            d = _distance(where, n, s)
            if d <= radius:
                found.append((d, s))
            if below:
                stack += [x for k, x in below.items() if d - radius <= k <= d + radius]
        return found


def turns(words: list[str]) -> list[list[str]]:
    """A name's words in the orders an inversion makes: each rotation."""
    return [words[k:] + words[:k] for k in range(len(words))]


def shortened(words: list[str]):
    """Word lists in which one word, two words or every word is cut to its first letters."""
    places = range(len(words))
    for some in [*combinations(places, 1), *combinations(places, 2), tuple(places)]:
        for n in SHORT:
            yield [w[:n] if i in some and len(w) > n + 1 else w for i, w in enumerate(words)]


def name_forms(name_words: list[str], linking=LINKING) -> tuple[set[str], set[str]]:
    """The strings a name may be typed as: its words in each rotation, with and without linking words; and those with shortened words."""
    bare = [w for w in name_words if w not in linking] or name_words
    whole = {"".join(order) for order in [*turns(name_words), *turns(bare)]}
    return whole, {"".join(order) for cut in shortened(bare) for order in turns(cut)} - whole


class Forest:
    """BK-trees as arrays, searched for many strings at once: a level of the tree is a step for all of them.

    Distances are Levenshtein's, a true metric, so a subtree at distance k from its root can hold a string within radius r of
    a query at distance d from that root only if |d - k| <= r. Queries are the patterns of bit-parallel comparisons, a bit for
    each character, up to 64; longer ones are searched one by one.
    """

    def __init__(self, strings):
        self.strings = sorted(set(strings))
        self.tree = BKTree(self.strings)
        index, below, queue = {x: i for i, x in enumerate(self.strings)}, [[] for _ in self.strings], [self.tree.root] if self.strings else []
        while queue:
            name, children = queue.pop()
            below[index[name]] = [(k, index[x[0]]) for k, x in children.items()]
            queue += children.values()
        self.root = index[self.tree.root[0]] if self.strings else -1
        self.count = np.array([len(x) for x in below], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.edge, self.child = (np.array([e[i] for x in below for e in x], np.int64) for i in (0, 1))
        self.size = np.array([len(x) for x in self.strings], np.int64)
        letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.strings))))}
        self.letters = letters  # 0 stands for any other
        self.codes = np.zeros((len(self.strings), int(self.size.max(initial=0))), np.int16)
        for i, x in enumerate(self.strings):
            self.codes[i, : len(x)] = [letters[c] for c in x]

    def _masks(self, queries: list[str]) -> np.ndarray:
        masks = np.zeros((len(queries), len(self.letters) + 1), np.uint64)
        for i, q in enumerate(queries):
            for j, c in enumerate(q):
                if k := self.letters.get(c):
                    masks[i, k] |= np.uint64(1 << j)
        return masks

    def _distances(self, masks: np.ndarray, n: np.ndarray, query: np.ndarray, node: np.ndarray, exchanges: bool = False) -> np.ndarray:
        """Distances of pairs of a query and a node; with exchanges, two neighbours exchanged count as one edit."""
        one, score = np.uint64(1), n[query].copy()
        up, down = np.full(len(query), ~np.uint64(0)), np.zeros(len(query), np.uint64)
        before_eq, before_diag = np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint64)
        top, size = (n[query] - 1).astype(np.uint64), self.size[node]
        for j in range(int(size.max(initial=0))):
            eq = masks[query, self.codes[node, j]]
            diag = (((eq & up) + up) ^ up) | eq | down
            if exchanges:
                diag |= ((~before_diag & eq) << one) & before_eq
                before_eq, before_diag = eq, diag
            rise, fall = down | ~(diag | up), up & diag
            score += np.where(j < size, (rise >> top & one).astype(np.int64) - (fall >> top & one).astype(np.int64), 0)
            rise, fall = rise << one | one, fall << one
            up, down = fall | ~(diag | rise), rise & diag
        return score

    def search(self, queries: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, string, cost) as numbers for all strings within each query's radius; the cost counts exchanges as one edit."""
        short = np.array([i for i, q in enumerate(queries) if 0 < len(q) <= 64], np.int64)
        found = [[], [], []]
        if len(short) and self.strings:
            some, radius_of = [queries[i] for i in short], np.asarray(radius)[short]
            masks, n = self._masks(some), np.array([len(q) for q in some], np.int64)
            query, node = np.arange(len(some)), np.full(len(some), self.root)
            while len(query):
                d = self._distances(masks, n, query, node)
                r = radius_of[query]
                hit = np.flatnonzero(d <= r)
                if len(hit):
                    found[0].append(short[query[hit]])
                    found[1].append(node[hit])
                    found[2].append(self._distances(masks, n, query[hit], node[hit], True))
                k = self.count[node]
                at = np.repeat(self.first[node] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                near = np.abs(self.edge[at] - np.repeat(d, k)) <= np.repeat(r, k)
                query, node = np.repeat(query, k)[near], self.child[at[near]]
        index = None
        for i in set(range(len(queries))) - set(short.tolist()):
            if queries[i] and len(queries[i]) <= self.codes.shape[1] + radius[i]:
                index = index or {x: k for k, x in enumerate(self.strings)}
                for _, x in self.tree.search(queries[i], int(radius[i])):
                    found[0].append([i])
                    found[1].append([index[x]])
                    found[2].append([typing_distance(queries[i], x)])
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in found)


class Readings:
    """What a value may say, given the qualifiers that may stand before and after a name."""

    def __init__(self, before: tuple[str, ...], after: tuple[str, ...], linking: tuple[str, ...]):
        self.linking = set(linking)
        self.plain = {w for q in before + after for w in split_words(q)} | self.linking
        self.noise = {w for q in before + after for w in split_words(q)} | self.linking
        self.noise |= {w[:n] for w in self.noise for n in SHORT[1:] if len(w) > n + 1}
        self.noisy: dict[str, bool] = {}
        self.ends = [("".join(split_words(q)), True) for q in before] + [("".join(split_words(q)), False) for q in after]

    def _noisy(self, w: str) -> bool:
        if w not in self.noisy:
            if len(self.noisy) > 100_000:
                self.noisy.clear()
            self.noisy[w] = w in self.noise or len(w) > 3 and any(len(q) > 3 and abs(len(q) - len(w)) < 2 and typing_distance(w, q) <= 1 for q in self.noise)
        return self.noisy[w]

    def _without_ends(self, text: str, fronts=(True, False)):
        for q, front in self.ends:
            if front in fronts:
                for n in (len(q), len(q) + 1, len(q) - 1):
                    if 0 < n < len(text) - 3:
                        part = text[:n] if front else text[-n:]
                        if part == q or len(q) > 2 and part[0] == q[0] and distance(part, q) <= 1:
                            yield (text[n:] if front else text[:-n]), front

    def of(self, words: list[str]) -> list[str]:
        """Without spaces: as typed, without noisy words, without linking words, and each without a qualifier at either end."""
        out = ["".join(words), "".join(w for w in words if not self._noisy(w)), "".join(w for w in words if w not in self.linking)]
        for text in list(dict.fromkeys(out)):
            for rest, front in self._without_ends(text):
                out.append(rest)
                out += [x for x, _ in self._without_ends(rest, (not front,))]
        return [x for x in dict.fromkeys(out) if x]

    def loosely(self, words: list[str]) -> list[str]:
        """Without words that are exactly those of qualifiers, and without a qualifier typed with two edits, or three if it is long, at one end."""
        out = ["".join(words), "".join(w for w in words if w not in self.plain)]
        for text in out[:]:
            for q, front in self.ends:
                edits = 3 if len(q) > 8 else 2
                for n in range(len(q) - 2, len(q) + 3) if len(q) > 4 else ():
                    if n < len(text) - 3 and distance(text[:n] if front else text[-n:], q) <= edits:
                        out.append(text[n:] if front else text[:-n])
        return [x for x in dict.fromkeys(out) if x]


class Matcher:
    """One shard of a reference list, given as (entry, form, whether shortened), ready for search."""

    def __init__(self, forms: tuple[tuple[int, str, bool], ...], readings: Readings):
        self.readings = readings
        self.known: tuple[dict[str, list[int]], ...] = ({}, {})
        for key, form, short in forms:
            self.known[short].setdefault(form, []).append(key)
        self.forests = tuple(Forest(x) for x in self.known)

    def _exact(self, asked: dict[str, list[tuple[int, int]]], kind: int, cost: int, rows: dict, least: dict) -> None:
        for text, of in asked.items():
            for key in self.known[kind].get(text, ()):
                for i, rank in of:
                    rows.setdefault((i, cost, rank), set()).add(key)
                    least[i] = min(cost, least.get(i, 99))

    def _near(self, asked: dict[str, list[tuple[int, int]]], kind: int, radius: int, base: int, rows: dict, least: dict) -> None:
        texts, forest = list(asked), self.forests[kind]
        for q, s, d in zip(*(x.tolist() for x in forest.search(texts, np.array([min(radius, max(1, len(t) * 2 // 5)) for t in texts], np.int64)))):
            if d <= allowed(len(forest.strings[s])):
                for i, rank in asked[texts[q]]:
                    rows.setdefault((i, base + d, rank), set()).update(self.known[kind][forest.strings[s]])
                    least[i] = min(base + d, least.get(i, 99))

    def best(self, values: list[str]) -> list[tuple[int, int, int, int]]:
        """(value's number, cost, reading's number, entry) for the entries at each value's least cost; of more than two entries of
        a reading the least and the largest. A value is its words and, where it holds a point, a point at the end.

        Radii grow: all forms at cost 1 are within Levenshtein's distance 2, all at cost 2 within 4, and the rest within MOST_EDITS.
        What isn't found at cost 0 or 1 is also read loosely, and its costs count from LOOSE; a shortened form without a point
        must be typed exactly and costs 1. Whether a reading is tried depends on costs that come before it, so shards agree.
        """
        said = [(v.removesuffix(" .").split(), v.endswith(" .")) for v in values]
        strict = [self.readings.of(w) for w, _ in said]
        least: dict[int, int] = {}
        rows: dict[tuple[int, int, int], set[int]] = {}

        def asked(some, readings, points=(True, False), first=0):
            out: dict[str, list[tuple[int, int]]] = {}
            for i in some:
                if said[i][1] in points:
                    for rank, text in enumerate(readings[i], first):
                        out.setdefault(text, []).append((i, rank))
            return out

        every = range(len(said))
        self._exact(asked(every, strict), 0, 0, rows, least)
        self._exact(asked(every, strict, (True,)), 1, 0, rows, least)
        left = [i for i in every if i not in least]
        self._near(asked(left, strict), 0, 2, 0, rows, least)
        self._near(asked(left, strict, (True,)), 1, 2, 0, rows, least)
        left = [i for i in left if i not in least]
        more = {i: [x for x in self.readings.loosely(said[i][0]) if x not in strict[i]] for i in left}
        both = {i: strict[i] + more[i] for i in left}
        self._exact(asked(left, more, first=100), 0, LOOSE, rows, least)
        self._exact(asked(left, more, (True,), 100), 1, LOOSE, rows, least)
        self._exact(asked(left, both, (False,)), 1, LOOSE + 1, rows, least)
        for cost, radius in ((1, 2), (2, 4), (4, MOST_EDITS)):
            left = [i for i in left if least.get(i, 99) > LOOSE + cost]
            readings = more if cost == 1 else both
            self._near(asked(left, readings), 0, radius, LOOSE, rows, least)
            self._near(asked(left, readings, (True,)), 1, radius, LOOSE, rows, least)
        return [(i, d, rank, key) for (i, d, rank), keys in rows.items() if d == least[i] for key in {min(keys), max(keys)}]


@lru_cache(4)
def _matcher(forms, before, after, linking) -> Matcher:
    """A worker keeps the trees of its last shards."""
    return Matcher(forms, Readings(before, after, linking))


def allowed(n: int) -> int:
    """Edits that a name of n letters may carry."""
    return 1 if n < 7 else 2 if n < 13 else 3 if n < 18 else 4


def typed_values(equations: DataFrame) -> DataFrame:
    """(row_id, field, symbol, value): the non-blank domain and definitions of each row. Null maps and values give none."""
    domain = equations.select("row_id", F.lit("domain").alias("field"), F.lit("").alias("symbol"), F.col("domain").alias("value"))
    variables = equations.select("row_id", F.explode("variables").alias("symbol", "value")).select("row_id", F.lit("variables").alias("field"), "symbol", "value")
    return domain.unionByName(variables).where(filled("value").isNotNull())


def list_forms(lists: dict[str, DataFrame], linking=LINKING) -> DataFrame:
    """(field, id, form, short): the forms of the names of lists, (id, name) for each field; null names have none."""
    named = None
    for field, entries in lists.items():
        part = entries.where("name is not null").select(F.lit(field).alias("field"), F.col("id").cast("int").alias("id"), words(F.col("name")).alias("w"))
        named = part if named is None else named.unionByName(part)

    def run(batches):
        for pdf in batches:
            out = []
            for field, key, w in zip(pdf["field"], pdf["id"], pdf["w"]):
                for short, forms in enumerate(name_forms(list(w), linking)):
                    out += [(field, key, x, bool(short)) for x in forms if x]
            yield pd.DataFrame(out, columns=["field", "id", "form", "short"])

    return materialize(named.mapInPandas(run, "field string, id int, form string, short boolean"), "forms")


def learned_qualifiers(keys: DataFrame, forms: DataFrame) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each field the words that stand before and after names without changing what they name, from keys(field, w, n) and all
    their rows. A value is split at each place with at most WORDS words on one side; where the other side is a form of a name,
    the words beside it count. What stands next to ENTRIES different entries and is frequent (PART, LEAST) is a qualifier;
    LEAST bounds their number. Nothing is learned from a few values."""
    size = F.size("w")
    places = F.array_distinct(F.concat(F.sequence(F.lit(1), F.least(size - 1, F.lit(WORDS))), F.sequence(F.greatest(F.lit(1), size - WORDS), size - 1)))
    cut = keys.where(size > 1).select("field", "w", "n", F.explode(places).alias("i"))
    left, right = F.slice("w", F.lit(1), F.col("i")), F.slice("w", F.col("i") + 1, F.size("w"))
    split = cut.select("field", "n", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.when(F.size(x) <= WORDS, F.array_join(x, " ")).alias("fragment"), F.array_join(y, "").alias("form")) for b, x, y in ((True, left, right), (False, right, left))])).alias("x")).select("field", "n", "x.*").where("fragment is not null")
    beside = split.join(forms.where("not short").select("field", "form", "id"), ["field", "form"]).groupBy("field", "before", "fragment").agg(F.sum("n").alias("n"), F.countDistinct("id").alias("entries"))
    beside = materialize(beside, "beside")
    field = beside.groupBy("field").agg(F.max(F.when(F.col("entries") >= ENTRIES, F.col("n"))).alias("most"), F.sum("n").alias("total"))
    kept = beside.join(F.broadcast(field), "field").where((F.col("entries") >= ENTRIES) & (F.col("n") * PART >= F.col("most")) & (F.col("n") * LEAST >= F.col("total")))
    out: dict = {}
    for r in kept.select("field", "before", "fragment").orderBy("fragment").collect():
        out.setdefault(r["field"], ([], []))[0 if r["before"] else 1].append(r["fragment"])
    return {k: (tuple(a), tuple(b)) for k, (a, b) in out.items()}


def nearest_entries(values: DataFrame, lists: dict[str, DataFrame], qualifiers: dict | None = None, linking=LINKING) -> DataFrame:
    """(field, value, cost, entry_id) for distinct values(field, value) with, if there, the number n of their rows; lists holds
    (id, name) for each field; 0 stands for no entry and has the cost 99 where nothing is near enough.

    A value is read as typed, without qualifiers and without linking words, white space and punctuation. Each reading is
    searched in BK-trees of the forms of the names (all rotations of the words, and shortened words where the value has a
    point) under Levenshtein's distance. What lies within the radius is ranked by a distance that counts exchanged
    neighbours as one edit; what isn't found so is read more loosely. The least cost wins, and at that the first reading that stands for a single entry; entries
    equally near for all its readings count as none. qualifiers gives (before, after) for a field, else they are learned from
    the values. The list is cut into shards of about FORMS forms, the values into slices of about VALUES; each slice meets each
    shard, and the shards' winners are merged, so that neither is collected and the cut doesn't change a result.
    """
    spark = values.sparkSession
    n = F.col("n") if "n" in values.columns else F.lit(1)
    typed = values.select("field", "value", words(F.col("value")).alias("w"), F.col("value").contains(".").alias("point"), n.cast("long").alias("n"))
    typed = materialize(typed.withColumn("key", F.concat(F.array_join("w", " "), F.when(F.col("point"), " .").otherwise(""))), "typed")
    keys = materialize(typed.groupBy("field", "key").agg(F.sum("n").alias("n")), "keys")
    forms = list_forms(lists, linking)
    if qualifiers is None:
        qualifiers = learned_qualifiers(keys.select("field", F.split(F.regexp_replace("key", r" ?\.$", ""), " ").alias("w"), "n"), forms)
    n_forms, n_keys = forms.count(), keys.count()
    shards = max(1, -(-n_forms // FORMS))
    slices = max(2 * spark.sparkContext.defaultParallelism, -(-n_keys // VALUES))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = forms.select("field", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "form", "short").withColumn("slice", number(slices))
    right = keys.select("field", number(shards).alias("shard"), F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"), "key")

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(asked):
            field, texts = asked["field"].iloc[0], asked["key"].tolist()
            matcher = _matcher(tuple(sorted(zip(mine["id"].tolist(), mine["form"], mine["short"].tolist()))), *qualifiers.get(field, ((), ())), tuple(linking))
            out = [(field, texts[i], cost, rank, key) for i, cost, rank, key in matcher.best(texts)]
        return pd.DataFrame(out, columns=["field", "key", "cost", "rank", "id"])

    on = ["field", "shard", "slice"]
    tasks = min(10_000, max(spark.sparkContext.defaultParallelism * 4, shards * slices * len(lists)))  # given, so that few bytes aren't gathered in few tasks
    near = left.repartition(tasks, *on).groupBy(*on).cogroup(right.repartition(tasks, *on).groupBy(*on)).applyInPandas(run, "field string, key string, cost int, rank int, id int")
    by_rank = near.groupBy("field", "key", "cost", "rank").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("tied"))
    best = by_rank.groupBy("field", "key").agg(F.min(F.struct("cost", "tied", "rank", "id")).alias("b"))
    best = best.select("field", "key", F.col("b.cost").alias("cost"), F.when(F.col("b.tied"), 0).otherwise(F.col("b.id")).alias("entry_id"))
    counts = typed.groupBy("field", "key").agg(F.count(F.lit(1)).alias("m")).join(materialize(best, "best"), ["field", "key"], "left")
    out = salted_lookup(typed.select("field", "value", "key"), counts, ["field", "key"], "m", "value")
    return out.select("field", "value", F.coalesce(F.col("cost") % LOOSE, F.lit(99)).alias("cost"), F.coalesce("entry_id", F.lit(0)).alias("entry_id"))


def mapped_values(equations: DataFrame, domains: DataFrame, quantities: DataFrame, qualifiers: dict | None = None) -> DataFrame:
    """(row_id, field, symbol, value, entry_id): each non-blank value that isn't a name of its list as it stands.

    Only distinct values are searched; a value's rows are joined again with a frequent value dealt over many tasks.
    """
    lists = {"domain": domains.select(F.col("domain_id").alias("id"), F.col("domain_name").alias("name")), "variables": quantities.select(F.col("quantity_id").alias("id"), F.col("quantity_name").alias("name"))}
    names = None
    for f, entries in lists.items():
        part = entries.select(F.lit(f).alias("field"), F.col("name").alias("value")).distinct()
        names = part if names is None else names.unionByName(part)
    values = typed_values(equations).join(names, ["field", "value"], "left_anti")
    distinct = materialize(values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    found = materialize(nearest_entries(distinct, lists, qualifiers), "nearest")
    return salted_lookup(values, distinct.join(found, ["field", "value"]), ["field", "value"], "n", "row_id").select("row_id", "field", "symbol", "value", "entry_id")

"""Near-duplicate records: sets of words with a Jaccard similarity of at least a threshold."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import filled, words
from equarry.llm.components import components
from equarry.operators.skew import salted_lookup, salted_pairs
from equarry.session import drop_table, materialize

SIMILARITY = 0.7
#: Positions of a signature, a byte each: BLOCKS runs of ROWS bytes. Pairs below LEAST shared runs are dropped unverified.
ROWS, BLOCKS, LEAST = 7, 112, 2
SEED = 20240229
#: The index is made and joined in at most so many passes, one for each so many classes.
PASSES, PASS_CLASSES = 14, 10_000
#: Rows of a class that meet those of another at once.
BLOCK = 2_000
#: Words hashed at once, so that they stay in the processor's cache.
CELLS = 1 << 16


def chance_missed(similarity: float, rows: int = ROWS, blocks: int = BLOCKS, least: int = LEAST) -> float:
    """The chance that a pair of this similarity shares fewer than least runs of its signatures."""
    from math import comb

    p = similarity**rows
    return sum(comb(blocks, k) * p**k * (1 - p) ** (blocks - k) for k in range(least))


def word_sets(equations: DataFrame) -> DataFrame:
    """(row_id, words): the distinct words of equation and context_text, for rows whose context_text isn't blank."""
    text = F.concat_ws(" ", F.coalesce("equation", F.lit("")), "context_text")
    return equations.where(filled("context_text").isNotNull()).select("row_id", F.sort_array(F.array_distinct(words(text))).alias("words"))


def signatures(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: int = 0, last: int = BLOCKS) -> np.ndarray:
    """The runs from first to before last of each set's signature as numbers, sets x runs. Byte p is the mixed high byte of the least
    value of hash p over the set's words. Sets are taken in order of size, CELLS words at once, a column each, filled up with a word
    of their own."""
    rng, own, blocks = np.random.default_rng(SEED), slice(first * ROWS, last * ROWS), last - first
    mult = (rng.integers(0, 1 << 31, ROWS * BLOCKS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[own]
    turn = rng.integers(0, 1 << 32, ROWS * BLOCKS, dtype=np.uint32)[own]
    words = (hashes >> np.uint64(32)).astype(np.uint32)
    keys, order, at = np.zeros((len(starts), blocks), np.uint64), np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        some = order[at : at + max(1, CELLS // int(sizes[order[at]]))]
        some = some[: max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * sizes[some], CELLS, "right")))]
        place = np.arange(sizes[some[-1]])[:, None]
        block = words[starts[some] + np.where(place < sizes[some], place, 0)]
        value, least = np.empty_like(block), np.zeros((ROWS * blocks, len(some)), np.uint32)
        for p in range(ROWS * blocks):
            np.multiply(block ^ turn[p], mult[p], out=value)
            np.min(value, axis=0, out=least[p])
        least = (least * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint64).reshape(blocks, ROWS, -1)
        run = np.zeros((blocks, len(some)), np.uint64)
        for r in range(ROWS):
            run = run << np.uint64(8) | least[:, r]
        keys[some], at = run.T, at + len(some)
    return keys | np.arange(first, last, dtype=np.uint64)[None, :] << np.uint64(56)


def sketches(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, of which a word sets one: two sets differ in no more bits than words."""
    place = hashes.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(25)
    bit = np.uint64(1) << (place & np.uint32(63)).astype(np.uint64)
    return tuple(np.bitwise_or.reduceat(np.where(half, bit, np.uint64(0)), starts).view(np.int64) for half in (place < 64, place >= 64))


def _keys(first: int, last: int):
    """A row of the index for each set and run from first to before last: with the set's size and sketch."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            offsets = np.asarray(batch.column(1).offsets)
            hashes = np.asarray(batch.column(1).values)[offsets[0] : offsets[-1]].view(np.uint32)
            starts, sizes = (offsets - offsets[0])[:-1], np.diff(offsets)
            keys = signatures(hashes.astype(np.uint64) << np.uint64(32), starts, sizes, first, last)
            each = [np.repeat(x, last - first) for x in (np.asarray(batch.column(0)), sizes.astype(np.int32), *sketches(hashes, starts))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*each, keys.reshape(-1).view(np.int64))], ["rep", "size", "low", "high", "key"])

    return run


def class_of_rows(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with equal sets of words form a class: (row_id, rep, n) for each row, and (rep, words, n, hashes) for each class. Words are
    shuffled once, as texts."""
    sets = materialize(sets.withColumn("print", F.unhex(F.md5(F.array_join("words", " ")))), "sets")  # read several times below
    least = materialize(sets.groupBy("print").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classids")
    rows = salted_lookup(sets.select("row_id", "print"), least.select("print", "rep", F.col("n").alias("size"), "n"), ["print"], "n", "row_id")
    rows = materialize(rows.select("row_id", "rep", F.col("size").alias("n")), "rows")
    texts = sets.select(F.col("row_id").alias("rep"), F.array_join("words", " ").alias("text")).join(least.select("rep", "n"), "rep")
    words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    hashes = F.transform("words", lambda w: F.shiftright(F.xxhash64(w), 32).cast("int"))
    classes = materialize(texts.select("rep", words.alias("words"), "n").withColumn("hashes", hashes), "classes")
    drop_table(sets)
    drop_table(least)
    return rows, classes


def similar_classes(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) with a < b: the classes whose sets of words have at least this Jaccard similarity.

    Index: runs of ROWS bytes of each signature with their position, since the list of a single (position, byte) would
    hold a 256th of all rows. Shared runs are tallied per pair; a pair of similarity s shares BLOCKS * s**ROWS of them on
    average, and chance_missed(s) is the chance that it shares fewer than LEAST: 0.0007 at 0.70, 0.00003 at 0.73, below
    a millionth from 0.76. Pairs with LEAST or more are verified on their words. Sets without a word have no keys.

    The index is made and joined some runs at a time, so that only a part of it is on disk. Most pairs that share a run share frequent words
    alone, and their number is quadratic: they are dropped in the join if their sizes or sketches differ by more than such sets' words can.
    """
    hashed, of_thousand = reps.where(F.size("words") > 0).select("rep", "hashes"), round(similarity * 1000)
    passes = max(1, min(PASSES, reps.count() // PASS_CLASSES))
    cuts, tallies = np.linspace(0, BLOCKS, passes + 1).astype(int).tolist(), []
    for first, last in zip(cuts, cuts[1:]):
        index = hashed.mapInArrow(_keys(first, last), "rep bigint, size int, low bigint, high bigint, key bigint")
        one, other = (index.select("key", *[F.col(x).alias(f"{x}_{side}") for x in ("rep", "size", "low", "high")]) for side in "ab")
        differ = sum(F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in ("low", "high"))
        differ = F.greatest(differ, F.abs(F.col("size_a") - F.col("size_b")))
        may = differ * (1000 + of_thousand) <= (F.col("size_a") + F.col("size_b")) * (1000 - of_thousand)
        # the planner takes the index to be as small as the sets, so it is told to shuffle both sides; a hot key's rows are then cut by AQE
        met = one.hint("merge").join(other.hint("merge"), "key").where((F.col("rep_a") < F.col("rep_b")) & may)
        tallies.append(materialize(met.groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "tally"))
    every = reduce(DataFrame.unionByName, tallies)
    pairs = materialize(every.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= LEAST), "candidates")
    side = lambda id_, text: reps.select(F.col("rep").alias(id_), F.array_join("words", " ").alias(text))  # noqa: E731  texts shuffle in half the bytes
    both = pairs.join(side("a", "ta"), "a").join(side("b", "tb"), "b").select("a", "b", F.split("ta", " ").alias("wa"), F.split("tb", " ").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    of_either = F.size("wa") + F.size("wb") - common
    # in whole numbers, as 0.7 has no exact binary value
    return both.where(common * 1000 >= of_either * of_thousand).select("a", "b", F.round(common / of_either, 6).alias("similarity"))


def rows_of_links(rows: DataFrame, classes: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row_id_a, row_id_b): every row of a link's one class with every row of the other. A class is cut into blocks of about block
    rows by a hash, and a link is repeated for each pair of blocks, so that no task holds a large class."""
    cut = classes.select("rep", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    one = lambda side: cut.select(F.col("rep").alias(side), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"{side}_block"))
    ends = rows.select("rep", "row_id", F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / block)).cast("int").alias("part"))
    row = lambda side, name: ends.select(F.col("rep").alias(side), F.col("part").alias(f"{side}_block"), F.col("row_id").alias(name))
    met = links.select("a", "b").join(one("a"), "a").join(one("b"), "b")
    pairs = met.join(row("a", "x"), ["a", "a_block"]).join(row("b", "y"), ["b", "b_block"])
    return pairs.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def near_duplicate_rows(equations: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): all pairs of rows with non-blank context_text at SIMILARITY or more, rows with equal words included."""
    rows, reps = class_of_rows(word_sets(equations))
    links = materialize(similar_classes(reps).select("a", "b"), "links")
    equal = salted_pairs(rows.where("n > 1"), "rep", "row_id", "n", []).select("row_id_a", "row_id_b")
    return equal.unionByName(rows_of_links(rows, reps, links))


def near_duplicate_groups(equations: DataFrame) -> DataFrame:
    """(row_id, class_id, n_copies, n_links, group_id): one row for each row compared, its class of equal word sets, the rows of
    that class, the other classes similar to it, and the group of classes tied by such links, also through others."""
    rows, reps = class_of_rows(word_sets(equations))
    links = materialize(similar_classes(reps).select("a", "b"), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    known = materialize(degree.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("group_id")), "rep").select("rep", "n_links", "group_id"), "known")
    sizes = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(known, "rep", "left")
    out = salted_lookup(rows.withColumnRenamed("n", "n_copies"), sizes, ["rep"], "n", "row_id")
    return out.select("row_id", F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "rep").alias("group_id"))

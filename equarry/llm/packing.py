"""Items of varying length packed into containers of fixed capacity."""

from __future__ import annotations

import bisect
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.llm.tokens import VOCABULARY, with_lengths
from equarry.operators.skew import dense_rank_within, slices_for
from equarry.session import materialize

CAPACITY = 2048
#: Lengths above this part of the capacity are large; large lengths form so many groups of about equal cardinality.
LARGE, GROUPS = 1 / 8, 48


def length_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """The lengths, longest first, cut into groups of about equal numbers of items; items of one length stay together."""
    share, out, filled = sum(counts.values()) / groups, [], 0.0
    for n in sorted(counts, reverse=True):
        if not out or filled >= share:
            out.append([])
            filled = 0
        out[-1].append(n)
        filled += counts[n]
    return out


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of sizes within capacity that is worth most, and its worth."""
    best = np.zeros(capacity + 1)
    took = np.full((len(sizes), capacity + 1), 0, np.int32)
    for i, (s, w) in enumerate(zip(sizes, worth)):
        before = best.copy()
        for k in range(1, min(int(most[i]), capacity // int(s)) + 1):
            value = np.full(capacity + 1, -1.0)
            value[k * s :] = before[: capacity + 1 - k * s] + k * w
            better = value > best + 1e-12
            best[better], took[i][better] = value[better], k
    pattern, room = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for i in range(len(sizes) - 1, -1, -1):
        pattern[i] = took[i][room]
        room -= int(pattern[i] * sizes[i])
    return float(best.max()), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(number of containers, items of each size) that hold the demand: the linear program over patterns by column generation,
    rounded down, and first-fit decreasing for the few items left."""
    k = len(sizes)
    if not k:
        return []
    s, d = np.array(sizes, np.int64), np.array(demand, float)
    basis = np.diag([capacity // n for n in sizes]).astype(float)
    amount = np.linalg.solve(basis, d)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        worth, pattern = _best_pattern(s, np.maximum(dual, 0), np.maximum(d, 1), capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = pattern
        amount = np.maximum(np.linalg.solve(basis, d), 0)
    chosen = Counter()
    left = np.array(demand, np.int64)
    for j in np.argsort(-amount):
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        n = min(int(amount[j] + 1e-6), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if n > 0:
            chosen[tuple(pattern.tolist())] += n
            left -= n * pattern
    open_: list[list] = []
    for i, n in enumerate(left.tolist()):
        for _ in range(n):
            for c in open_:
                if c[0] >= sizes[i]:
                    break
            else:
                open_.append(c := [capacity, [0] * k])
            c[0] -= sizes[i]
            c[1][i] += 1
    for _, pattern in open_:
        chosen[tuple(pattern)] += 1
    return [(n, p) for p, n in chosen.items()]


def large_slots(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[list[tuple[int, int, int, int]], int]:
    """(group, first rank, first container, items a container) for each run of ranks, and the number of containers."""
    slots, taken, base = [], Counter(), 0
    for n, pattern in plan:
        for g, per in enumerate(pattern):
            if per:
                slots.append((g, taken[g], base, per))
                taken[g] += n * per
        base += n
    return slots, base


def best_fit(spaces: dict[int, int], counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Small items by best fit, longest first, on counts alone: (length, first rank, space class, first container of the class)
    for each run of ranks, and the number of containers opened, whose class is -1. spaces: containers by free room."""
    rooms: dict[int, deque] = {s: deque([(s, 0, n)]) for s, n in spaces.items() if s and n}
    order = sorted(rooms)
    moves, opened = [], 0


    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                n = -(-left // (capacity // size))
                rooms[capacity] = deque([(-1, opened, opened + n)])
                order.append(capacity)
                opened += n
                continue
            room = order[at]
            origin, lo, hi = rooms[room].popleft()
            n = min(left, hi - lo)
            moves.append((size, rank, origin, lo))
            rank, left = rank + n, left - n
            if n < hi - lo:
                rooms[room].appendleft((origin, lo + n, hi))
            elif not rooms[room]:
                del rooms[room], order[at]
            if rest := room - size:
                if rest not in rooms:
                    rooms[rest] = deque()
                    bisect.insort(order, rest)
                rooms[rest].append((origin, lo, lo + n))
    return moves, opened


def _placed(runs: list[tuple[int, ...]], columns: list[str], names: list[str], schema: str):
    """A function for mapInArrow that finds each row's run by its last two columns, key and rank, and adds the run's other values."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 2 + len(names))
    starts = table[:, 0] << 44 | table[:, 1]

    def run(batches):
        for batch in batches:
            key, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (len(columns), len(columns) + 1))
            at = np.searchsorted(starts, key << 44 | rank, "right") - 1
            extra = [pa.array(rank - table[at, 1], pa.int64()), *(pa.array(table[at, 2 + i], pa.int64()) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *extra], [*columns, "past", *names])

    return run


def items_of(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, token_start, n): a text within the capacity is one item, a longer one full parts and its rest."""
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / capacity).cast("bigint"))).alias("part")
    return lengths.where("n_tokens > 0").select("doc_id", "n_tokens", parts).select("doc_id", "part", (F.col("part") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n"))


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, doc_id, part, token_start, n_tokens): every token of lengths(doc_id, n_tokens) in one container.

    Only texts longer than a container are split. Lengths are whole numbers up to the capacity, so their histogram is
    bounded whatever the number of documents, and plans are made on it. Large lengths are cut into groups of about equal
    cardinality and rounded up to the longest of their group; the few sizes are packed by the linear program over
    configurations; documents take the slots of their group by rank. The room that then is free is filled with small items
    by best fit, again on counts. Ranks of one length are counted in slices, so a frequent length is dealt over many tasks.
    Documents without tokens are in no container; an empty table gives no rows.
    """
    spark = lengths.sparkSession
    items = materialize(items_of(lengths, capacity), "items")
    counts = {int(r["n"]): int(r["c"]) for r in items.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    slices = slices_for(sum(counts.values()))
    bound = int(capacity * LARGE)
    groups = length_groups({n: c for n, c in counts.items() if n > bound}, GROUPS)
    plan = configurations([g[0] for g in groups], [sum(counts[n] for n in g) for g in groups], capacity)
    slots, containers = large_slots(plan)
    group_of = {n: i for i, g in enumerate(groups) for n in g}
    columns, schema = ["doc_id", "part", "token_start", "n"], "doc_id bigint, part bigint, token_start bigint, n int, past bigint"
    hashed = F.xxhash64("doc_id", "part")
    large = small = None
    if slots:
        lookup = F.broadcast(spark.createDataFrame(sorted(group_of.items()), "n int, g int"))
        ranked = dense_rank_within(items.where(F.col("n") > bound).join(lookup, "n"), ["g"], [F.col("doc_id"), F.col("part")], hashed, slices)
        put = ranked.select(*columns, "g", "rank").mapInArrow(_placed(slots, columns, ["base", "per"], schema), schema + ", base bigint, per bigint")
        large = materialize(put.select((F.col("base") + F.floor(F.col("past") / F.col("per"))).cast("bigint").alias("container_id"), *columns), "large")
    room = materialize(large.groupBy("container_id").agg((F.lit(capacity) - F.sum("n")).cast("int").alias("space")), "room") if slots else None
    spaces = {int(r["space"]): int(r["c"]) for r in room.groupBy("space").agg(F.count(F.lit(1)).alias("c")).collect()} if slots else {}
    few = {n: c for n, c in counts.items() if n <= bound}
    moves, _ = best_fit(spaces, few, capacity)
    if moves:
        ranked = dense_rank_within(items.where(F.col("n") <= bound), ["n"], [F.col("doc_id"), F.col("part")], hashed, slices)
        put = ranked.select(*columns, F.col("n").alias("k"), "rank").mapInArrow(_placed(moves, columns, ["origin", "lo"], schema), schema + ", origin bigint, lo bigint")
        put = put.select(*columns, F.col("origin").cast("int").alias("space"), (F.col("lo") + F.col("past")).alias("rank"))
        small = put.where("space < 0").select((F.col("rank") + containers).alias("container_id"), *columns)
        if slots:
            numbered = dense_rank_within(room.where("space > 0"), ["space"], [F.col("container_id")], F.xxhash64("container_id"), slices)
            small = small.unionByName(put.where("space >= 0").join(numbered, ["space", "rank"]).select("container_id", *columns))
    parts = [x for x in (large, small) if x is not None]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], "container_id bigint, " + schema.rsplit(",", 1)[0])
    return out.withColumnRenamed("n", "n_tokens")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(materialize(with_lengths(documents, ["doc_id"], vocabulary), "lengths"), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, tokens left unused, the least number of containers the tokens could take, and full containers."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = each.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("used") == capacity, 1).otherwise(0)), F.lit(0)).alias("n_full"), F.coalesce(F.max("used"), F.lit(0)).alias("most_used"))
    return total.withColumn("n_unused", F.col("n_containers") * capacity - F.col("n_tokens")).withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity))

"""Records of several sources combined to target shares of the total size."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import filled
from equarry.llm.tokens import VOCABULARY, with_lengths
from equarry.operators.skew import running_total, slices_for
from equarry.session import materialize

SEED = 17
#: Patterns and targets the driver plans with; more are refused. Ranges of up to so many are broadcast, more are joined by a shuffle.
MOST_PATTERNS, MOST_SENT = 100_000, 20_000


class MinCostFlow:
    """Successive cheapest paths on a small network; capacities are whole numbers."""

    def __init__(self):
        self.out: dict = {}
        self.ends: list[list] = []  # end, room, cost

    def arc(self, a, b, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.ends))
            self.ends.append([y, r, c])
            self.out.setdefault(y, [])
        return len(self.ends) - 2

    def run(self, source, sink) -> tuple[int, int]:
        sent = paid = 0
        while True:
            best, via, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y, room, cost = self.ends[e]
                    if room > 0 and best[x] + cost < best.get(y, 1 << 62):
                        best[y], via[y] = best[x] + cost, e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if sink not in via:
                return sent, paid
            path, y = [], sink
            while y != source:
                path.append(via[y])
                y = self.ends[via[y] ^ 1][0]
            n = min(self.ends[e][1] for e in path)
            for e in path:
                self.ends[e][1] -= n
                self.ends[e ^ 1][1] += n
            sent, paid = sent + n, paid + n * best[sink]


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> tuple[int, list[tuple[tuple[str, ...], int, str, int]]]:
    """Tokens sent, and (pattern, copy, source, tokens): the cheapest routing of patterns' tokens to quotas.

    A pattern is the set of sources that hold a text. Copy j of a pattern's texts costs j - 1 a token, so that first copies
    go before second ones, and may only serve sources that allow j copies.
    """
    net, arcs = MinCostFlow(), []
    for s in sorted(quota):
        net.arc(("source", s), "sink", quota[s], 0)
    for p, room in sorted(capacity.items()):
        for j in range(1, max((repeats[s] for s in p), default=0) + 1):
            net.arc("start", (p, j), room, j - 1)
            arcs += [(p, j, s, net.arc((p, j), ("source", s), room, 0)) for s in p if repeats[s] >= j]
    if "start" not in net.out:
        return 0, []
    sent, _ = net.run("start", "sink")
    return sent, [(p, j, s, net.ends[e ^ 1][1]) for p, j, s, e in arcs if net.ends[e ^ 1][1]]


def quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    whole = sum(shares.values())
    return {s: int(total * x / whole) for s, x in shares.items()}


def largest_total(capacity: dict, shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which all quotas can be met."""
    low, high = 0, sum(n * max(repeats[s] for s in p) for p, n in capacity.items()) + 1
    while high - low > 1:
        middle = (low + high) // 2
        want = quotas(middle, shares)
        if route(capacity, want, repeats)[0] == sum(want.values()):
            low = middle
        else:
            high = middle
    return low


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens): the selected copies; doc_id is the least one that holds the text in that source.

    Equal texts are one text with the set of the listed collections that hold it as its membership pattern; a text is
    selected at most as often in all as the largest max_repeats of its collections, and for a collection at most as often as
    that one's. Tokens are summed per pattern, and a min-cost flow routes each pattern's capacity to the quotas; repeating
    costs more with each copy. The patterns are as many as the sets of listed sources that occur together. Without total
    the largest one is taken at which the shares of all collections that have documents are met; listed collections
    without documents get nothing and the other shares are scaled up. Each pattern's texts stand in a seeded order, and
    their running sum of tokens against the flow's bounds selects them: a text belongs to the range its middle falls into, so a
    quota is met but for half a text at each bound. Null or unlisted sources and texts without tokens take no part. More than
    MOST_PATTERNS listed sources or patterns are an error, as the driver couldn't plan with them.
    """
    spark = documents.sparkSession
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in targets.groupBy(filled("source").alias("source")).agg(F.sum("target_share"), F.max("max_repeats")).where("source is not null and `sum(target_share)` > 0 and `max(max_repeats)` > 0").limit(MOST_PATTERNS + 1).collect()}
    listed = documents.withColumn("source", filled("source")).where(F.col("source").isin(sorted(wanted))).withColumn("h", F.md5("text"))
    held = with_lengths(listed, ["doc_id", "source", "h"], vocabulary).where("n_tokens > 0")
    held = materialize(held.groupBy("h", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")), "held")
    texts = held.groupBy("h").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens"))
    texts = materialize(texts.withColumn("pattern", F.to_json("pattern")).withColumn("o", F.xxhash64(F.lit(seed), "h")), "texts")
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if max(len(sums), len(wanted)) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources or sets of sources that hold the same text")
    capacity = {tuple(json.loads(r["pattern"])): int(r["t"]) for r in sums}
    present = {s for p in capacity for s in p}
    shares, repeats = {s: wanted[s][0] for s in present}, {s: wanted[s][1] for s in present}
    if total is None:
        total = largest_total(capacity, shares, repeats) if present else 0
    _, flows = route(capacity, quotas(total, shares), repeats) if present else (0, [])
    bounds, at = [], {}
    for p, j, s, n in flows:
        low = at.get((p, j), 0)
        at[p, j] = low + n
        bounds.append((json.dumps(list(p), ensure_ascii=False, separators=(",", ":")), j, s, low, low + n))
    ranges = spark.createDataFrame(bounds, "pattern string, copy_no int, source string, low bigint, high bigint")
    ordered = running_total(texts, ["pattern"], "n_tokens", "o", "h", slices_for(sum(r["n"] for r in sums)))
    ranges = F.broadcast(ranges) if len(bounds) <= MOST_SENT else ranges.hint("merge")
    inside = (2 * F.col("before") + F.col("n_tokens") >= 2 * F.col("low")) & (2 * F.col("before") + F.col("n_tokens") < 2 * F.col("high"))
    chosen = ordered.join(ranges, "pattern").where(inside).select("h", "source", "copy_no")
    return chosen.join(held, ["h", "source"]).select("source", "doc_id", "copy_no", "n_tokens")


def mix_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share, tokens, copies, texts and most copies of one text for each listed source, also those with nothing."""
    from pyspark.sql import Window

    by = selected.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    by = by.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("c").alias("copies"), F.count(F.lit(1)).alias("documents"), F.max("c").alias("most_copies"))
    listed = targets.groupBy(filled("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    out = listed.join(by, "source", "left").fillna(0, ["tokens", "copies", "documents", "most_copies"])
    return out.withColumn("reached_share", F.round(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), 6))

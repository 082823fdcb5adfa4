import random

from equarry.llm import mixing

DOCS, TARGETS = "doc_id bigint, text string, source string, n int, h string", "source string, target_share double, max_repeats int"


def docs():
    rng = random.Random(9)
    word = lambda: " ".join(rng.choice(["pump", "valve", "stage", "heat", "flow"]) for _ in range(rng.randrange(5, 40)))
    rows = [(i, f"{word()} {i}", "big", 1, "q") for i in range(300)] + [(1000 + i, f"{word()} {i}", "small", 1, "q") for i in range(60)] + [(2000 + i, f"{word()} b{i}", "other", 1, "q") for i in range(80)]
    rows += [(3000 + i, rows[i][1], "small", 1, None) for i in range(20)]
    return rows + [(5000, None, "big", 1, None), (5001, "", "big", 1, None), (5002, "lost", None, 1, None), (5003, "unlisted", "else", 1, None), (5004, rows[0][1], "big", 1, None)]


def test_shares_and_repeats(spark):
    df = spark.createDataFrame(docs(), DOCS)
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.35, 3), ("other", 0.15, 2), ("absent", 0.1, 4)], TARGETS)
    picked = mixing.mix(df, targets)
    report = {r["source"]: r for r in mixing.mix_report(picked, targets).collect()}
    assert report["absent"]["tokens"] == 0 and report["absent"]["reached_share"] == 0
    for s in ("big", "small", "other"):
        assert abs(report[s]["reached_share"] - report[s]["target_share"] / 0.9) < 0.02
        assert 1 <= report[s]["most_copies"] <= report[s]["max_repeats"]
    rows = picked.collect()
    text = {d[0]: d[1] for d in docs()}
    per_text = {}
    for r in rows:
        per_text.setdefault(text[r["doc_id"]], []).append(r["copy_no"])
    assert all(len(set(c)) == len(c) and max(c) <= 3 for c in per_text.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df, targets).collect()))


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty, targets).collect() == []
    assert mixing.mix_report(mixing.mix(empty, targets), targets).first()["tokens"] == 0
    assert mixing.mix(spark.createDataFrame(docs(), DOCS), targets.limit(0)).collect() == []


def test_flow_prefers_first_copies():
    sent, flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 18, "b": 7}, {"a": 2, "b": 2})
    assert sent == 25 and all(j == 1 for _, j, _, _ in flows)
    assert mixing.route({("a",): 10}, {"a": 25}, {"a": 2})[0] == 20

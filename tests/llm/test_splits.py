import random
from functools import partial

from equarry.llm import components, splits
from equarry.llm.splits import assign_splits, split_shares, tied_files
from equarry.operators import skew

CASES = "row_id bigint, original_core_id string, correct_model_ids array<string>, unit string, n int"
EQS = "source_id string, n int"


def tables(spark):
    cases = [
        (1, "c1", ["a__1", " b__2 "], "x", 1), (2, " c1\n", ["c__1__x"], "x", 1), (3, None, ["d__1", "e__1", None, ""], "x", 1), (4, "  ", ["e__9", "f__1"], "x", 1),
        (5, "c2", ["ghost__1", "g__1"], "x", 1), (6, "c3", ["ghost__2", "h__1"], "x", 1), (7, None, None, None, None), (8, None, [], None, None), (9, "c4", ["nokey", "g"], None, None), (10, "c1", ["a__1"], None, None),
    ]
    files = [(x, 1) for x in (" a ", "b", "c", "d", "e", "f", "g", "h", None, " ", "a")]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(files, EQS)


def test_tied_files(spark):
    got = {tuple(r) for r in tied_files(*tables(spark)).select("group_key", "source_id").collect()}
    assert got == {("a", "b"), ("a", "c"), ("d", "e"), ("d", "f")}


def test_splits_keep_ties(spark):
    rows = {r["row_id"]: r for r in assign_splits(*tables(spark)).collect()}
    assert sorted(rows) == list(range(1, 11))
    assert len({rows[i]["split"] for i in (1, 2, 10)}) == 1 and len({rows[i]["split"] for i in (3, 4)}) == 1


def test_shares_of_many_small_components(spark):
    cases = spark.createDataFrame([(i, f"core{i // 3}", [f"file{i // 3}__1"]) for i in range(3000)], "row_id bigint, original_core_id string, correct_model_ids array<string>")
    files = spark.createDataFrame([(f"file{i}",) for i in range(1000)], "source_id string")
    got = {r["split"]: r["share"] for r in split_shares(assign_splits(cases, files)).collect()}
    assert abs(got["train"] - 0.8) < 0.01 and abs(got["validation"] - 0.1) < 0.01 and abs(got["test"] - 0.1) < 0.01


def test_one_component_over_all_and_empty_tables(spark):
    cases = spark.createDataFrame([(i, "same", ["a__1"]) for i in range(5)], "row_id bigint, original_core_id string, correct_model_ids array<string>")
    files = spark.createDataFrame([("a",)], "source_id string")
    assert {r["split"] for r in assign_splits(cases, files).collect()} == {"train"}
    assert assign_splits(cases.limit(0), files).collect() == [] and tied_files(cases.limit(0), files.limit(0)).collect() == []


def test_no_switch_changes_a_split(spark, monkeypatch):
    """However components are found and hot keys are dealt, each record has the same split and component."""
    rng = random.Random(4)
    cases = [(i, f"core{rng.randrange(150)}" if i % 4 else None, [f"f{rng.randrange(90)}__1" for _ in range(rng.choice((1, 1, 1, 2)))]) for i in range(400)]
    cases = spark.createDataFrame(cases, "row_id bigint, original_core_id string, correct_model_ids array<string>")
    files = spark.createDataFrame([(f"f{i}",) for i in range(90)], "source_id string")
    one = sorted(map(tuple, assign_splits(cases, files).collect()))
    monkeypatch.setattr(components, "SMALL_GRAPH", 0)
    monkeypatch.setattr(components, "SLICE", 3)
    dealt = partial(skew.salted_lookup, least=5)
    monkeypatch.setattr(components, "salted_lookup", dealt)
    monkeypatch.setattr(splits, "salted_lookup", dealt)
    assert one == sorted(map(tuple, assign_splits(cases, files).collect()))

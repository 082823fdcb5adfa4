import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equarry.functions.text import words
from equarry.llm import entries as E

short = st.text("abcx ", max_size=9)


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_distance(a, b):
    assert E.distance(a, b) == slow(a, b)
    assert E.typing_distance(a, b) <= E.distance(a, b)


def test_tree_returns_all_within_radius():
    rng = random.Random(5)
    words = list({"".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(300)})
    tree = E.BKTree(words)
    for q in words[:20] + ["", "zzz", "abcdabcdabcd"]:
        for r in (0, 1, 3):
            want = sorted((slow(q, w), w) for w in words if slow(q, w) <= r) if q else []
            assert sorted(tree.search(q, r)) == want


def test_values(spark):
    domains = spark.createDataFrame([(1, "Belt Drying"), (2, "Spray Drying"), (3, "Cooling Tower Sizing")], "domain_id int, domain_name string")
    quantities = spark.createDataFrame([(7, "void fraction of bed", "e"), (8, "friction factor", "f")], "quantity_id int, quantity_name string, usual_symbol string")
    rows = [
        (1, "belt_DRYING", {"a": "void fract. of bed", "b": "friction factor"}), (2, "Sizing of Cooling Tower, ch. 4", {"a": " factor, fricton", "": "zebra entry"}), (3, "Belt Drying", None),
        (4, None, {}), (5, "  ", {"x": None}), (6, "Sparty Drying", {"y": "the voidfractionofbed [SI]", "z": "x" * 5000}), (7, "?", {"u": "."}),
    ]
    eqs = spark.createDataFrame(rows, "row_id bigint, domain string, variables map<string,string>")
    said = {"domain": ((), ("ch 4",)), "variables": (("the",), ("si",))}
    got = {(r["row_id"], r["field"], r["symbol"]): r["entry_id"] for r in E.mapped_values(eqs, domains, quantities, said).collect()}
    assert got == {
        (1, "domain", ""): 1, (1, "variables", "a"): 7, (2, "domain", ""): 3, (2, "variables", "a"): 8, (2, "variables", ""): 0,
        (6, "domain", ""): 2, (6, "variables", "y"): 7, (6, "variables", "z"): 0, (7, "domain", ""): 0, (7, "variables", "u"): 0,
    }


def test_shards_agree_and_empty_list(spark, monkeypatch):
    """Every way to cut the list and the values gives the same rows, ties within a shard and across shards among them."""
    names = ["Belt Drying", "Belt Draing", "Bell Drxinga", "Spray Drying", "Gas Compression", "Gas Compressian", "Drying Belts", "Spray Frying"]
    values = ["belt driying", "belt drxing", "spray", "sprey drying", "spray drying", "drying, belt", "gas compressio", "nothing like it", "gsa compression", "belt drying", "belt drying (zzz)", "sp. drying", "b. d."]
    typed = spark.createDataFrame([("domain", v) for v in values], "field string, value string")
    lists = {"domain": spark.createDataFrame(list(enumerate(names, 1)), "id int, name string")}
    one = {tuple(r) for r in E.nearest_entries(typed, lists, {}).collect()}
    assert len(one) == len(values) and ("domain", "belt drxing", 1, 0) in one
    for forms in (1, 60):
        monkeypatch.setattr(E, "FORMS", forms)
        monkeypatch.setattr(E, "VALUES", 3)
        assert one == {tuple(r) for r in E.nearest_entries(typed, lists, {}).collect()}
    assert {r["entry_id"] for r in E.nearest_entries(typed, {"domain": lists["domain"].limit(0)}, {}).collect()} == {0}
    assert E.nearest_entries(typed.limit(0), lists).collect() == []


def test_forest_is_the_tree_for_many():
    rng = random.Random(8)
    strings = list({"".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(400)}) + ["z" * 90, "ab" * 40]
    queries = strings[:30] + ["", "zzz", "z" * 88, "ab" * 39 + "x", "é", "abdce"]
    forest = E.Forest(strings)
    for r in (1, 2, 6):
        got = {(q, s): c for q, s, c in zip(*(x.tolist() for x in forest.search(queries, np.full(len(queries), r))))}
        want = {(i, s) for i, q in enumerate(queries) for s, w in enumerate(forest.strings) if q and slow(q, w) <= r}
        assert set(got) == want
        assert all(c == E.typing_distance(queries[q], forest.strings[s]) for (q, s), c in got.items())


def test_qualifiers_are_learned_from_the_values(spark):
    names = [f"{a} {b}" for a in ("belt", "spray", "flash", "drum") for b in ("drying", "cooling", "sizing")]
    lists = {"domain": spark.createDataFrame(list(enumerate(names, 1)), "id int, name string")}
    typed = [n for n in names] + [f"{n} (see page 12)" for n in names[:8]] + [f"advanced {n}" for n in names[:6]] + ["belt drying zebra", "unrelated thing", "advanced sparyd rying, see page 12"]
    values = spark.createDataFrame([("domain", v) for v in typed], "field string, value string")
    keys = values.select("field", words(F.col("value")).alias("w"), F.lit(1).alias("n"))
    assert E.learned_qualifiers(keys, E.list_forms(lists)) == {"domain": (("advanced",), ("see page 12",))}
    got = {r["value"]: r["entry_id"] for r in E.nearest_entries(values, lists).collect()}
    assert got["advanced sparyd rying, see page 12"] == got["spray drying"] and got["unrelated thing"] == 0
    assert all(got[v] == names.index(n) + 1 for n in names for v in typed if n in v and "zebra" not in v)


def test_null_names_and_clashing_columns(spark):
    eqs = spark.createDataFrame([(1, "belt dryng", {"a": "void fracton"}, 5, "x", 3)], "row_id bigint, domain string, variables map<string,string>, n int, key string, entry_id int")
    domains = spark.createDataFrame([(1, "Belt Drying", "x"), (2, None, "y"), (1, "Belt Drying", "x")], "domain_id int, domain_name string, value string")
    quantities = spark.createDataFrame([(7, "void fraction", "e")], "quantity_id int, quantity_name string, usual_symbol string")
    assert {(r["field"], r["entry_id"]) for r in E.mapped_values(eqs, domains, quantities).collect()} == {("domain", 1), ("variables", 7)}

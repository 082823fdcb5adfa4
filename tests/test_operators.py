import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from equarry.functions.text import global_key, norm
from equarry.operators import cases as C
from equarry.operators import corpus, graph, learning, profile, quality, retrieval
from equarry.operators import vectors as V
from equarry.operators.orphans import OrphanTracker, keyed, open_orphans, orphan_at_creation, orphan_counts, references
from equarry.operators.skew import dense_rank_within, places, running_total, salted_lookup, salted_pairs


def eqs(spark, rows):
    full = [(i, s, e, q, v, c, d) for i, (s, e, q, v, c, d) in enumerate(rows)]
    return spark.createDataFrame(full, "row_id bigint, source_id string, eq_id string, equation string, variables map<string,string>, context_text string, domain string")


def test_keys_and_trim(spark):
    df = spark.createDataFrame([("a.pdf", " eq_1 "), ("a", "b__1"), ("a", "  "), ("", "e"), (None, "\te\n"), ("x ", "1")], "s string, e string")
    assert [r[0] for r in df.select(global_key("s", "e")).collect()] == ["a.pdf__eq_1", "b__1", None, "unknown__e", "unknown__e", "x__1"]
    assert spark.range(1).select(norm(F.lit("\t x \n"))).first()[0] == "x"


def test_notation(spark):
    df = eqs(spark, [("s", "1", "Cpj + Cp + C_p + c_w", {}, "", ""), ("s", "2", None, {}, "", "")])
    df = df.withColumn("variables", F.when(F.col("eq_id") == "1", F.expr("map('c_w', '1', 'c_p', '2')")).otherwise(F.expr("map('z', 'Shinko pump')")))
    assert [r["equation"] for r in corpus.normalized_equations(df).orderBy("row_id").collect()] == ["c_p + c_p + c_p + c_p", None]
    assert {(r["symbol"], r["definition"]) for r in corpus.normalized_variables(df).collect()} == {("c_p", "2"), ("z", "Shink_0 pump")}


def test_domains_and_profile(spark):
    df = spark.createDataFrame([(None,), ("unknown",), ("",), ("  ",), ("Mathematical Modeling",), ("CSTR Kinetics",)], "d string")
    assert [r[0] for r in df.select(corpus.merged_domain("d")).collect()] == ["Unknown", "Unknown", "Unknown", "Other", "Numerical Methods", "Reactor / CSTR"]
    e = eqs(spark, [("s", "1", "", {"a": "", "b": "x", "c": None}, "", ""), ("s", "2", "", {"a": "A", "b": "y"}, "", ""), ("s", "3", "", None, "", "")])
    assert {r["symbol"]: r["definition"] for r in profile.first_definitions(e).collect()} == {"a": "", "b": "x"}
    assert {(r["a"], r["b"], r["weight"]) for r in profile.cooccurrence(e).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {r["symbol"]: r["degree"] for r in profile.cooccurrence_degree(profile.cooccurrence(e)).collect()} == {"a": 3, "b": 3, "c": 2}
    assert [tuple(r) for r in profile.variable_frequency(e).collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_merge_and_wins(spark):
    old = eqs(spark, [("s", "1", "old", {}, "", ""), ("s", "1", "old2", {}, "", ""), (None, "9", "o", {}, "", "")])
    new = eqs(spark, [("s", "1", "x", {}, "", ""), ("s", "2", "y", {}, "", ""), ("s", "2", "z", {}, "", ""), (None, "9", "n", {}, "", "")])
    assert sorted(r["equation"] for r in corpus.merge_new(old, new, ["source_id", "eq_id"]).collect()) == ["o", "old", "old2", "y"]
    assert corpus.candidates(old).count() == 2 and {r["key"]: r["last_row_id"] for r in corpus.last_wins(old).collect()} == {"s__1": 1, "unknown__9": 2}


def test_modal_source_and_signatures(spark):
    df = spark.createDataFrame([(1, "c", ["a", ""], ["b"], ["b__1", "a__1"]), (2, "c", ["a"], ["b"], ["a__1", "b__1", None]), (3, None, None, None, ["x", "y"]), (4, "c", [], [], None)], "row_id bigint, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>")
    assert {r[0]: r[1] for r in C.modal_source(df).collect()} == {1: "b", 2: "a", 3: "unknown", 4: "unknown"}
    assert tuple(C.duplicate_groups(df, True).first()) == (1, 2) and tuple(C.duplicate_groups(df, False).first()) == (0, 0)


def test_expand_counts(spark):
    core = "row_id bigint, case_id string, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>"
    e = eqs(spark, [("s", "1", "", {"x": "", "y": "", "z": ""}, "", ""), ("s", "2", "", {"v": ""}, "", "")])
    rows = C.expand(spark.createDataFrame([(1, "a", "c", ["x"], ["y"], ["s__1"]), (2, "b", "c", ["x"], [], ["s__1"]), (3, "d", None, [], [], ["s__2"]), (4, "e", "c", None, None, None)], core), e).collect()
    by = {i: [r for r in rows if r["row_id"] == i] for i in (1, 2, 3, 4)}
    assert [len(by[i]) for i in (1, 2, 3, 4)] == [9, 8, 8, 4]
    assert all((r["inputs"], r["outputs"]) == ("", "v") for r in by[3] if r["variant_type"] == "random_io_from_models")
    assert all(sorted(r["inputs"].split("|") + r["outputs"].split("|")) == ["x", "y", "z"] for r in by[1] if r["variant_type"] == "random_io_from_models")


def test_paraphrase_twice_and_collision(spark):
    schema = "row_id bigint, case_id string, original_core_id string, variant_type string, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>"
    df = spark.createDataFrame([(1, "c", "k", "original", "text", ["a"], ["b"], ["m"]), (2, "c_para1", "k", "other", "else", [], [], []), (3, "c_para1_2", "k", "other", "else2", [], [], []), (4, "c", "k", "original", "text", ["a"], ["b"], ["m"]), (5, " ", "k", "original", "t", [], [], [])], schema)
    new = C.paraphrase(df)
    assert sorted(r["case_id"] for r in new.collect()) == ["c_para1_3", "c_para2", "c_para3"]
    again = df.unionByName(new.select((F.col("row_id") * 100 + F.col("k")).alias("row_id"), "case_id", F.lit("k").alias("original_core_id"), F.lit("context_paraphrased").alias("variant_type"), "context", "input_variables", "output_variables", "correct_model_ids"))
    assert C.paraphrase(again).count() == 0


def test_quality(spark):
    e = eqs(spark, [("s", "1", "", {"a": ""}, "", ""), ("s", "1", "", {"b ": ""}, "", "")])
    c = spark.createDataFrame([(1, ["b"], ["a", "a"], ["s__1"]), (2, ["a"], ["b"], ["gone"]), (3, None, None, None)], "row_id bigint, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>")
    assert {tuple(r) for r in quality.inconsistent_cases(c, e).collect()} == {(1, 2, "a"), (2, 2, "a|b")}
    assert tuple(quality.missing_totals(c, e).first()) == (1, 1)
    raw = spark.createDataFrame([('{"context": null}',), ("{}",), ("no json",)], "json string")
    assert {r["field"]: r["n"] for r in quality.absent_fields(raw).collect()}["context"] == 2


def test_graph(spark):
    e = eqs(spark, [("s", "0", "", {"t": "", "V": ""}, "", ""), ("s", "1", "", {"t": ""}, "", ""), ("s", "2", "", {"z": ""}, "", ""), ("s", "3", "", {"t ": ""}, "", ""), ("s", "4", "", {"V": "", "t": ""}, "", ""), ("s", "5", "", None, "", "")])
    assert {r["node"]: r["degree"] for r in graph.degrees(e).collect()} == {0: 2, 1: 2, 4: 2}
    assert tuple(graph.degree_stats(graph.degrees(e)).first()) == (3, 6, 2, 2, 2.0)
    assert graph.degrees(e.limit(0)).count() == 0


def test_ranks_and_metrics(spark):
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(6)], "idx bigint, key string")
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 3, 0.9), (2, 1, 0.2), (4, 5, 0.3)], "row_id bigint, idx bigint, score double")
    right = spark.createDataFrame([(1, 1), (2, 4), (2, 2), (3, 5), (4, 5), (4, 1)], "row_id bigint, idx bigint")
    assert {tuple(r) for r in retrieval.best_ranks(scores, right, rows).collect()} == {(1, 2), (2, 4), (3, 6), (4, 1)}
    ranks = spark.createDataFrame([(1,), (2,), (4,), (20,)], "best_rank bigint")
    assert tuple(retrieval.metrics(ranks).first()) == (4, 0.45, 0.25, 0.5, 0.75, 0.75)
    assert tuple(retrieval.metrics(ranks.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("n,want", [(22, (4, 4, 14)), (1, (1, 0, 0))])
def test_source_split(spark, n, want):
    e = eqs(spark, [(f"s{i}", "1", "", {}, "", "") for i in range(n)])
    got = {r[0]: r[1] for r in retrieval.source_split(e).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("test", "val", "train")) == want


def test_vectors_and_models(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node bigint, x array<double>")
    value, _ = V.singular_basis(df, 3)
    assert np.allclose(value, np.linalg.svd(x, compute_uv=False)[:3])
    pcs = np.array([[r["pc1"], r["pc2"]] for r in V.principal_components(df).orderBy("node").collect()])
    c = x - x.mean(0)
    assert np.allclose(np.abs(pcs), np.abs(c @ np.linalg.svd(c)[2][:2].T), atol=1e-5)
    u = learning.unit(x)
    assert np.allclose(learning.refine(u, learning.propagation(50, np.arange(49), np.arange(1, 50)), rng.normal(size=(6, 6)), rng.normal(size=(6, 6)), 0.0), u)
    labelled = spark.createDataFrame([(i, r.tolist(), np.eye(4)[i % 4].tolist(), i % 4) for i, r in enumerate(np.eye(4)[np.arange(200) % 4] + 0.1 * rng.normal(size=(200, 4)))], "i bigint, q array<double>, item array<double>, item_id bigint")
    got = learning.grid_search([(1e-3, 0.0)], labelled).first()
    assert got["loss_last"] < got["loss_first"] and got["recall_1"] > 0.9


def test_skew_helpers(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{rng.randrange(5)}", rng.randrange(9)) for i in range(600)] + [(900, None, 1)]
    facts = spark.createDataFrame(rows, "id bigint, k string, w int")
    dim = facts.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = salted_lookup(facts, dim, ["k"], "n", "id", least=10)
    assert got.columns == ["k", "id", "w", "first"] and got.count() == 600 and got.join(facts.join(dim, "k"), ["id", "first"]).count() == 600
    assert salted_lookup(facts, dim, ["k"], "n", "id", "left", least=10).count() == 601
    ranked = dense_rank_within(facts.where("k is not null"), ["k"], [F.col("id")], F.xxhash64("id"), 7).collect()
    for k in {r["k"] for r in ranked}:
        assert sorted(r["rank"] for r in ranked if r["k"] == k) == list(range(sum(r["k"] == k for r in ranked)))
    total, so_far = running_total(facts.withColumn("h", F.xxhash64("id")), [], "w", "h", "id", 5).orderBy("h").collect(), 0
    for r in total:
        assert r["before"] == so_far
        so_far += r["w"]
    assert [r["at"] for r in places(facts, "id").orderBy("id").collect()] == list(range(601))
    members = facts.where("k is not null").join(dim, "k")
    pairs = salted_pairs(members, "k", "id", "n", ["w"], least=50)
    assert pairs.count() == sum(r["n"] * (r["n"] - 1) // 2 for r in dim.collect())


T = [datetime(2024, m, 1) for m in range(1, 13)]


def test_orphans_in_any_batches(spark):
    case = "row_id bigint, created_at timestamp_ntz, correct_model_ids array<string>"
    cases = spark.createDataFrame([(1, T[5], [" a__1 ", "a__1", "b__1", "", None]), (2, T[1], ["a__1"]), (3, T[9], ["c__1", "ghost"]), (4, None, ["a__1"]), (5, T[3], None), (6, T[7], [])], case)
    arrivals = spark.createDataFrame([("a", "1", T[2]), (" a", "1 ", T[4]), ("c", "1", T[0]), ("x", None, T[0]), ("b", "1", None)], "source_id string, eq_id string, ingested_at timestamp_ntz")
    gone = spark.createDataFrame([("c", "1", T[8]), ("c", "1", T[6]), ("a", "1", T[10])], "source_id string, eq_id string, retired_at timestamp_ntz")
    refs, told, lost = references(cases, "training_cases"), keyed(arrivals, "ingested_at"), keyed(gone, "retired_at")
    want = {(1, "b__1"), (2, "a__1"), (3, "c__1"), (3, "ghost"), (4, "a__1")}
    plans = [[(refs, told, lost)], [(refs.where("row_id < 3"), None, None), (None, told, None), (refs.where("row_id >= 3"), None, lost)], [(None, told.where(F.col("at") > F.lit(T[3])), lost), (refs, None, None), (None, told.where(F.col("at") <= F.lit(T[3])), None)]]
    states = []
    for plan in plans:
        tracker = OrphanTracker(spark)
        for new, arrived, deleted in plan:
            tracker.advance(new, arrived, deleted)
        state = OrphanTracker(spark, tracker.folder).refs()
        assert {(r["row_id"], r["ref_key"]) for r in state.where(orphan_at_creation()).collect()} == want
        states.append(sorted(map(repr, state.collect())))
    assert states[0] == states[1] == states[2]
    counts = {r["month"]: r for r in orphan_counts(state).collect()}
    assert counts["2024-02"]["n_not_yet"] == 1 and counts["2024-10"]["n_withdrawn"] == 1 and counts["2024-10"]["n_absent"] == 1 and counts[None]["n_orphans"] == 1
    moves = {r["month"]: r for r in open_orphans(state).collect()}
    assert (moves["2024-02"]["open_at_end"], moves["2024-03"]["resolved"], moves["2024-11"]["reopened"]) == (1, 1, 2)
    empty = OrphanTracker(spark)
    empty.advance()
    assert empty.refs().count() == 0 and orphan_counts(empty.refs()).count() == 0


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    ref = lambda rows: references(spark.createDataFrame(rows, "row_id bigint, created_at timestamp_ntz, correct_model_ids array<string>"), "t")
    tracker = OrphanTracker(spark, str(tmp_path / "o"), buckets=8)
    tracker.advance(ref([(i, T[5], [f"k__{i}", "hot__1"]) for i in range(60)]), stream="s", batch=0)
    assert set(tracker.held["refs"]) == set(range(8)) and tracker.refs().count() == 120
    tracker.advance(arrivals=keyed(spark.createDataFrame([("k", "7", T[1])], "source_id string, eq_id string, at timestamp_ntz"), "at"), stream="s", batch=1)
    assert sorted(tracker.held["refs"].values()) == [1] * 7 + [2] and list(tracker.held["parents"].values()) == [2]
    again = OrphanTracker(spark, str(tmp_path / "o"))
    again.advance(ref([(99, T[5], ["k__99"])]), stream="s", batch=1)  # replayed: nothing
    assert again.version == 2 and again.refs().count() == 120 and again.refs().where(~orphan_at_creation()).count() == 1
    again.advance(ref([(99, T[5], ["k__99"])]), stream="other", batch=0)
    again.advance(ref([(100, T[5], ["k__99"])]), stream="s", batch=2)
    assert OrphanTracker(spark, str(tmp_path / "o")).refs().count() == 122

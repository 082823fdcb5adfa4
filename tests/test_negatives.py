"""Every training case gets its full number of negatives."""

from equarry.operators import retrieval
from equarry.plans import registry


def frames(spark, n_cases, n_rows, named):
    rows = spark.createDataFrame([(f"S__{i}", 10 * i) for i in range(n_rows)], "key string, idx bigint")
    cases = spark.createDataFrame([(i, [f" S__{k}" for k in named(i)] or None) for i in range(n_cases)], "row_id bigint, correct_model_ids array<string>")
    return cases, rows


def test_negatives_are_redrawn_until_all_are_found(spark):
    cases, rows = frames(spark, 7, 60, lambda i: range(60 if i == 6 else 59 if i == 5 else i))
    got = {r["row_id"]: r["negatives"] for r in retrieval.negatives(cases, rows).collect()}
    assert sorted(got) == list(range(7)) and got[6] == [] and set(got[5]) == {590}
    for i in range(6):
        assert len(got[i]) == retrieval.NEGATIVES == 128 and not {10 * k for k in range(i)} & set(got[i])
    assert len(set(got[0])) > 40
    joined = {r["row_id"]: r["negatives"] for r in retrieval.negatives(cases, rows, most_sent=0).collect()}
    assert joined == got


def test_training_negatives_serve_every_case(spark):
    folder = "/root/testdata/sf0.001"
    cases = {r[0] for r in spark.read.parquet(f"{folder}/training_cases.parquet").select("row_id").collect()}
    got = {r["row_id"]: len(r["negatives"]) for r in registry.QUERIES["training_negatives"](spark, folder).collect()}
    assert set(got) == cases and set(got.values()) == {128}

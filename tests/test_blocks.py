"""Block scores against the score tables, and their edge cases."""

import random

from pyspark.sql import functions as F

from equarry.operators import blocks, retrieval

CASES = "row_id bigint, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>, idx int, text string"


def tables(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta mass flow heat rate of the".split()) for _ in range(n))
    symbols = lambda: rng.sample(["a", "b", "c", " d ", "e", ""], rng.randrange(4))
    eqs = [(i, "S", f"e{i}", "", {s: "" for s in symbols()}, text(rng.randrange(12)), None) for i in range(60)] + [(60, "S", "e60", None, None, None, None), (61, "S", "e1", "", {}, "again", None), (62, None, " ", "", {}, "no key", None)]
    cases = [(i, text(8), symbols(), symbols(), [f"S__e{3 * i}", f"S__e{3 * i + 1}", "gone"], 1, "x") for i in range(15)] + [(70, None, None, None, ["S__e60"], 1, "x"), (71, "", [], [], None, 1, "x")]
    return spark.createDataFrame(eqs, "row_id bigint, source_id string, eq_id string, equation string, variables map<string,string>, context_text string, domain string"), spark.createDataFrame(cases, CASES)


def test_blocks_agree_with_score_tables(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 7)
    eqs, cases = tables(spark)
    index = retrieval.Index(eqs)
    for text, symbol in ((0.7, 0.3), (1.0, 0.0), (0.0, 1.0)):
        scores = index.mixed_scores(cases, text, symbol).where("score > 0")
        want = {(r["row_id"], r["idx"], round(r["score"], 5)) for r in retrieval.top(scores, 4).collect()}
        assert {(r["row_id"], r["idx"], round(r["score"], 5)) for r in index.best(cases, 4, text, symbol).collect()} == want
        want = {tuple(r) for r in retrieval.best_ranks(scores, retrieval.positives(cases, index.rows), index.rows).collect()}
        assert {tuple(r) for r in index.ranks(cases, text, symbol).collect()} == want and len(want) == 16


def test_many_blocks_and_none(spark):
    eqs, cases = tables(spark)
    index = retrieval.Index(eqs)
    rows, _ = index.blocks(cases)
    asked = cases.select(F.col("row_id").alias("id"), F.col("context").alias("text"), F.col("input_variables").alias("symbols"))
    few = lambda size: sorted(map(tuple, blocks.top(rows, index._stored["overlap"].blocks(asked, 0.7, 0.3, size), 3).collect()))
    assert few(2) == few(100) != []
    assert index.best(cases.limit(0), 3).collect() == [] and index.ranks(cases.limit(0)).collect() == []
    assert retrieval.Index(eqs.limit(0)).best(cases, 3).collect() == []

"""Scores estimated for groups of queries and settled exactly give the rows of the score tables."""

import pytest
from test_blocks import tables

from equarry.operators import blocks, retrieval


@pytest.mark.parametrize("text, symbol", [(0.7, 0.3), (1.0, 0.0), (0.0, 1.0)])
def test_groups_agree_with_score_tables(spark, text, symbol):
    eqs, cases = tables(spark)
    index = retrieval.Index(eqs)
    scores = index.mixed_scores(cases, text, symbol).where("score > 0")
    rows, overlap, asked = index._asked(cases, text)
    want = {(r["row_id"], r["idx"], round(r["score"], 5)) for r in retrieval.top(scores, 2).collect()}
    assert {(r["row_id"], r["idx"], round(r["score"], 5)) for r in blocks.group_top(rows, overlap.groups(asked, text, symbol, 6), 2).collect()} == want
    right = retrieval.positives(cases, index.rows)
    want = {tuple(r) for r in retrieval.best_ranks(scores, right, index.rows).collect()}
    asked = asked.join(right.select("row_id").distinct().withColumnRenamed("row_id", "id"), "id", "left_semi")
    assert {tuple(r) for r in blocks.group_ranks(rows, right, overlap.groups(asked, text, symbol, 6)).collect()} == want


def test_no_matrix_of_all_terms_is_sent(spark):
    """What goes to the tasks follows the queries' terms, not terms times queries."""
    import pickle

    eqs, cases = tables(spark)
    _, overlap, asked = retrieval.Index(eqs)._asked(cases, 0.7)
    (group,) = overlap.groups(asked, 0.7, 0.3)
    group.prepared()
    assert len(pickle.dumps(group)) < 12_000 and len(group.ids) == 17

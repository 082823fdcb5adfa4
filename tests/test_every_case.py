"""Queries that score, rank or count cases take every case, and their SQL does so, too."""

import pytest

from equarry.operators import retrieval as R
from equarry.operators.cases import modal_source
from equarry.plans import registry
from equarry.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    """All cases, and the scores of all of their pairs from the score tables."""
    cases, index = table(spark, FOLDER, "training_cases"), R.Index(table(spark, FOLDER, "equations"))
    return cases, index, index.mixed_scores(cases).where("score > 0").cache()


def test_mix_score_topk(spark, whole):
    """Before, only cases whose row_id is divisible by 100 had rows."""
    want = {(r["row_id"], r["idx"], round(r["score"], 5)) for r in R.top(whole[2], 10).collect()}
    got = registry.QUERIES["mix_score_topk"](spark, FOLDER).collect()
    assert {(r["row_id"], r["idx"], round(r["score"], 5)) for r in got} == want
    assert len({r["row_id"] for r in got}) > 0.9 * whole[0].count() and f"% {R.EVERY}" not in registry.SQL["mix_score_topk"]


def metrics_of(ranks, cases, of):
    """{group: (n, mrr, recall@1, 3, 5, 10)} of the ranks, by what of gives for a case."""
    groups, seen = {}, {r["row_id"]: r for r in cases.collect()}
    for row_id, rank in ranks.items():
        groups.setdefault(of(seen[row_id]), []).append(rank)
    share = lambda x, k: sum(r <= k for r in x) / len(x)
    return {g: (len(x), *(round(v, 5) for v in (sum(1 / r for r in x) / len(x), *(share(x, k) for k in (1, 3, 5, 10))))) for g, x in groups.items()}


@pytest.fixture(scope="module")
def ranks(whole):
    cases, index, scores = whole
    return {r["row_id"]: r["best_rank"] for r in R.best_ranks(scores, R.positives(cases, index.rows), index.rows).collect()}


def given(spark, name, *group):
    """The query's rows as metrics_of gives them; its SQL takes every case."""
    assert f"% {R.EVERY}" not in registry.SQL[name]
    return {tuple(r[g] for g in group): (r["n"], *(round(r[c], 5) for c in ("mrr", "recall_1", "recall_3", "recall_5", "recall_10"))) for r in registry.QUERIES[name](spark, FOLDER).collect()}


def near(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)


def test_retrieval_metrics_by_group(spark, whole, ranks):
    near(given(spark, "retrieval_metrics_by_group", "variant_type"), metrics_of(ranks, whole[0], lambda r: (r["variant_type"] or "unknown",)))


def test_variant_summary(spark, whole, ranks):
    every = metrics_of(ranks, whole[0], lambda r: (r["variant_type"] or "unknown",))
    near(given(spark, "variant_summary", "variant_type"), dict(sorted(every.items(), key=lambda x: (-x[1][0], x[0]))[:3]))


def test_retrieval_metrics_by_split(spark, whole, ranks):
    split = {r["source"]: r["split"] for r in R.source_split(table(spark, FOLDER, "equations")).collect()}
    source = {r["row_id"]: r["source"] for r in modal_source(whole[0]).collect()}
    ranked = {i: r for i, r in ranks.items() if source[i] in split}
    near(given(spark, "retrieval_metrics_by_split", "split"), metrics_of(ranked, whole[0], lambda r: (split[source[r["row_id"]]],)))


def test_retrieval_metrics_nonblank(spark, whole, ranks):
    blank = {r["row_id"] for r in whole[0].collect() if not (r["context"] or "").strip()}
    near(given(spark, "retrieval_metrics_nonblank"), metrics_of({i: r for i, r in ranks.items() if i not in blank}, whole[0], lambda r: ()))

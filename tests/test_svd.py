"""SVD of TF-IDF weights and ranks by cosine against numpy."""

import random
from collections import Counter

import numpy as np

from equarry.operators import svd
from equarry.plans import registry


def test_products_agree_with_the_dense_matrix():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (30, 12)) * (rng.random((30, 12)) < 0.5)
    idf = rng.random(12) + 1
    w = svd.Weights([np.flatnonzero(r) for r in a], [r[r > 0] for r in a], idf, head=4)
    want = svd.unit(a * idf)
    m, y, out = rng.normal(size=(12, 5)).astype(np.float32), rng.normal(size=(30, 5)).astype(np.float32), np.zeros((12, 5), np.float32)
    w.add_transposed(y, out)
    assert np.allclose(w.times(m), want @ m, atol=1e-5) and np.allclose(out, want.T @ y, atol=1e-5)


def test_svd_cosine_ranks(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta mass flow heat".split()) for _ in range(9))
    texts, asked = [text() for _ in range(40)], [text() for _ in range(12)]
    equations = spark.createDataFrame([(i, "S", f"e{i}", "", {}, t, None) for i, t in enumerate(texts)], "row_id bigint, source_id string, eq_id string, equation string, variables map<string,string>, context_text string, domain string")
    cases = spark.createDataFrame([(i, t, ["alpha"], None, [f"S__e{3 * i}", f"S__e{3 * i + 1}"]) for i, t in enumerate(asked)] + [(99, "heat", None, None, None)], "row_id bigint, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>")
    fitted = svd.TfIdfSvd(equations, dims=6, size=16, head=5)

    number, grams = fitted.vocabulary.number.value, lambda t: t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])]

    def weights(ts):
        counts = [Counter(grams(t.lower())) for t in ts]
        return svd.unit(np.array([[c[x] for x in number] for c in counts]) * fitted.idf)

    a = weights(texts)
    _, value, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(fitted.values, value[:6], rtol=1e-4)
    score = np.round(svd.unit(weights([f"{t} INPUT alpha" for t in asked]) @ v[:6].T) @ svd.unit(a @ v[:6].T).T, 4)
    got = {r["row_id"]: r["best_rank"] for r in fitted.best_ranks(cases).collect()}
    assert sorted(got) == list(range(12))
    for i in range(12):
        s = max(score[i, 3 * i], score[i, 3 * i + 1])
        assert (score[i] > s).sum() < got[i] <= (score[i] >= s).sum()


def test_metrics_are_registered(spark):
    row = registry.QUERIES["retrieval_metrics_svd"](spark, "/root/testdata/sf0.001").first()
    assert row["n"] > 0 and 0 < row["mrr"] <= 1

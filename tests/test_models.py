import numpy as np
import pytest
from pyspark.sql import functions as F

from equarry.operators import graph, learning, models


def planted(n=40, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = learning.unit(rng.normal(size=(n, d)))
    p = models.adjacency([[f"s{i // 4}"] for i in range(n)])
    right = [np.array([i]) for i in range(n)]
    return x, p, learning.unit(x + 0.3 * rng.normal(size=x.shape)), right


def test_refiner_without_weight_changes_nothing():
    x, p, _, _ = planted()
    assert np.allclose(models.Refiner.fresh(6, np.random.default_rng(1)).forward(x, p)[0], x)


@pytest.mark.parametrize("alpha", [0.4, -0.7, 1.5])
def test_refiner_gradient(alpha):
    x, p, q, _ = planted(12, 4)
    model = models.Refiner.fresh(4, np.random.default_rng(2))
    model.alpha[0], model.b1[:], model.b2[:] = alpha, 0.1, -0.2
    value = lambda: float((model.forward(x, p)[0] * q).sum())
    e, kept = model.forward(x, p)
    for param, g in zip(model.params(), model.gradients(e, q, kept)):
        for at in list(np.ndindex(param.shape))[:5]:
            was = param[at]
            param[at] = was + 1e-6
            high = value()
            param[at] = was - 1e-6
            low = value()
            param[at] = was
            assert abs((high - low) / 2e-6 - g[at]) < 1e-4


def test_refiner_learns_its_weight():
    x, p, q, right = planted(60, 8)
    model, losses = models.train_refiner(x, p, q, right, 5e-3, 1e-4, epochs=15, negatives=20)
    assert losses[-1] < losses[0] and model.alpha[0] != 0


def test_ranks_and_wrong_rows():
    score = np.array([[0.5, 0.5, 0.1], [0.0, 0.2, 0.2]])
    assert models.ranks(score, [np.array([1]), np.array([0, 2])]).tolist() == [2, 2]
    rng = np.random.default_rng(0)
    assert not np.isin(models._wrong(rng, 5, np.array([1, 3]), 200), [1, 3]).any() and len(models._wrong(rng, 2, np.array([0, 1]), 3)) == 3
    assert models._measured(np.zeros(0, np.int64)) == [0, 0.0, 0.0, 0.0, 0.0, 0.0]


def tables(spark):
    words = "alpha beta gamma delta mass flow heat pump".split()
    eqs = [(i, f"f{i % 8}", f"e{i}", "", {words[i % 8]: "", f"v{i % 5}": ""}, f"{words[i % 8]} {words[(3 * i + 1) % 8]} number{i}", "d") for i in range(64)] + [(64, "f1", "x", "", None, None, None)]
    cases = [(i, None, None, None, f"find {words[i % 8]} {words[(3 * i + 1) % 8]} number{i}", [words[i % 8]], [], [f"f{i % 8}__e{i}", "gone"]) for i in range(64)] + [(70, None, None, None, None, None, None, None)]
    return (
        spark.createDataFrame(eqs, "row_id bigint, source_id string, eq_id string, equation string, variables map<string,string>, context_text string, domain string"),
        spark.createDataFrame(cases, "row_id bigint, case_id string, original_core_id string, variant_type string, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>"),
    )


def test_grid_on_a_sample_and_the_refiner_on_all(spark):
    eqs, cases = tables(spark)
    sample, svd = models.sample_of(cases, eqs, dims=12, rounds=2, most_nodes=60)
    assert len(sample.ids) == 60 and set(sample.split) == {"train", "val", "test"} and all(len(r) == 1 for r in sample.right)
    got = models.model_grid(sample, spark, ((1e-3, 0.0),), ((5e-4, 1e-4),), epochs=3).orderBy("run").collect()
    assert [r["method"] for r in got] == ["q_mlp_to_x", "gnn_refine_svd_residual"] and got[1]["alpha"] != 0 and got[0]["alpha"] is None
    assert all(r["val_n"] > 0 and r["test_n"] > 0 and 0 < r["val_mrr"] <= 1 for r in got)
    # over the whole graph the refiner gives what its definition gives
    texts = eqs.select(F.col("row_id").alias("id"), F.col("context_text").alias("text"))
    vectors = models.materialize(svd.vectors(texts), "v")
    model, _ = models.train_refiner(learning.unit(sample.x), models.adjacency(sample.symbols), learning.unit(sample.q), sample.right, 1e-3, 0.0, epochs=1)
    rows = {r["node"]: r["x"] for r in vectors.collect()}
    symbols = {r["row_id"]: list(r["variables"] or {}) for r in eqs.collect()}
    x = np.array([rows[i] for i in range(65)])
    want = model.forward(x, models.adjacency([symbols[i] for i in range(65)]))[0]
    out = {r["node"]: r["x"] for r in models.refined(eqs, vectors, model).collect()}
    assert np.allclose(np.array([out[i] for i in range(65)]), want, atol=1e-6)


def test_two_layers(spark):
    eqs, _ = tables(spark)
    rng = np.random.default_rng(3)
    x, w1, w2 = rng.normal(size=(65, 5)), rng.normal(size=(5, 4)), rng.normal(size=(4, 3))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node bigint, x array<double>")
    p = models.adjacency([list(r["variables"] or {}) for r in eqs.orderBy("row_id").collect()])
    got = {r["node"]: r["x"] for r in models.two_layers(graph.arcs_between(eqs, vectors), vectors, w1, w2).collect()}
    assert np.allclose(np.array([got[i] for i in range(65)]), p @ (np.maximum(p @ (x @ w1), 0) @ w2))


def test_no_cases(spark):
    eqs, cases = tables(spark)
    sample, _ = models.sample_of(cases.limit(0), eqs, dims=4, rounds=1, most_nodes=10)
    assert models.model_grid(sample, spark).collect() == []

"""One propagation step over the whole symbol graph."""

import numpy as np

from equarry.operators import graph, models
from equarry.plans import registry


def test_propagate_all_agrees_with_the_dense_adjacency(spark):
    rng = np.random.default_rng(5)
    sets = [set(rng.choice(list("abcdefgh"), rng.integers(1, 4), replace=False).tolist()) for _ in range(30)] + [{"a", "b"}, {"a", "b"}, {"zz"}, set(), None]
    x = rng.normal(size=(len(sets), 3))
    equations = spark.createDataFrame([(7 * i, None if v is None else {k: "" for k in v}) for i, v in enumerate(sets)], "row_id bigint, variables map<string,string>")
    vectors = spark.createDataFrame([(7 * i, r.tolist()) for i, r in enumerate(x)], "node bigint, x array<double>")
    a = np.array([[i == j or bool(p and q and p & q) for j, q in enumerate(sets)] for i, p in enumerate(sets)], float)
    d = a.sum(1)
    want = a / np.sqrt(d[:, None] * d) @ x
    got = {r["node"]: r["x"] for r in graph.propagate_all(equations, vectors).collect()}
    assert len(got) == len(sets) and np.allclose([got[7 * i] for i in range(len(sets))], want, atol=1e-5)


def test_gcn_propagate_all_gives_every_equation_a_row(spark):
    folder = "/root/testdata/sf0.001"
    nodes = {r[0] for r in spark.read.parquet(f"{folder}/equations.parquet").select("row_id").collect()}
    assert {r["node"] for r in registry.QUERIES["gcn_propagate_all"](spark, folder).select("node").collect()} == nodes


def test_both_steps_of_the_refiner_share_one_list_of_classes(spark, monkeypatch):
    """The driver held and sent the classes' symbols once for each step."""
    made, init = [], graph.Ties.__init__
    monkeypatch.setattr(graph.Ties, "__init__", lambda self, lists: made.append(1) or init(self, lists))
    equations = spark.createDataFrame([(1, {"a": ""}), (2, {"a": "", "b": ""}), (3, {"b": ""})], "row_id bigint, variables map<string,string>")
    vectors = spark.createDataFrame([(i, [3.0, 4.0]) for i in (1, 2, 3)], "node bigint, x array<double>")
    got = models.refined(equations, vectors, models.Refiner.fresh(2, np.random.default_rng(1))).collect()
    assert len(made) == 1 and all(np.allclose(r["x"], [0.6, 0.8]) for r in got) and len(got) == 3


def test_what_is_sent_does_not_grow_with_the_vectors(spark, monkeypatch):
    """The driver held and sent a class' sums, 8 bytes for each number of a vector."""
    import pickle

    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or broadcast(self, value))
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    n, dims = 300, 200
    equations = spark.range(n).selectExpr("id as row_id", "map(concat('s', id), '', concat('s', (id + 1) % 300), '') as variables")
    vectors = spark.range(n + 1).selectExpr("id as node", f"transform(sequence(1, {dims}), i -> cast(id + i as double)) as x")
    got = {r["node"]: r["x"] for r in graph.propagate_all(equations, vectors, None).collect()}
    assert len(sent) == 2 and max(sent) < 60 * n
    assert all(np.allclose(got[i], [((i - 1) % n + i + (i + 1) % n) / 3 + j for j in range(1, dims + 1)]) for i in range(n)) and got[n][0] == n + 1

import random

import equarry.llm.components as module


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    return {frozenset(x for x in parent if root(x) == r) for r in map(root, list(parent))}


def solved(spark, edges, kind="bigint"):
    rows = module.components(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert len({r["node"] for r in rows}) == len(rows) and all(min(g) == name for name, g in groups.items())
    return {frozenset(g) for g in groups.values()}


def test_random_graph_star_chain_and_odd_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    edges += [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 7), (7, None), (100, 101)]
    assert solved(spark, edges) == brute(edges)


def test_label_graph_searched_again_and_sliced_lists(spark, monkeypatch):
    monkeypatch.setattr(module, "SMALL_GRAPH", 0)
    monkeypatch.setattr(module, "SLICE", 3)
    edges = [(f"f{i}", f"f{(i * 7) % 40}") for i in range(40)] + [("hub", f"x{i}") for i in range(20)]
    assert solved(spark, edges, "string") == brute(edges)


def test_no_edges(spark):
    assert solved(spark, []) == set()

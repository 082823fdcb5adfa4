"""Connected components by breadth-first search from many seeds at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equarry.operators.skew import salted_lookup
from equarry.session import materialize

#: A graph of seed labels with at most so many edges is solved in one task; a larger one is searched like the graph itself.
SMALL_GRAPH = 200_000
#: Neighbours of one node that one task expands; the lists of busier nodes are cut into slices.
SLICE = 50_000


def _order(c: str) -> Column:
    return F.struct(F.xxhash64(c), F.col(c))


def _union_find(batches):
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"], pdf["dst"]):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(src, dst), both of one type that has an order; component is its least node, so it
    doesn't depend on the way it is found.

    Adjacency lists are stored by node, the list of a busy node in slices. Seeds are the nodes whose hash is below those
    of all neighbours, so every component has one. All seeds expand at once, a round for each step: the frontier meets
    the lists, nodes not yet labelled take the least label that reaches them. Where differently labelled nodes are
    neighbours, their labels collide; the collisions are a graph of seeds alone, solved in one task when it is small and
    by the same search otherwise. What is aimed at a busy node is reduced to one label before it is shuffled. Loops, repeated edges and null ends add nothing; no edges give no rows.
    """
    kind = edges.schema["src"].dataType
    both = edges.where("src is not null and dst is not null and src <> dst")
    both = both.select("src", "dst").union(both.select("dst", "src")).distinct()
    degrees = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.min(_order("dst")).alias("least"))
    nodes = materialize(degrees.select(F.col("src").alias("node"), "degree", F.ceil(F.col("degree") / SLICE).cast("int").alias("slices"), (_order("src") < F.col("least")).alias("seed")), "nodes")
    lists = materialize(both.select(F.col("src").alias("node"), "dst"), "adjacency")
    busy = nodes.where("slices > 1").select("node", "slices")
    sliced = bool(busy.limit(1).count())
    if sliced:
        lists = materialize(lists.join(busy, "node", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("dst"), "slices"), F.lit(0)).cast("int")).drop("slices"), "adjacency")

    labelled = materialize(nodes.where("seed").select("node", F.col("node").alias("label")), "frontier")
    frontier, waiting = labelled, nodes.where("not seed").count()
    while waiting:
        if sliced:
            reached = frontier.join(nodes.select("node", "slices"), "node").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices").join(lists, ["node", "slice"])
        else:
            reached = frontier.join(lists, "node")
        aimed = reached.groupBy(F.col("dst").alias("node")).agg(F.min(_order("label")).getField("label").alias("label"))
        frontier = materialize(aimed.join(labelled.select("node"), "node", "left_anti"), "frontier")
        waiting -= frontier.count()
        labelled = labelled.unionByName(frontier)

    named = labelled.join(nodes.select("node", "degree"), "node")
    if sliced:
        spread = named.join(nodes.select("node", "slices"), "node").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        ends = spread.join(lists, ["node", "slice"])
    else:
        ends = named.join(lists, "node")
    ends = ends.select(F.col("label").alias("a"), F.col("dst").alias("node")).distinct()
    met = salted_lookup(ends, named.withColumnRenamed("label", "b"), ["node"], "degree", "a").where("a <> b")
    collisions = materialize(met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "collisions")
    n = collisions.count()
    if n:
        name = kind.simpleString()
        merged = collisions.coalesce(1).mapInPandas(_union_find, f"node {name}, component {name}") if n <= SMALL_GRAPH else components(collisions)
        merged = materialize(merged.select(F.col("node").alias("label"), "component"), "labels")
        of_label = materialize(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).join(merged, "label", "left").withColumn("component", F.coalesce("component", "label")), "oflabel")
    else:
        of_label = materialize(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).withColumn("component", F.col("label")), "oflabel")
    least = of_label.groupBy("component").agg(F.min("least").alias("least"))
    names = of_label.select("label", "n", "component").join(least, "component").select("label", "n", F.col("least").alias("component"))
    return salted_lookup(labelled, names, ["label"], "n", "node").select("node", "component")

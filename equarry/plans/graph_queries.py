"""Queries over the symbol graph and dense vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from equarry.operators import graph as G
from equarry.operators import learning as L
from equarry.operators import models as M
from equarry.operators import vectors as V
from equarry.operators.corpus import equation_text
from equarry.operators.svd import TfIdfSvd
from equarry.sources.tables import table


def _eq(s, d):
    return table(s, d, "equations")


def _nodes(s, d):
    """Vectors of the nodes that have one: a vector belongs to the equation with its number."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("x"))


def _propagated(s, d):
    nodes = _nodes(s, d).join(_eq(s, d).select(F.col("row_id").alias("node")), "node", "left_semi")
    return G.propagate(G.arcs_between(_eq(s, d), nodes), nodes)


def _propagated_all(s, d):
    """Every equation's singular vector of its TF-IDF weights, one step over the whole graph."""
    texts = _eq(s, d).select(F.col("row_id").alias("id"), equation_text().alias("text"))
    fitted = TfIdfSvd(_eq(s, d))
    fitted.drop()
    return G.propagate_all(_eq(s, d), fitted.stored_vectors(texts))


def _svd(s, d):
    """Coordinates of the vectors in the space of the eight largest singular values."""
    rows = _nodes(s, d)
    _, basis = V.singular_basis(rows, 8)
    return V.project(rows, basis)


def _residual(s, d):
    """How far a refiner of weight 0 moves each vector, over the whole symbol graph."""
    nodes = _nodes(s, d)
    after = M.refined(_eq(s, d), nodes, M.Refiner.fresh(64, np.random.default_rng(1))).withColumnRenamed("x", "y")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
    far = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") / length - y)))
    return nodes.join(after, "node").select("node", (F.round(far, 9) + 0.0).alias("moved"))


def _grid(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    centres = e.select("label", F.posexplode("x").alias("p", "v")).groupBy("label", "p").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda z: z["v"]).alias("item"))
    labelled = e.join(centres, "label").select(F.col("x").alias("q"), "item", F.col("label").cast("bigint").alias("item_id"))
    return L.grid_search([(rate, decay) for rate in (1e-3, 5e-4) for decay in (0.0, 1e-3)], labelled)


def _formula(rows: int, columns: int) -> np.ndarray:
    i, j = np.mgrid[:rows, :columns]
    return ((i * 7 + j * 3) % 11 - 5) / 10


def _two_layers(s, d):
    """Two graph convolutions with weights given by a formula, 64 to 8 to 4 numbers."""
    nodes = _nodes(s, d).join(_eq(s, d).select(F.col("row_id").alias("node")), "node", "left_semi")
    out = M.two_layers(G.arcs_between(_eq(s, d), nodes), nodes, _formula(64, 8), _formula(8, 4))
    return out.select("node", F.posexplode("x").alias("dim", "v")).select("node", "dim", (F.round("v", 4) + 0.0).alias("value"))


def _models(s, d):
    sample, _ = M.sample_of(table(s, d, "training_cases"), _eq(s, d))
    return M.model_grid(sample, s)


def _argmax(s, d):
    runs = table(s, d, "events").groupBy(F.col("event_type").alias("config")).agg(F.round(F.avg("value"), 6).alias("score"), F.min("event_id").alias("run"))
    return L.best_run(runs, "score")


QUERIES = {
    "bipartite_edges": lambda s, d: G.incidence(_eq(s, d)),
    "node_degree": lambda s, d: G.degrees(_eq(s, d)),
    "degree_stats": lambda s, d: G.degree_stats(G.degrees(_eq(s, d))),
    "degree_histogram": lambda s, d: G.degrees(_eq(s, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("n")),
    "symbol_class_links": lambda s, d: G.class_pairs(_eq(s, d)),
    "bipartite_var_features": lambda s, d: G.symbol_features(G.incidence(_eq(s, d)), _nodes(s, d)),
    "gcn_propagate": _propagated,
    "gcn_propagate_all": _propagated_all,
    "embedding_cosine_topk": lambda s, d: V.cosine_top(table(s, d, "embeddings")),
    "svd_project": _svd,
    "pca_2d": lambda s, d: V.principal_components(_nodes(s, d)),
    "residual_alpha0_identity": _residual,
    "grid_search_infonce": _grid,
    "gcn2_fixed": _two_layers,
    "model_grid": _models,
    "model_best": lambda s, d: L.best_run(_models(s, d), "val_mrr"),
    "config_argmax": _argmax,
}

_ARCS = """keys as (select row_id node, unnest(map_keys(variables)) k from equations),
arcs as (select distinct x.node src, y.node dst from keys x join keys y on x.k = y.k and x.node <> y.node),
degrees as (select src node, count(*) degree from arcs group by 1)
"""

SQL = {
    "bipartite_edges": "select row_id node, unnest(map_keys(variables)) symbol from equations",
    "node_degree": "with " + _ARCS + "select node, degree from degrees",
    "degree_stats": "with " + _ARCS + "select count(*) n_nodes, sum(degree)::bigint n_arcs, min(degree) least, max(degree) most, round(avg(degree), 6) mean from degrees",
    "degree_histogram": "with " + _ARCS + "select degree, count(*) n from degrees group by 1",
    "symbol_class_links": """with sets as (select row_id, list_sort(map_keys(variables)) s from equations where cardinality(variables) > 0),
classes as (select min(row_id) c, s from sets group by s), keys as (select c, unnest(s) k from classes)
select distinct x.c a, y.c b from keys x join keys y on x.k = y.k and x.c < y.c""",
    "bipartite_var_features": f"""with keys as (select row_id node, unnest(map_keys(variables)) symbol from equations),
each as (select symbol, unnest(range(0, len(embedding)))::int dim, embedding x from keys join embeddings on node = vec_id)
select symbol, dim, round(avg(x[dim + 1]::double), {G.DIGITS}) + 0.0 as value from each group by 1, 2""",
    "gcn_propagate": f"""with nodes as (select vec_id node, embedding x from embeddings where vec_id in (select row_id from equations)),
keys as (select row_id node, unnest(map_keys(variables)) k from equations where row_id in (select node from nodes)),
arcs as (select distinct x.node src, y.node dst from keys x join keys y on x.k = y.k and x.node <> y.node union all select node, node from nodes),
deg as (select src node, count(*) d from arcs group by 1),
terms as (select dst, 1 / sqrt(a.d * b.d) c, x, unnest(range(0, len(x)))::int dim from arcs join deg a on src = a.node join deg b on dst = b.node join nodes n on src = n.node)
select dst node, dim, round(sum(c * x[dim + 1]::double), {G.DIGITS}) + 0.0 as value from terms group by 1, 2""",
    "gcn2_fixed": """with nodes as (select vec_id node, embedding x from embeddings where vec_id in (select row_id from equations)),
keys as (select row_id node, unnest(map_keys(variables)) k from equations where row_id in (select node from nodes)),
arcs as (select distinct x.node src, y.node dst from keys x join keys y on x.k = y.k and x.node <> y.node union all select node, node from nodes),
deg as (select src node, count(*) d from arcs group by 1),
coef as (select src, dst, 1 / sqrt(a.d * b.d) c from arcs join deg a on src = a.node join deg b on dst = b.node),
h1 as (select node, j, sum(x[i + 1]::double * ((i * 7 + j * 3) % 11 - 5) / 10.0::double) v from nodes, (select unnest(range(64)) i), (select unnest(range(8)) j) group by 1, 2),
p1 as (select dst node, j, greatest(sum(c * v), 0) v from coef join h1 on src = node group by 1, 2),
h2 as (select node, m, sum(v * ((j * 7 + m * 3) % 11 - 5) / 10.0::double) v from p1, (select unnest(range(4)) m) group by 1, 2)
select dst node, m::int dim, round(sum(c * v), 4) + 0.0 as value from coef join h2 on src = node group by 1, 2""",
    "embedding_cosine_topk": f"""select q.vec_id query, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) score,
  row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id) place
from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % {V.EVERY} = 0 qualify place <= 10""",
    "residual_alpha0_identity": "select vec_id node, 0.0::double moved from embeddings",
    "config_argmax": "select event_type config, round(avg(value), 6) score, min(event_id) run from events group by 1 order by 2 desc, 3 limit 1",
}

"""Queries over TF-IDF weights, scores, ranks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from equarry.functions.text import TERM
from equarry.operators import retrieval as R
from equarry.operators.cases import modal_source
from equarry.operators.reports import first_groups, with_text
from equarry.operators.svd import TfIdfSvd
from equarry.plans import sqltext as S
from equarry.sources.tables import table


def _cases(s, d):
    return R.query_cases(table(s, d, "training_cases"))


def _every_case(s, d):
    return table(s, d, "training_cases")


def _index(s, d):
    return R.Index(table(s, d, "equations"))


def _mixed_ranks(s, d):
    return _index(s, d).ranks(_cases(s, d))


def _symbol_ranks(s, d):
    return _index(s, d).ranks(_cases(s, d), 0.0, 1.0)


def _svd_ranks(s, d):
    return TfIdfSvd(table(s, d, "equations")).best_ranks(_cases(s, d))


def _every_rank(s, d):
    return _index(s, d).ranks(_every_case(s, d))


def _by_variant(s, d):
    return R.metrics(_every_rank(s, d).join(_every_case(s, d).select("row_id", F.coalesce("variant_type", F.lit("unknown")).alias("variant_type")), "row_id"), "variant_type")


def _nonblank(s, d):
    return R.metrics(_index(s, d).ranks(with_text(_every_case(s, d))))


def _variant_summary(s, d):
    return first_groups(_by_variant(s, d), 3)


def _split_counts(s, d):
    split = R.source_split(table(s, d, "equations"))
    return modal_source(table(s, d, "training_cases")).join(split, "source").groupBy("split").agg(F.count(F.lit(1)).alias("n_cases"))


def _split_metrics(s, d):
    split = R.source_split(table(s, d, "equations"))
    return R.metrics(_every_rank(s, d).join(modal_source(_every_case(s, d)).join(split, "source").select("row_id", "split"), "row_id"), "split")


QUERIES = {
    "vocab_cap_topk": lambda s, d: _index(s, d).vocab.select("term", "tf", F.round("idf", R.DIGITS).alias("idf")),
    "tfidf_weights": lambda s, d: _index(s, d).weights.select(F.col("id").alias("idx"), "term", F.round("w", R.DIGITS).alias("w")),
    "text_cosine_topk": lambda s, d: _index(s, d).best(_cases(s, d), 10, 1.0, 0.0),
    "jaccard_topk": lambda s, d: _index(s, d).best(_cases(s, d), 10, 0.0, 1.0),
    "mix_score_topk": lambda s, d: _index(s, d).best(_every_case(s, d), 10),
    "best_rank_mix": _mixed_ranks,
    "best_rank_jaccard": _symbol_ranks,
    "retrieval_metrics": lambda s, d: R.metrics(_mixed_ranks(s, d)),
    "retrieval_metrics_jaccard": lambda s, d: R.metrics(_symbol_ranks(s, d)),
    "retrieval_metrics_by_group": _by_variant,
    "retrieval_metrics_by_split": _split_metrics,
    "retrieval_metrics_nonblank": _nonblank,
    "variant_summary": _variant_summary,
    "source_split_two_way": lambda s, d: R.source_split(table(s, d, "equations"), validation=0),
    "source_split": lambda s, d: R.source_split(table(s, d, "equations")),
    "split_case_counts": _split_counts,
    "negative_samples": lambda s, d: R.sampled_negatives(_cases(s, d), R.indexed(table(s, d, "equations"))),
    "svd_cosine": _svd_ranks,
    "retrieval_metrics_svd": lambda s, d: R.metrics(_svd_ranks(s, d)),
    "training_negatives": lambda s, d: R.negatives(table(s, d, "training_cases"), R.indexed(table(s, d, "equations"))),
}

_M = S.items("correct_model_ids")
_BASE = f"""with recursive cand as (select * from (select {S.global_key()} as key, row_id idx, * exclude (row_id) from equations where {S.filled('eq_id')} is not null) qualify row_number() over (partition by key order by idx) = 1),
cases as (select * from training_cases where row_id % {R.EVERY} = 0),
positive as (select distinct row_id, idx from (select row_id, unnest({_M}) as key from cases) join cand using (key)),
"""


def _grams(source: str, id_: str, text: str) -> str:
    return f"""(select id, term, count(*) tf from (select id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) term
  from (select {id_} id, regexp_extract_all(lower({text}), '{TERM}') t from {source})) group by 1, 2)"""


_TEXT = (
    _BASE
    + f"""counts as {_grams('cand', 'idx', f"concat_ws(chr(10), {S.filled('context_text')}, {S.filled('equation')}, {S.filled('domain')})")},
vocab as (select term, tf, ln((1 + (select count(*) from cand)) / (1 + df)) + 1 idf from (select term, sum(tf)::bigint tf, count(*) df from counts group by 1) order by tf desc, term limit {R.VOCABULARY}),
weights as (select id, term, c.tf * idf / sqrt(sum(c.tf * idf * c.tf * idf) over (partition by id)) w from counts c join vocab using (term)),
qcounts as {_grams('cases', 'row_id', f"coalesce({S.trim('context')}, '')")},
qweights as (select id, term, c.tf * idf / sqrt(sum(c.tf * idf * c.tf * idf) over (partition by id)) w from qcounts c join vocab using (term)),
text_scores as (select q.id row_id, d.id idx, sum(q.w * d.w) text_score from qweights q join weights d using (term) group by 1, 2)
"""
)
_SYMBOLS = f"""esym as (select idx, len(s) n, unnest(s) symbol from (select idx, list_distinct({S.items('map_keys(variables)')}) s from cand)),
qsym as (select row_id, len(s) m, unnest(s) symbol from (select row_id, list_distinct(list_concat({S.items('input_variables')}, {S.items('output_variables')})) s from cases)),
symbol_scores as (select row_id, idx, count(*) / (any_value(m) + any_value(n) - count(*)) symbol_score from qsym join esym using (symbol) group by 1, 2)
"""
_MIXED = _TEXT + ", " + _SYMBOLS + f""", scores as (select row_id, idx, round({R.TEXT_WEIGHT}::double * coalesce(text_score, 0) + {R.SYMBOL_WEIGHT}::double * coalesce(symbol_score, 0), {R.DIGITS}) score from text_scores full join symbol_scores using (row_id, idx))
"""
_EVERY_MIXED = _MIXED.replace(f" where row_id % {R.EVERY} = 0", "")
_JACCARD = _BASE + _SYMBOLS + f", scores as (select row_id, idx, round(symbol_score, {R.DIGITS}) score from symbol_scores)\n"
_RANKS = """, ranked as (select c.row_id, k.idx, row_number() over (partition by c.row_id order by coalesce(score, 0) desc, k.idx) r from (select distinct row_id from positive) c cross join cand k left join scores s on s.row_id = c.row_id and s.idx = k.idx),
ranks as (select row_id, min(r) best_rank from ranked join positive using (row_id, idx) group by 1)
"""
_TOP = "select row_id, idx, {s} score, row_number() over (partition by row_id order by {s} desc, idx) place from {t} qualify place <= 10"
_METRICS = ", ".join(["count(*) n", "coalesce(round(avg(1.0::double / best_rank), 6), 0) mrr", *[f"coalesce(round(avg(case when best_rank <= {k} then 1.0::double else 0 end), 6), 0) recall_{k}" for k in (1, 3, 5, 10)]])
_SPLIT = f"""sources as (select source, row_number() over (order by substr(md5('42|' || source), 1, 15), source) - 1 at_, count(*) over () n from (select distinct coalesce({S.filled('source_id')}, 'unknown') source from equations where {S.filled('eq_id')} is not null)),
split as (select source, case when at_ < greatest(1, round_even(n * 0.2::double, 0)) then 'test' when at_ < greatest(1, round_even(n * 0.2::double, 0)) * 2 then 'val' else 'train' end split from sources)"""
_MODAL = f"""each as (select row_id, generate_subscripts(x, 1) p, x from (select row_id, {_M} x from training_cases)),
ids as (select row_id, p, split_part(x[p], '__', 1) source from each where contains(x[p], '__')),
modal as (select row_id, source from (select row_id, source, count(*) n, min(p) f from ids group by 1, 2) qualify row_number() over (partition by row_id order by n desc, f) = 1),
of_case as (select row_id, coalesce(source, 'unknown') source from training_cases left join modal using (row_id))"""

def _mix64(z: str) -> str:
    wrap = "& 18446744073709551615::uhugeint"
    for shift, factor in zip((30, 27), R.MIX):
        z = f"((xor({z}, {z} >> {shift}) * {factor}::uhugeint) {wrap})"
    return f"xor({z}, {z} >> 31)"


SQL = {
    "vocab_cap_topk": _TEXT + "select term, tf, round(idf, 6) idf from vocab",
    "tfidf_weights": _TEXT + "select id idx, term, round(w, 6) w from weights",
    "text_cosine_topk": _TEXT + _TOP.format(s="round(text_score, 6)", t="text_scores"),
    "jaccard_topk": _JACCARD + _TOP.format(s="score", t="scores"),
    "mix_score_topk": _EVERY_MIXED + _TOP.format(s="score", t="scores"),
    "best_rank_mix": _MIXED + _RANKS + "select row_id, best_rank from ranks",
    "best_rank_jaccard": _JACCARD + _RANKS + "select row_id, best_rank from ranks",
    "retrieval_metrics": _MIXED + _RANKS + f"select {_METRICS} from ranks",
    "retrieval_metrics_jaccard": _JACCARD + _RANKS + f"select {_METRICS} from ranks",
    "retrieval_metrics_by_group": _EVERY_MIXED + _RANKS + f"select coalesce(variant_type, 'unknown') as variant_type, {_METRICS} from ranks join cases using (row_id) group by 1",
    "retrieval_metrics_by_split": _EVERY_MIXED + _RANKS + f", {_SPLIT}, {_MODAL} select split, {_METRICS} from ranks join of_case using (row_id) join split using (source) group by 1",
    "retrieval_metrics_nonblank": _EVERY_MIXED + _RANKS + f"select {_METRICS} from ranks join cases using (row_id) where {S.filled('context')} is not null",
    "variant_summary": _EVERY_MIXED + _RANKS + f"select coalesce(variant_type, 'unknown') as variant_type, {_METRICS} from ranks join cases using (row_id) group by 1 order by n desc, 1 limit 3",
    "source_split_two_way": f"with {_SPLIT} select source, case split when 'val' then 'train' else split end split from split",
    "source_split": f"with {_SPLIT} select source, split from split",
    "split_case_counts": f"with {_SPLIT}, {_MODAL} select split, count(*) n_cases from of_case join split using (source) group by 1",
    "negative_samples": _BASE
    + """placed as (select idx, row_number() over (order by idx) - 1 at_ from cand),
draws as (select row_id, t, ('0x' || substr(md5('42|' || row_id || '|' || t), 1, 12))::bigint % (select count(*) from cand) at_ from cases, (select unnest(range(1, 21)) t)),
kept as (select row_id, t, idx from draws join placed using (at_) anti join positive using (row_id, idx))
select row_id, row_number() over (partition by row_id order by t) place, idx from kept qualify place <= 5""",
    "training_negatives": _BASE.replace(f" where row_id % {R.EVERY} = 0", "")
    + f"""placed as (select idx, row_number() over (order by idx) - 1 at_ from cand),
starts as (select row_id, {_mix64('row_id::uhugeint')} z from cases),
draws as (select row_id, t, ({_mix64('y')} % (select count(*) from cand)::uhugeint)::bigint at_ from (select row_id, t, (z + t::uhugeint * {R.GAMMA}::uhugeint) & 18446744073709551615::uhugeint y from starts, (select unnest(range(1, {3 * R.NEGATIVES})) t))),
kept as (select row_id, t, idx from draws join placed using (at_) anti join positive using (row_id, idx) qualify row_number() over (partition by row_id order by t) <= {R.NEGATIVES})
select row_id, list(idx order by t) negatives from kept group by 1""",
}

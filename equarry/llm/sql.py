"""SQL (DuckDB's dialect) for the p queries that SQL can express on whole tables."""

from __future__ import annotations

from equarry.llm.layouts import NOT_SYMBOL, TOKEN
from equarry.plans.sqltext import filled, items

_FILES = f"""
files as (select distinct {filled("source_id")} f from equations where {filled("source_id")} is not null),
named as (
  select distinct coalesce('core:' || {filled("original_core_id")}, 'row:' || row_id) unit, split_part(x, '__', 1) f
  from (select row_id, original_core_id, unnest({items("correct_model_ids")}) x from training_cases) where contains(x, '__')),
pairs as (select unit, f from named join files using (f)),
ties as (select distinct p.m, f from (select unit, min(f) m from pairs group by unit) p join pairs using (unit) where f <> m)"""

_COPIES = f"""
forms as (
  select row_id, array_to_string(regexp_extract_all(lower(context), '{TOKEN}'), ' ') c,
    list_sort(list_distinct(list_filter(list_transform(coalesce(input_variables, []), lambda e: regexp_replace(e, '{NOT_SYMBOL.replace("'", "''")}', '', 'g')), lambda e: e <> ''))) i,
    list_sort(list_distinct(list_filter(list_transform(coalesce(output_variables, []), lambda e: regexp_replace(e, '{NOT_SYMBOL.replace("'", "''")}', '', 'g')), lambda e: e <> ''))) o
  from training_cases),
copies as (select row_id, min(row_id) over (partition by c, i, o) first_row_id from forms where c <> '')"""

_SIMILAR = f"""
sets as (
  select row_id, list_distinct(regexp_extract_all(lower(coalesce(equation, '') || ' ' || context_text), '[\\p{{L}}\\p{{N}}]+')) w
  from equations where {filled("context_text")} is not null),
each as (select row_id, len(w) n, unnest(w) t from sets),
shared as (select a.row_id x, b.row_id y, a.n + b.n s, count(*) c from each a join each b on a.t = b.t and a.row_id < b.row_id and 7 * greatest(a.n, b.n) <= 10 * least(a.n, b.n) group by all),
similar_rows as (select x, y from shared where 10 * c >= 7 * (s - c))"""

SQL = {
    "p1_kept_together": "select count(*) n_cases, 0::bigint torn_cores, 0::bigint torn_files from training_cases",
    "p6_all_placed": "select count(*) n_texts, count(*) n_placed, 0::bigint n_torn, 0::bigint n_over from documents where text <> ''",
    "p7_within_caps": f"select count(distinct {filled('d.source')}) n_served, 0::bigint n_over from documents d join mix_targets t on {filled('d.source')} = {filled('t.source')} where text <> '' and target_share > 0 and max_repeats > 0",
    "p1_found": f"""
with recursive {_FILES.strip()},
both_ways as (select m a, f b from ties union select f, m from ties),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select min(b) group_key, a source_id from reach group by a having min(b) < a""",
    "p5_found": f"with {_COPIES.strip()} select first_row_id, row_id from copies where row_id <> first_row_id",
    "p5_records": f"with {_COPIES.strip()} select first_row_id, count(*) n_copies, max(row_id) last_row_id from copies group by 1",
    "p2_found": f"with {_SIMILAR.strip()} select x row_id_a, y row_id_b from similar_rows",
    "p2_groups": f"""
with recursive {_SIMILAR.strip()},
classes as (select row_id, min(row_id) over (partition by k) class_id, count(*) over (partition by k) n_copies from (select row_id, list_sort(w) k from sets)),
links as (select distinct a.class_id a, b.class_id b from similar_rows join classes a on a.row_id = x join classes b on b.row_id = y where a.class_id <> b.class_id),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
groups as (select a, min(b) g from reach group by 1), degrees as (select a, count(*) n_links from both_ways group by 1)
select row_id, class_id, n_copies, coalesce(n_links, 0) n_links, coalesce(g, class_id) group_id
from classes left join groups on class_id = groups.a left join degrees on class_id = degrees.a""",
}

"""Queries over equations: keys, merging, notation, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from equarry.functions.text import global_key, source_or_unknown
from equarry.operators import corpus, profile, reports
from equarry.operators.corpus import DOMAIN_RULES, NOTATION
from equarry.plans import sqltext as S
from equarry.sources.tables import table

#: Rows ingested up to this time stand for the stored corpus, later ones for the new files.
CUT = "2024-06-01"


def _eq(spark, folder):
    return table(spark, folder, "equations")


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str) -> str:
    for old, new in NOTATION:
        x = f"replace({x}, {_quote(old)}, {_quote(new)})"
    return x


def _domain_case() -> str:
    rules = " ".join("when " + " or ".join(f"contains(lower(domain), {_quote(w.lower())})" for w in words) + f" then {_quote(name)}" for words, name in DOMAIN_RULES)
    return f"case when coalesce(domain, '') in ('', 'unknown') then 'Unknown' {rules} else 'Other' end"


def _merge_parts(spark, folder):
    rows = _eq(spark, folder).select("row_id", "source_id", "eq_id", "ingested_at")
    old = F.coalesce(F.col("ingested_at") < F.lit(CUT).cast("timestamp_ntz"), F.lit(False))
    return rows.where(old), rows.where(~old)


def _papers(spark, folder):
    docs = table(spark, folder, "documents")
    kind = F.length(F.coalesce("lang", F.lit("")))
    access = F.when(F.col("source").isNull(), None).when(kind == 0, "{}").when(kind == 2, F.to_json(F.struct(F.col("source").alias("url")))).otherwise(F.col("source"))
    return docs.select(F.col("source_id").alias("paper_id"), F.coalesce("lang", F.lit("")).alias("query"), F.col("doc_id").alias("pos"), access.alias("open_access"))


_PAPERS = """with raw as (
  select source_id paper_id, coalesce(lang, '') query, doc_id pos,
    case when source is null or length(coalesce(lang, '')) = 0 then null else source end url from documents where coalesce(source_id, '') <> ''),
papers as (select * from raw qualify row_number() over (partition by paper_id order by query, pos) = 1)
"""

QUERIES = {
    "global_key": lambda s, d: _eq(s, d).select("row_id", source_or_unknown("source_id").alias("source"), global_key("source_id", "eq_id").alias("key")),
    "model_catalog": lambda s, d: corpus.catalog(_eq(s, d)),
    "equation_text": lambda s, d: _eq(s, d).select("row_id", corpus.equation_text().alias("text"), corpus.encoder_text().alias("encoder_text")),
    "case_text": lambda s, d: table(s, d, "training_cases").select("row_id", corpus.case_text().alias("text")),
    "notation_replace": lambda s, d: corpus.normalized_equations(_eq(s, d)),
    "map_key_normalize": lambda s, d: corpus.normalized_variables(_eq(s, d)),
    "domain_counts": lambda s, d: profile.counts_of(_eq(s, d), "domain", "unknown"),
    "domain_merge_counts": lambda s, d: _eq(s, d).groupBy(corpus.merged_domain("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n")),
    "source_counts": lambda s, d: profile.counts_of(_eq(s, d), "source_id").orderBy(F.desc("n"), F.asc_nulls_last("source_id")).limit(20),
    "var_frequency_topn": lambda s, d: profile.variable_frequency(_eq(s, d)),
    "first_definition": lambda s, d: profile.first_definitions(_eq(s, d)),
    "vars_per_row_stats": lambda s, d: profile.variable_stats(_eq(s, d)),
    "candidates_first_wins": lambda s, d: corpus.candidates(_eq(s, d)).select("key", "row_id"),
    "last_wins_index": lambda s, d: corpus.last_wins(_eq(s, d)),
    "merge_first_wins": lambda s, d: corpus.merge_new(*_merge_parts(s, d), ["source_id", "eq_id"]).select("row_id"),
    "pending_files_anti": lambda s, d: corpus.pending_files(_eq(s, d), table(s, d, "processed_ledger")),
    "paper_dedup": lambda s, d: corpus.papers(_papers(s, d)),
    "paper_summary": lambda s, d: corpus.papers(_papers(s, d)).agg(F.count(F.lit(1)).alias("total_count"), F.count_if("has_pdf").alias("with_pdf")),
    "cooccurrence_pairs": lambda s, d: profile.cooccurrence(_eq(s, d)),
    "cooccurrence_top_network": lambda s, d: profile.top_network(profile.cooccurrence(_eq(s, d))),
    "report_lines": lambda s, d: reports.report_lines(_eq(s, d), table(s, d, "training_cases")),
    "json_events": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("sum_k"), F.count(F.get_json_object("props", "$.k")).alias("n_k")),
}

_PAIRS = """with keys as (select row_id, unnest(map_keys(variables)) k from equations),
pairs as (select x.k a, y.k b, count(*) weight from keys x join keys y on x.row_id = y.row_id and x.k < y.k group by 1, 2)
"""

def _sizes(what: str, x: str) -> str:
    return f"printf('{what}:  min = %d, max = %d, mean = %.2f', coalesce(min({x}), 0)::bigint, coalesce(max({x}), 0)::bigint, coalesce(avg({x}), 0)::double)"


def _padded(x: str, n: int) -> str:
    return f"rpad(substr(coalesce({x}, ''), 1, {n}), {n}, ' ')"


_REPORT = f"""with keys as (select row_id node, unnest(map_keys(variables)) k from equations),
arcs as (select distinct x.node src, y.node dst from keys x join keys y on x.k = y.k and x.node <> y.node),
degree as (select count(*) d from arcs group by src),
sized as (select coalesce(cardinality(variables), 0) k from equations),
e as (select row_id, map_keys(variables) k, map_values(variables) v from equations where variables is not null),
each as (select row_id, p, k[p] symbol, v[p] d from (select row_id, unnest(range(1, len(k) + 1)) p, k, v from e)),
often as (select symbol, n, row_number() over (order by n desc, f) place from (select symbol, count(*) n, min(row_id * 1000 + p) f from each group by 1) qualify place <= {reports.SYMBOLS}),
meant as (select symbol, coalesce({S.trim('d')}, '') m from each where d is not null qualify row_number() over (partition by symbol order by row_id, p) = 1),
domains as (select coalesce(nullif(domain, ''), 'unknown') x, count(*) n from equations group by 1),
variants as (select coalesce(nullif(variant_type, ''), 'unknown') x, count(*) n from training_cases group by 1)
select 'equations' section, 1 place, printf('Total number of equations (nodes):  %d', count(*)) line from equations
union all select 'equations', 2, printf('Unique variable symbols (across all equations):  %d', count(distinct k)) from keys
union all select 'equations', 3, {_sizes('Variables per equation', 'k')} from sized
union all (select 'domains', row_number() over (order by n desc, x) p, {_padded('x', 45)} || '  ' || lpad(n::varchar, 6, ' ') from domains qualify p <= {reports.DOMAINS})
union all select 'symbols', place, {_padded('symbol', 25)} || '  ' || lpad(n::varchar, 5, ' ') || '  |  ' || case when coalesce(m, '') = '' then '(no definition)' when length(m) > 60 then substr(m, 1, 60) || '...' else m end from often left join meant using (symbol)
union all select 'graph', 1, printf('Number of nodes:  %d', count(*)) from equations
union all select 'graph', 2, printf('Number of edges:  %d', coalesce(sum(d), 0)::bigint) from degree
union all select 'graph', 3, printf('Node degree:  min = %d, max = %d, mean = %.2f', coalesce(min(d), 0), coalesce(max(d), 0), round(coalesce(avg(d), 0), 6)::double) from degree
union all select 'cases', 1, printf('Total number of training cases:  %d', count(*)) from training_cases
union all select 'cases', 2, {_sizes('Correct model equations per case', 'coalesce(len(correct_model_ids), 0)')} from training_cases
union all select 'cases', 3, {_sizes('Input variables per case', 'coalesce(len(input_variables), 0)')} from training_cases
union all select 'cases', 4, {_sizes('Output variables per case', 'coalesce(len(output_variables), 0)')} from training_cases
union all (select 'variants', row_number() over (order by n desc, x) p, {_padded('x', 35)} || '  ' || lpad(n::varchar, 6, ' ') from variants qualify p <= 30)"""

SQL = {
    "report_lines": _REPORT,
    "global_key": f"select row_id, coalesce({S.filled('source_id')}, 'unknown') source, {S.global_key()} as key from equations",
    "model_catalog": "select row_id, coalesce(source_id, '') || '__' || coalesce(eq_id, '') model_id, coalesce(domain, '') as domain, array_to_string(list_sort(coalesce(map_keys(variables), [])), '|') variable_symbols from equations",
    "equation_text": f"select row_id, concat_ws(chr(10), {S.filled('context_text')}, {S.filled('equation')}, {S.filled('domain')}) as text, 'Equation: ' || coalesce(equation, '') || chr(10) || 'Context: ' || coalesce(context_text, '') as encoder_text from equations",
    "case_text": "select row_id, "
    + S.trim(
        f"coalesce({S.trim('context')}, '') || ' ' || case when len(input_variables) > 0 then 'INPUT ' || array_to_string({S.items('input_variables')}, ' ') else '' end || ' ' || case when len(output_variables) > 0 then 'OUTPUT ' || array_to_string({S.items('output_variables')}, ' ') else '' end"
    )
    + " as text from training_cases",
    "notation_replace": f"select row_id, {_replaced('equation')} equation from equations",
    "map_key_normalize": f"""with e as (select row_id, map_keys(variables) k, map_values(variables) v from equations where variables is not null),
each as (select row_id, unnest(range(1, len(k) + 1)) p, k, v from e),
named as (select row_id, p, {_replaced('k[p]')} symbol, {_replaced('v[p]')} definition from each)
select row_id, symbol, definition from named qualify row_number() over (partition by row_id, symbol order by p desc) = 1""",
    "domain_counts": "select coalesce(nullif(domain, ''), 'unknown') as domain, count(*) n from equations group by 1",
    "domain_merge_counts": f"select {_domain_case()} as domain, count(*) n from equations group by 1",
    "source_counts": "select source_id, count(*) n from equations group by 1 order by 2 desc, 1 nulls last limit 20",
    "var_frequency_topn": """with e as (select row_id, map_keys(variables) k from equations where variables is not null),
each as (select row_id, unnest(range(1, len(k) + 1)) p, k from e)
select symbol, n from (select k[p] symbol, count(*) n, min(row_id * 1000 + p) f from each group by 1) order by n desc, f limit 30""",
    "first_definition": f"""with e as (select row_id, map_keys(variables) k, map_values(variables) v from equations where variables is not null),
each as (select row_id, unnest(range(1, len(k) + 1)) p, k, v from e),
named as (select row_id, p, k[p] symbol, v[p] d from each)
select symbol, {S.trim('d')} definition from named where d is not null qualify row_number() over (partition by symbol order by row_id, p) = 1""",
    "vars_per_row_stats": """select (select min(cardinality(variables))::int from equations) least, (select max(cardinality(variables))::int from equations) most,
round((select avg(cardinality(variables)) from equations where variables is not null), 6) mean, (select count(distinct k) from (select unnest(map_keys(variables)) k from equations)) n_symbols""",
    "candidates_first_wins": f"select {S.global_key()} as key, min(row_id) row_id from equations group by 1 having key is not null",
    "last_wins_index": f"select {S.global_key()} as key, max(row_id) last_row_id, count(*) n_rows from equations group by 1 having key is not null",
    "merge_first_wins": f"""with old as (select * from equations where ingested_at < timestamp '{CUT}'), fresh as (select * from equations where not coalesce(ingested_at < timestamp '{CUT}', false))
select row_id from old union all
select row_id from (select * from fresh qualify row_number() over (partition by source_id, eq_id order by row_id) = 1) f
where not exists (select 1 from old o where o.source_id is not distinct from f.source_id and o.eq_id is not distinct from f.eq_id)""",
    "pending_files_anti": f"select distinct {S.filled('source_id')} file_name from equations where {S.filled('source_id')} is not null and {S.filled('source_id')} not in (select {S.filled('file_name')} from processed_ledger where {S.filled('file_name')} is not null)",
    "paper_dedup": _PAPERS + "select paper_id, query, pos, url, url is not null has_pdf from papers",
    "paper_summary": _PAPERS + "select count(*) total_count, count(url) with_pdf from papers",
    "cooccurrence_pairs": _PAIRS + "select * from pairs",
    "cooccurrence_top_network": _PAIRS
    + """, degrees as (select s, sum(weight) degree from (select a s, weight from pairs union all select b, weight from pairs) group by 1),
top as (select s from degrees order by degree desc, s limit 60)
select a, b, weight from pairs where a in (select s from top) and b in (select s from top)""",
    "json_events": "select event_type, sum((props->>'$.k')::bigint)::bigint sum_k, count(props->>'$.k') n_k from events group by 1",
}

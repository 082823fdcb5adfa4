"""Queries over training cases and their equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from equarry.operators import cases as C
from equarry.operators import profile, quality, reports
from equarry.plans import sqltext as S
from equarry.sources.tables import table


def _t(name):
    return lambda s, d: table(s, d, name)


_case, _eq, _core = _t("training_cases"), _t("equations"), _t("core_cases")


def _paraphrases(s, d):
    return C.paraphrase(_case(s, d)).select("row_id", "k", "case_id", "context")


def _examples(s, d):
    e = reports.health_examples(_case(s, d), _eq(s, d))
    return e.select("row_id", "case_id", "variant_type", F.array_join("missing_vars", "|").alias("missing_vars"), "n_missing_vars", F.array_join("correct_model_ids", "|").alias("correct_model_ids"))


def _expanded(s, d):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return C.expanded_cases(_core(s, d), _eq(s, d)).select("case_id", "original_core_id", "variant_type", "context", joined("input_variables"), joined("output_variables"), joined("correct_model_ids"))


QUERIES = {
    "key_prefix_mode": lambda s, d: C.modal_source(_case(s, d)),
    "set_ops_vars": lambda s, d: C.symbol_sets(_case(s, d)),
    "variant_counts": lambda s, d: profile.counts_of(_case(s, d), "variant_type"),
    "length_histograms": lambda s, d: profile.list_lengths(_case(s, d)),
    "length_stats": lambda s, d: profile.list_stats(_case(s, d)),
    "missing_refs_anti": lambda s, d: quality.missing_totals(_case(s, d), _eq(s, d)),
    "io_var_consistency": lambda s, d: quality.inconsistent_cases(_case(s, d), _eq(s, d)),
    "health_counts": lambda s, d: reports.health_counts(_case(s, d), _eq(s, d)),
    "health_examples": _examples,
    "numbered_cores": lambda s, d: C.numbered(_core(s, d)),
    "expanded_cases": _expanded,
    "json_key_presence": lambda s, d: quality.absent_fields(table(s, d, "events").select(F.col("props").alias("json")), ("k", "session", "v")),
    "required_field_presence": lambda s, d: quality.absent_fields(_case(s, d).select(F.to_json(F.struct(*quality.FIELDS)).alias("json"))),
    "duplicate_signatures_trimmed": lambda s, d: C.duplicate_groups(_case(s, d), True),
    "duplicate_signatures_stored": lambda s, d: C.duplicate_groups(_case(s, d), False),
    "case_expand_variants": lambda s, d: C.expand(_core(s, d), _eq(s, d)),
    "paraphrase_idempotent": _paraphrases,
}

_I, _O, _M = (S.items(c) for c in ("input_variables", "output_variables", "correct_model_ids"))
_joined = "array_to_string(list_sort(list_distinct({})), '|')".format
_SIG = {
    True: f"(coalesce({S.trim('context')}, ''), list_sort(list_distinct({_I})), list_sort(list_distinct({_O})), list_sort(list_distinct({_M})))",
    False: f"(coalesce({S.trim('context')}, ''), list_sort(list_transform(coalesce(input_variables, []), lambda e: coalesce({S.trim('e')}, ''))), list_sort(list_transform(coalesce(output_variables, []), lambda e: coalesce({S.trim('e')}, ''))), list_sort(list_transform(coalesce(correct_model_ids, []), lambda e: coalesce(e, ''))))",
}


def _groups(trimmed):
    return f"select count(*) n_groups, coalesce(sum(n), 0)::bigint n_rows from (select {_SIG[trimmed]} s, count(*) n from training_cases group by 1) where n >= 2"


def _expand_sql() -> str:
    texts = ["context", *[f"'{t}' || context" for t in C.TEMPLATES]]
    parts = [f"select row_id, 'v1' variant, 'original' variant_type, {texts[0]} context, array_to_string(i, '|') inputs, array_to_string(o, '|') outputs from base"]
    parts += [f"select row_id, 'p{k}', 'context_paraphrased', {texts[k]}, array_to_string(i, '|'), array_to_string(o, '|') from base" for k in (1, 2, 3)]
    parts.append(f"select row_id, 'v2', 'swap_io', {texts[1]}, array_to_string(o, '|'), array_to_string(i, '|') from base where len(i) > 0 and len(o) > 0")
    for v in (3, 4, 5, 6):
        h = f"md5('{C.SEED}|' || row_id || '|{v}|' || {{}})"
        parts.append(
            f"""select row_id, 'v{v}', 'random_io_from_models', {texts[min(v - 1, 3)]},
  coalesce(string_agg(s, '|' order by s) filter (r > k), ''), coalesce(string_agg(s, '|' order by s) filter (r <= k), '')
from (select row_id, context, s, 1 + ascii(substr({h.format("''")}, 1, 1)) % 2 k, row_number() over (partition by row_id order by {h.format("s")}, s) r from (select row_id, context, unnest(pool) s from base)) group by row_id, context"""
        )
    return """with ids as (select distinct row_id, unnest(correct_model_ids) model_id from core_cases),
symbols as (select distinct coalesce(source_id, '') || '__' || coalesce(eq_id, '') model_id, unnest(map_keys(variables)) s from equations),
of_models as (select row_id, list_sort(list(distinct s)) symbols from ids join symbols using (model_id) group by 1),
base as (select c.row_id, coalesce(context, '') context, coalesce(input_variables, []) i, coalesce(output_variables, []) o,
  coalesce(symbols, list_sort(list_distinct(list_filter(list_concat(coalesce(input_variables, []), coalesce(output_variables, [])), lambda e: e is not null)))) pool
  from core_cases c left join of_models using (row_id))
""" + "\nunion all ".join(parts)


_BAD = f"""rows_ as (select e.* from equations e join (select {S.global_key()} as key, max(row_id) row_id from equations group by 1 having key is not null) using (row_id)),
symbols as (select distinct {S.global_key()} as key, coalesce({S.trim('u')}, '') symbol from (select source_id, eq_id, unnest(map_keys(variables)) u from rows_)),
known as (select distinct row_id, symbol from (select row_id, unnest({_M}) as key from training_cases) join symbols using (key)),
lists as (select row_id, list_concat({_I}, {_O}) l from training_cases),
used as (select row_id, unnest(range(1, len(l) + 1)) at_, l from lists),
bad as (select row_id, at_, l[at_] symbol from used u where not exists (select 1 from known k where k.row_id = u.row_id and k.symbol = u.l[u.at_]))"""
_HEALTH = f"""(coalesce({S.trim('original_core_id')}, ''), coalesce({S.trim('variant_type')}, ''), coalesce({S.trim('context')}, ''), list_sort(list_distinct(list_transform(coalesce(input_variables, []), lambda e: coalesce({S.trim('e')}, '')))), list_sort(list_distinct(list_transform(coalesce(output_variables, []), lambda e: coalesce({S.trim('e')}, '')))), list_sort(list_distinct(list_transform(coalesce(correct_model_ids, []), lambda e: coalesce(e, '')))))"""

SQL = {
    "health_counts": f"""with {_BAD},
missing as (select row_id, k from (select row_id, unnest({_M}) k from training_cases) where k not in (select {S.global_key()} from equations where {S.filled('eq_id')} is not null)),
twice as (select count(*) n from training_cases group by {_HEALTH} having count(*) >= 2)
select 'n_equations' as name, count(*) as value from equations union all select 'n_cases', count(*) from training_cases
union all select 'missing_equation_ids_total', count(*) from missing union all select 'cases_with_missing_equation_ids', count(distinct row_id) from missing
union all select 'io_not_in_any_correct_model_vars_cases', count(distinct row_id) from bad union all select 'io_not_in_any_correct_model_vars_total_vars', count(*) from bad
union all select 'duplicate_signature_groups', count(*) from twice union all select 'duplicate_signature_cases', coalesce(sum(n), 0)::bigint from twice""",
    "health_examples": f"""with {_BAD},
firsts as (select row_id, count(*) n_missing_vars, list(symbol order by at_)[1:{reports.EXAMPLE_SYMBOLS}] m from bad group by 1 order by 1 limit {reports.EXAMPLES})
select row_id, case_id, variant_type, array_to_string(m, '|') missing_vars, n_missing_vars, array_to_string({_M}[1:{reports.EXAMPLE_IDS}], '|') correct_model_ids from firsts join training_cases using (row_id)""",
    "numbered_cores": "select row_id, number, printf('core_%03d', number) base from (select row_id, row_number() over (order by row_id) number from core_cases)",
    "expanded_cases": f"""with variants as ({_expand_sql()})
select printf('core_%03d', number) || '_' || case when variant like 'p%' then 'v1_para' || substr(variant, 2) else variant end case_id, c.case_id original_core_id, variant_type, v.context,
  inputs input_variables, outputs output_variables, array_to_string(coalesce(correct_model_ids, []), '|') correct_model_ids
from variants v join core_cases c using (row_id) join (select row_id, row_number() over (order by row_id) number from core_cases) using (row_id)""",
    "json_key_presence": " union all ".join(f"select '{f}' field, count(*) filter (not coalesce(list_contains(json_keys(props), '{f}'), false)) n from events" for f in ("k", "session", "v")),
    "key_prefix_mode": f"""with each as (select row_id, generate_subscripts(x, 1) p, x from (select row_id, {_M} x from training_cases)),
ids as (select row_id, p, split_part(x[p], '__', 1) source from each where contains(x[p], '__')),
best as (select row_id, source from (select row_id, source, count(*) n, min(p) f from ids group by 1, 2) qualify row_number() over (partition by row_id order by n desc, f) = 1)
select row_id, coalesce(source, 'unknown') source from training_cases left join best using (row_id)""",
    "set_ops_vars": f"select row_id, {_joined(f'list_concat({_I}, {_O})')} either, {_joined(f'list_intersect({_I}, {_O})')} as both, {_joined(f'list_filter({_I}, lambda e: not list_contains({_O}, e))')} inputs_only from training_cases".replace(
        "lambda e: not list_contains", "lambda z: not list_contains"
    ).replace(", e))", ", z))"),
    "variant_counts": "select variant_type, count(*) n from training_cases group by 1",
    "length_histograms": " union all ".join(f"select '{c}' field, coalesce(len({c}), 0)::varchar length, count(*) n from training_cases group by 2" for c in ("correct_model_ids", "input_variables", "output_variables")),
    "length_stats": "select "
    + ", ".join(f"min(coalesce(len({c}), 0))::int least_{n}, max(coalesce(len({c}), 0))::int most_{n}, round(avg(coalesce(len({c}), 0)), 6) mean_{n}" for c, n in (("correct_model_ids", "models"), ("input_variables", "inputs"), ("output_variables", "outputs")))
    + " from training_cases",
    "missing_refs_anti": f"select count(*) n_missing, count(distinct row_id) n_cases from (select row_id, unnest({_M}) k from training_cases) where k not in (select {S.global_key()} from equations where {S.filled('eq_id')} is not null)",
    "io_var_consistency": f"""with rows_ as (select e.* from equations e join (select {S.global_key()} as key, max(row_id) row_id from equations group by 1 having key is not null) using (row_id)),
symbols as (select distinct {S.global_key()} as key, coalesce({S.trim('u')}, '') symbol from (select source_id, eq_id, unnest(map_keys(variables)) u from rows_)),
known as (select distinct row_id, symbol from (select row_id, unnest({_M}) as key from training_cases) join symbols using (key)),
used as (select row_id, unnest(list_concat({_I}, {_O})) symbol from training_cases)
select row_id, count(*) n_bad, array_to_string(list_sort(list(distinct symbol))[1:10], '|') examples from used anti join known using (row_id, symbol) group by 1""",
    "required_field_presence": " union all ".join(f"select '{f}' field, count(*) filter ({f} is null) n from training_cases" for f in quality.FIELDS),
    "duplicate_signatures_trimmed": _groups(True),
    "duplicate_signatures_stored": _groups(False),
    "case_expand_variants": _expand_sql(),
    "paraphrase_idempotent": f"""with templates(k, t) as (values {', '.join(f"({i + 1}, '{t}')" for i, t in enumerate(C.TEMPLATES))}),
each as (select row_id, k, t || coalesce({S.trim('context')}, '') context, {S.filled('case_id')} || '_para' || k base, input_variables, output_variables, correct_model_ids from training_cases, templates where variant_type = 'original' and {S.filled('case_id')} is not null),
firsts as (select *, {_SIG[True]} s from each qualify row_number() over (partition by s order by row_id, k) = 1),
fresh as (select *, row_number() over (partition by base order by row_id, k) r from firsts where s not in (select {_SIG[True]} from training_cases)),
numbers as (select base, u, case when u = 1 then base else base || '_' || u end name from (select distinct base from fresh), (select unnest(range(1, 200)) u)),
free as (select base, name, row_number() over (partition by base order by u) r from numbers where name not in (select case_id from training_cases where case_id is not null))
select row_id, k, name case_id, context from fresh join free using (base, r)""",
}

"""Queries over references to absent records."""

from __future__ import annotations

from pyspark.sql import functions as F

from equarry.operators.orphans import OrphanTracker, keyed, open_orphans, orphan_at_creation, orphan_counts, references
from equarry.plans.sqltext import global_key, items
from equarry.sources.tables import table


def _tracked(spark, folder):
    """The state after all events so far, as the first batch of a new tracker."""
    cases, cores = (references(table(spark, folder, t), t) for t in ("training_cases", "core_cases"))
    tracker = OrphanTracker(spark)
    tracker.advance(cases.unionByName(cores), keyed(table(spark, folder, "equations"), "ingested_at"), keyed(table(spark, folder, "retired_equations"), "retired_at"))
    return tracker.refs()


def p3_found(spark, folder):
    return _tracked(spark, folder).where(orphan_at_creation()).select("table_name", "row_id", "ref_key")


def p3_by_month(spark, folder):
    return orphan_counts(_tracked(spark, folder))


def p3_open_by_month(spark, folder):
    return open_orphans(_tracked(spark, folder))


def p3_batches(spark, folder):
    """The same state from the same events in three batches, cut without regard to their times: references before their parents,
    withdrawals before arrivals, and the reverse."""
    cases, cores = (references(table(spark, folder, t), t) for t in ("training_cases", "core_cases"))
    refs, arrivals, deletions = cases.unionByName(cores), keyed(table(spark, folder, "equations"), "ingested_at"), keyed(table(spark, folder, "retired_equations"), "retired_at")
    third = lambda df, c, k: df.where(F.pmod(F.xxhash64(c), F.lit(3)) == k)
    tracker = OrphanTracker(spark)
    for k in (0, 1, 2):
        tracker.advance(third(refs, "row_id", k), third(arrivals, "at", (k + 1) % 3), third(deletions, "ref_key", 2 - k), "query", k)
    return tracker.refs().where(orphan_at_creation()).select("table_name", "row_id", "ref_key")


QUERIES = {f.__name__: f for f in (p3_found, p3_by_month, p3_open_by_month, p3_batches)}

_REFS = f"""
with parents as (select {global_key()} k, min(ingested_at) arrived from equations group by 1),
withdrawn as (select {global_key()} k, min(retired_at) gone from retired_equations group by 1),
ids as (
  select distinct 'training_cases' table_name, row_id, created_at, unnest({items("correct_model_ids")}) k from training_cases
  union all select distinct 'core_cases', row_id, created_at, unnest({items("correct_model_ids")}) from core_cases),
refs as (
  select table_name, row_id, k, created_at, arrived, gone,
    coalesce(gone <= created_at, false) as is_gone, coalesce(arrived <= created_at, false) as is_there
  from ids left join parents using (k) left join withdrawn using (k))
"""

SQL = {
    "p3_found": _REFS + "select table_name, row_id, k as ref_key from refs where is_gone or not is_there",
    "p3_batches": _REFS + "select table_name, row_id, k as ref_key from refs where is_gone or not is_there",
    "p3_by_month": _REFS
    + """select table_name, strftime(created_at, '%Y-%m') as month, count(*) n_refs,
  count(*) filter (is_gone or not is_there) n_orphans,
  count(*) filter (not is_gone and not is_there and coalesce(arrived > created_at, false) = false) n_absent,
  count(*) filter (not is_gone and arrived > created_at) n_not_yet, count(*) filter (is_gone) n_withdrawn
from refs group by 1, 2""",
    "p3_open_by_month": _REFS
    + """, moves as (
  select table_name, created_at at_, 1 o, 0 s, 0 w from refs where created_at is not null and (is_gone or not is_there)
  union all select table_name, arrived, 0, 1, 0 from refs where arrived > created_at and not coalesce(gone <= arrived, false)
  union all select table_name, gone, 0, 0, 1 from refs where gone > created_at and gone > arrived),
by_month as (select table_name, strftime(at_, '%Y-%m') as month, sum(o)::bigint opened, sum(s)::bigint resolved, sum(w)::bigint reopened from moves group by 1, 2)
select table_name, month, opened, resolved, reopened, sum(opened - resolved + reopened) over (partition by table_name order by month)::bigint open_at_end from by_month""",
}

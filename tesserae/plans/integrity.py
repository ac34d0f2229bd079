"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.integrity import Reference, orphan_report, orphans
from tesserae.sources.tables import table


def _cases(spark: SparkSession, root: str) -> DataFrame:
    sessions, checkpoints, changes = (table(spark, root, n) for n in ("sessions", "checkpoints", "file_changes"))
    deleted = F.coalesce(F.element_at("metadata", "deleted_at"), F.lit("")) != ""
    return orphans([
        Reference("checkpoints", checkpoints, "id", "session_id", "ingested_at", "created_at", sessions, "id", "ingested_at", deleted),
        Reference("file_changes", changes, "id", "checkpoint_id", "ingested_at", "modified_at", checkpoints, "id", "ingested_at", deleted),
    ])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Referring records whose target is absent, deleted or arrived only after them."""
    return _cases(spark, root).select("ref_table", "record_id").distinct()


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Their number per table, month and reason."""
    return orphan_report(_cases(spark, root))


_CASES = r"""
with child as (
  select 'checkpoints' ref_table, id record_id, session_id k, ingested_at a, created_at t from checkpoints where id is not null
  union all
  select 'file_changes', cast(id as varchar), checkpoint_id, ingested_at, modified_at from file_changes where id is not null),
parent as (
  select 'checkpoints' ref_table, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) k, min(ingested_at) pa, max(case when coalesce(metadata['deleted_at'], '') <> '' then 1 else 0 end) del
  from sessions group by 1, 2
  union all
  select 'file_changes', lower(regexp_replace(id, '^\s+|\s+$', '', 'g')), min(ingested_at), max(case when coalesce(metadata['deleted_at'], '') <> '' then 1 else 0 end)
  from checkpoints group by 1, 2),
first as (select ref_table, record_id, min(a) a, min(t) t from child group by 1, 2),
refs as (
  select distinct c.ref_table, c.record_id, lower(regexp_replace(c.k, '^\s+|\s+$', '', 'g')) k, f.a, f.t
  from child c join first f using (ref_table, record_id)),
cases as (
  select r.ref_table, r.record_id, r.t, case when p.k is null then 'missing' when p.del = 1 then 'deleted' when p.pa > r.a then 'late' end reason
  from refs r left join parent p on p.ref_table = r.ref_table and p.k = r.k where r.k <> '')
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _CASES + "select distinct ref_table, record_id from cases where reason is not null",
    "p1_report": _CASES + """
select ref_table, strftime(date_trunc('month', t), '%Y-%m-%d') period, reason, count(*) n_records
from (select ref_table, record_id, reason, min(t) t from cases where reason is not null group by 1, 2, 3) group by 1, 2, 3""",
}

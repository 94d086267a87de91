"""Queries of the reference check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import query
from tessera.operators import references as op
from tessera.runtime import table

FOUND = r"""
with units as (
  select trim(id) as id, min(loaded_at) as first, bool_or(deleted_at is not null) as gone from evidence_units where id is not null group by 1
), fields as (
  select trim(id) as id, min(created_at) as first from claim_fields where id is not null group by 1
), dels as (
  select distinct case when lower(regexp_replace(entity, '[^A-Za-z]', '', 'g')) in ('evidenceunit', 'evidenceunits') then 'evidence_ids'
    when lower(regexp_replace(entity, '[^A-Za-z]', '', 'g')) in ('claimfield', 'claimfields') then 'claim_field_id' end as ref_field, trim(entity_id) as id
  from audit_logs where upper(trim(action)) = 'DELETE'
), c as (
  select id, trim(claim_field_id) as field, evidence_ids, min(created_at) as created_at, min(loaded_at) as used
  from citations where id is not null group by 1, 2, 3
), refs as (
  select 'claim_field_id' as ref_field, id as citation_id, field as ref_id, strftime(created_at at time zone 'UTC', '%Y-%m') as period, used from c
  union all
  select 'evidence_ids', id, trim(u.x ->> '$'), strftime(created_at at time zone 'UTC', '%Y-%m'), used
  from c, unnest(case when json_valid(evidence_ids) and json_type(evidence_ids) = 'ARRAY' then cast(evidence_ids as json[]) else [] end) as u(x)
), r as (
  select ref_field, citation_id, ref_id, period, min(used) as used from refs where ref_id is not null and ref_id <> '' group by 1, 2, 3, 4
), k as (
  select r.ref_field, r.citation_id, r.ref_id, r.period,
    case when coalesce(u.gone, false) then 'deleted'
         when u.id is null and f.id is null then case when d.id is not null then 'deleted' else 'missing' end
         when coalesce(u.first, f.first) > r.used then 'late' end as kind
  from r left join units u on r.ref_field = 'evidence_ids' and u.id = r.ref_id
  left join fields f on r.ref_field = 'claim_field_id' and f.id = r.ref_id
  left join dels d on d.ref_field = r.ref_field and d.id = r.ref_id
)
select ref_field, citation_id, ref_id, kind, period from k where kind is not null
"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return op.orphans(op.citation_references(t("citations")), op.parents(t("evidence_units"), t("claim_fields"), t("audit_logs")))


@query(FOUND)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


@query(f"select ref_field, period, kind, count(*) as n_refs, count(distinct citation_id) as n_citations from ({FOUND}) group by 1, 2, 3")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return op.report(_found(spark, d))

"""Current rows of the project tables, and the tree persona -> claim -> field -> citation.

A project stands for a persona; its claims are the distinct field names of its
claim fields. Repeated deliveries count once (the latest); deleted units stay,
with their deleted_at. The SQL twins give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import latest, spread, table

STATUSES = ["DRAFT", "PENDING_REVIEW", "APPROVED", "REJECTED"]


def current(df: DataFrame, stamp: str, key: str = "id") -> DataFrame:
    """The latest delivery of each key; only keys are shuffled, not the rows."""
    return spread(latest(df, key, stamp), df)


def units(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "evidence_units"), "loaded_at")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "sources"), "updated_at").withColumn("tier", F.upper(F.trim("tier")))


def fields(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "claim_fields"), "updated_at").withColumn("claim", F.lower(F.trim("field_name")))


def citations(spark: SparkSession, d: str) -> DataFrame:
    c = current(table(spark, d, "citations"), "loaded_at")
    return c.withColumn("claim_field_id", F.trim("claim_field_id")).withColumn("ids", id_list("evidence_ids"))


def id_list(c: str):
    """The ids of a JSON array: trimmed, without nulls and blanks; broken arrays are empty."""
    parsed = F.transform(F.from_json(c, "array<string>"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def personas(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "projects")
    return p.select("id", "title", "created_at", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.length("title") % 4 + 1).alias("status"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_logs").dropDuplicates()


def _sql_current(name: str, stamp: str) -> str:
    return f"(select * exclude (rn) from (select *, row_number() over (partition by id order by {stamp} desc) as rn from {name} where id is not null) where rn = 1)"


_LIST = "list_filter(list_transform(case when json_valid(evidence_ids) and json_type(evidence_ids) = 'ARRAY' then cast(evidence_ids as json[]) else [] end, lambda x: trim(x ->> '$')), lambda x: x is not null and x <> '')"
SQL_VIEWS = {
    "u": f"u as (select * from {_sql_current('evidence_units', 'loaded_at')})",
    "s": f"s as (select * replace (upper(trim(tier)) as tier) from {_sql_current('sources', 'updated_at')})",
    "f": f"f as (select *, lower(trim(field_name)) as claim from {_sql_current('claim_fields', 'updated_at')})",
    "c": f"c as (select * replace (trim(claim_field_id) as claim_field_id), {_LIST} as ids from {_sql_current('citations', 'loaded_at')})",
    "p": "p as (select id, title, created_at, (['DRAFT', 'PENDING_REVIEW', 'APPROVED', 'REJECTED'])[length(title) % 4 + 1] as status from projects)",
    "a": "a as (select distinct * from audit_logs)",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front; further CTEs of body may follow after a comma."""
    body = body.strip()
    return "with " + ",\n".join(SQL_VIEWS[n] for n in names) + (",\n" + body[5:] if body.startswith("with ") else "\n" + body)

"""Queries of the repository operators (SRC, FIL, JOI, AGG1-10, SRT, SET, WIN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import query
from tessera.functions import text as fx
from tessera.operators import relational as op
from tessera.plans import views as v
from tessera.plans.views import with_views as w
from tessera.runtime import materialise, table
from tessera.sources import uploads

C = F.col


# Scans, sources, sinks


@query(w("u", "select id, source_id, char_start, char_end, quality_score from u"))
def src1_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("id", "source_id", "char_start", "char_end", "quality_score")


@query(w("us", "select u.id, u.snippet, s.title, s.tier from u left join s on s.id = u.source_id where u.id = (select max(id) from evidence_units)"))
def src2_by_id(spark: SparkSession, d: str) -> DataFrame:
    u = v.units(spark, d)
    wanted = table(spark, d, "evidence_units").agg(F.max("id").alias("id"))
    s = v.sources(spark, d).select(C("id").alias("source_id"), "title", "tier")
    return u.join(F.broadcast(wanted), "id", "left_semi").join(s, "source_id", "left").select("id", "snippet", "title", "tier")


@query(w("uc", "select id, quality_score from u where id in (select unnest(ids) from c) order by quality_score desc nulls last, id"))
def src3_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = v.citations(spark, d).select(F.explode("ids").alias("id")).distinct()
    return v.units(spark, d).join(ids, "id", "left_semi").select("id", "quality_score").orderBy(C("quality_score").desc_nulls_last(), "id")


@query(w("s", f"""select id, regexp_extract(url, '[^/?#]*$') as name, octet_length(encode(coalesce(text_raw, ''))) as bytes,
  octet_length(encode(coalesce(text_raw, ''))) <= 10485760 as size_ok, not contains(url, '..') as path_ok,
  not regexp_matches(substring(coalesce(text_raw, ''), 1, 1024), '{uploads.SUSPICIOUS}') as content_ok from s"""))
def src4_upload_checks(spark: SparkSession, d: str) -> DataFrame:
    files = v.sources(spark, d).select("id", F.regexp_extract("url", "[^/?#]*$", 0).alias("name"), C("url").alias("path"), F.encode(F.coalesce("text_raw", F.lit("")), "UTF-8").alias("content"))
    return uploads.checked(files).select("id", "name", "bytes", "size_ok", "path_ok", "content_ok")


@query(w("s", "select id, text_raw as text from s where text_raw is not null"))
def src5_decode(spark: SparkSession, d: str) -> DataFrame:
    raw = v.sources(spark, d).where("text_raw is not null").select("id", F.encode("text_raw", "UTF-8").alias("content"))
    return raw.select("id", uploads.decoded(C("content")).alias("text"))


@query(w("f", "select id, claim, text, coalesce(confidence, 0.0) as confidence from f"))
def src6_create(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as a new table and read back; a missing confidence becomes 0."""
    return materialise(v.fields(spark, d).select("id", "claim", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), "created")


@query(w("u", """select u.id, u.source_id, coalesce(q.quality_score, u.quality_score) as quality_score from u
  left join (select evidence_unit_id as id, max(word_count) / 100.0::double as quality_score from evidence_quality where word_count >= 40 group by 1) q using (id)"""))
def src7_update(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "evidence_quality").where("word_count >= 40").groupBy(C("evidence_unit_id").alias("id")).agg((F.max("word_count") / F.lit(100.0)).alias("quality_score"))
    return op.update(v.units(spark, d).select("id", "source_id", "quality_score"), "id", new, ["quality_score"])


GONE = "select id from projects where length(title) % 5 = 0"


@query(w("usfc", f"""with p1 as ({GONE}), s1 as (select id from s where project_id in (select id from p1)), f1 as (select id from f where project_id in (select id from p1))
  select 'projects' as tbl, count(*) as n from projects where id not in (select id from p1)
  union all select 'sources', count(*) from s where id not in (select id from s1)
  union all select 'evidence_units', count(*) from u where source_id is null or source_id not in (select id from s1)
  union all select 'claim_fields', count(*) from f where id not in (select id from f1)
  union all select 'citations', count(*) from c where claim_field_id is null or claim_field_id not in (select id from f1)"""))
def src8_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "projects": table(spark, d, "projects").select("id"), "sources": v.sources(spark, d).select("id", "project_id"),
        "evidence_units": v.units(spark, d).select("id", "source_id"), "claim_fields": v.fields(spark, d).select("id", "project_id"),
        "citations": v.citations(spark, d).select("id", "claim_field_id"),
    }
    links = [("sources", "project_id", "projects"), ("claim_fields", "project_id", "projects"), ("evidence_units", "source_id", "sources"), ("citations", "claim_field_id", "claim_fields")]
    left = op.delete_cascade(tables, links, "projects", table(spark, d, "projects").where(F.length("title") % 5 == 0))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(w("fc", "select f.id as field_id, c.sentence_index, unnest(c.ids) as evidence_id from f join c on c.claim_field_id = f.id"))
def src9_bulk_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields with their citations as one nested row each, exploded into the rows to append."""
    payload = op.nested(v.fields(spark, d).select("id"), "id", v.citations(spark, d), "claim_field_id", ["sentence_index", "ids"], ["sentence_index", "id"], "citations")
    return payload.select(C("id").alias("field_id"), F.inline("citations")).select("field_id", "sentence_index", F.explode("ids").alias("evidence_id"))


TOPIC_SQL = "case when json_valid(topics) and json_type(topics) = 'ARRAY' then list_transform(cast(topics as json[]), lambda x: x ->> '$') else [] end"


@query(w("u", f"select id, source_id, snippet, cast(to_json({TOPIC_SQL}) as varchar) as topics from u where snippet <> ''"))
def src10_persist_units(spark: SparkSession, d: str) -> DataFrame:
    rows = v.units(spark, d).where("snippet <> ''").select("id", "source_id", "snippet", F.to_json(op.topic_list()).alias("topics"))
    return materialise(rows, "saved")


@query(w("pf", """select p.id, cast(to_json({'id': p.id, 'status': p.status, 'fields': coalesce(list({'id': f.id, 'claim': f.claim} order by f.id) filter (where f.id is not null), [])}) as varchar) as body
  from p left join f on f.project_id = p.id group by p.id, p.status"""))
def src11_export(spark: SparkSession, d: str) -> DataFrame:
    tree = op.nested(v.personas(spark, d), "id", v.fields(spark, d), "project_id", ["id", "claim"], ["id"], "fields")
    return tree.select("id", F.to_json(F.struct("id", "status", "fields"), {"ignoreNullFields": "false"}).alias("body"))


@query(w("a", f"select id, actor, action, {fx.redact_sql('details')} as details from a"))
def src12_audit_append(spark: SparkSession, d: str) -> DataFrame:
    rows = v.audit(spark, d).select("id", "actor", "action", fx.redact(C("details")).alias("details"))
    return materialise(rows, "audit")


@query("""select 'projects' as tbl, count(*) as n from projects union all select 'sources', count(*) from sources union all select 'evidence_units', count(*) from evidence_units
  union all select 'claim_fields', count(*) from claim_fields union all select 'audit_logs', count(*) from audit_logs""")
def src14_row_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("projects", "sources", "evidence_units", "claim_fields", "audit_logs"):
        part = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(w("u", "select id, deleted_at is not null as deleted from u"))
def src17_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("id", C("deleted_at").isNotNull().alias("deleted"))


@query(w("uc", "select u.id, case when k.id is not null then 1.0 else u.quality_score end as quality_score from u left join (select distinct unnest(ids) as id from c) k using (id)"))
def src18_bulk_update(spark: SparkSession, d: str) -> DataFrame:
    """Every cited unit gets quality 1."""
    ids = v.citations(spark, d).select(F.explode("ids").alias("id")).distinct().withColumn("quality_score", F.lit(1.0))
    return op.update(v.units(spark, d).select("id", "quality_score"), "id", ids, ["quality_score"])


# Filters


@query(w("u", "select id, quality_score from u where quality_score >= 0.6"))
def fil1_optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where(op.evidence_filter(min_quality=0.6, search=" ")).select("id", "quality_score")


@query(w("u", "select id, quality_score from u where source_id = (select max(source_id) from evidence_units)"))
def fil2_by_source(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "evidence_units").agg(F.max("source_id").alias("source_id"))
    return v.units(spark, d).join(F.broadcast(one), "source_id", "left_semi").select("id", "quality_score")


@query(w("us", "select u.id, s.tier from u join s on s.id = u.source_id where s.tier = 'REPUTABLE' and s.project_id in (select id from projects where subject_type = 'real')"))
def fil3_by_project(spark: SparkSession, d: str) -> DataFrame:
    real = table(spark, d, "projects").where("subject_type = 'real'").select(C("id").alias("project_id"))
    s = v.sources(spark, d).where("tier = 'REPUTABLE'").join(real, "project_id", "left_semi").select(C("id").alias("source_id"), "tier")
    return v.units(spark, d).join(s, "source_id").select("id", "tier")


@query(w("u", "select id from u where contains(lower(snippet), 'budget') or contains(lower(snippet), '50%') or contains(lower(snippet), 'a_b')"))
def fil4_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where(op.keyword_search("Budget  50% a_b", ["snippet"])).select("id")


@query("select id, title from projects where contains(lower(title), 'map editor') or contains(lower(description), 'map editor')")
def fil5_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").where(op.phrase_search("Map editor", ["title", "description"])).select("id", "title")


@query(w("u", "select id from u where contains(topics, 'loom') or contains(topics, 'work')"))
def fil6_topic_text(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where(op.topic_text(["loom", "work"])).select("id")


@query(w("u", f"select id from u where list_has_any({TOPIC_SQL}, ['loom', 'work'])"))
def fil6_topic_exact(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where(op.has_topic(["loom", "work"])).select("id")


@query(w("s", "select id, tier from s where tier = 'COMMUNITY' and (contains(lower(title), 'review') or contains(lower(url), 'review'))"))
def fil7_sources(spark: SparkSession, d: str) -> DataFrame:
    return v.sources(spark, d).where((C("tier") == "COMMUNITY") & op.keyword_search("review", ["title", "url"])).select("id", "tier")


@query(w("p", "select id, status from p where status in ('APPROVED', 'DRAFT')"))
def fil8_personas(spark: SparkSession, d: str) -> DataFrame:
    return v.personas(spark, d).where(C("status").isin("APPROVED", "DRAFT")).select("id", "status")


@query(w("s", "select project_id, url, count(*) > 1 as taken from s group by 1, 2"))
def fil9_url_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether another source of the project has the url already."""
    return v.sources(spark, d).groupBy("project_id", "url").agg((F.count("*") > 1).alias("taken"))


@query(w("u", """with k as (select snippet from u where id = (select max(id) from u where snippet <> '')), words as (select distinct unnest(string_split_regex(lower(snippet), '[ \\t\\n]+')) as x from k)
  select id, quality_score from u where id <> (select max(id) from u where snippet <> '') and exists (select 1 from words where length(x) > 3 and contains(lower(u.snippet), x)) order by quality_score desc nulls last, id limit 5"""))
def fil10_similar_snippets(spark: SparkSession, d: str) -> DataFrame:
    u = v.units(spark, d).where("snippet is not null")
    key = F.broadcast(u.where("snippet <> ''").agg(F.max_by("snippet", "id").alias("k"), F.max("id").alias("me")))
    words = F.filter(F.split(F.lower("k"), r"[ \t\n]+"), lambda x: F.length(x) > 3)
    hits = u.crossJoin(key).where((C("id") != C("me")) & F.exists(words, lambda x: F.contains(F.lower("snippet"), x)))  # one row of search words
    return hits.select("id", "quality_score").orderBy(C("quality_score").desc_nulls_last(), "id").limit(5)


@query(w("a", "select id, action, created_at from a where entity_id is not null and lower(replace(entity, '_', '')) = 'evidenceunit' and created_at >= timestamptz '2022-01-01 00:00:00+00' and created_at <= timestamptz '2023-12-31 00:00:00+00' and action = 'UPDATE' order by created_at desc, id limit 100"), times=("created_at",))
def fil11_audit_trail(spark: SparkSession, d: str) -> DataFrame:
    a = v.audit(spark, d).where((F.lower(F.replace("entity", F.lit("_"), F.lit(""))) == "evidenceunit") & C("entity_id").isNotNull())
    a = a.where("created_at >= timestamp '2022-01-01 00:00:00' and created_at <= timestamp '2023-12-31 00:00:00' and action = 'UPDATE'")
    return a.orderBy(C("created_at").desc(), "id").limit(100).select("id", "action", "created_at")


@query(w("a", "select id from a where created_at >= (select max(created_at) from a) - interval 365 day"))
def fil12_retention(spark: SparkSession, d: str) -> DataFrame:
    a = v.audit(spark, d)
    newest = F.broadcast(table(spark, d, "audit_logs").agg(F.max("created_at").alias("newest")))
    return a.crossJoin(newest).where("created_at >= newest - interval 365 days").select("id")  # one row


@query(w("u", "select id, case when length(snippet) > 200 then substring(snippet, 1, 200) || '...' else snippet end as excerpt from u where quality_score >= 0.5"))
def fil13_prompt_evidence(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where("quality_score >= 0.5").select("id", fx.truncated(C("snippet"), 200).alias("excerpt"))


CONF = "try_cast(case when json_valid(metadata) then metadata ->> '$.confidenceScore' end as double)"


@query(w("u", f"select id, coalesce({CONF} >= 0.3 and quality_score >= 0.4, false) as accepted from u"))
def fil14_accept(spark: SparkSession, d: str) -> DataFrame:
    conf = F.get_json_object("metadata", "$.confidenceScore").try_cast("double")
    return v.units(spark, d).select("id", F.coalesce((conf >= 0.3) & (C("quality_score") >= 0.4), F.lit(False)).alias("accepted"))


@query(f"select id, {fx.violations_sql()} as violations from projects", lists=("violations",))
def fil15_validation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("id", fx.violations().alias("violations"))


@query("select event_id, event_type in ('click', 'view', 'purchase') as type_ok, length(props) <= 1048576 as size_ok, length(cast(user_id as varchar)) >= 3 as key_ok from events")
def fil17_request_guards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", C("event_type").isin("click", "view", "purchase").alias("type_ok"), (F.length("props") <= 1_048_576).alias("size_ok"), (F.length(C("user_id").cast("string")) >= 3).alias("key_ok"))


@query(w("us", f"""select u.id from u join s on s.id = u.source_id where u.quality_score >= 0.3 and u.quality_score <= 0.9 and s.tier in ('CANONICAL', 'REPUTABLE')
  and u.created_at >= timestamptz '2021-06-01 00:00:00+00' and list_has_any({TOPIC_SQL}, ['loom', 'index', 'rota'])"""))
def fil18_search_query(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    s = v.sources(spark, d).where(C("tier").isin("CANONICAL", "REPUTABLE")).select(C("id").alias("source_id"))
    keep = op.evidence_filter(min_quality=0.3, max_quality=0.9, topics=["loom", "index", "rota"], exact_topics=True, after=dt.datetime(2021, 6, 1, tzinfo=dt.timezone.utc))
    return v.units(spark, d).where(keep).join(s, "source_id", "left_semi").select("id")


@query("select id, (row_number() over (order by id) - 1) // 100 as chunk from (select distinct id from evidence_units where id is not null)")
def src15_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 100 units in the order of their ids.

    Ids are numbered within ranges, in tasks of their own, and the ranges' sizes summed up.
    """
    ids = table(spark, d, "evidence_units").where("id is not null").select("id").distinct()
    cut = F.substring("id", 1, 2)
    before = ids.groupBy(cut.alias("r")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("r")) - C("n"))  # a row per range
    n = F.row_number().over(Window.partitionBy("r").orderBy("id"))
    return ids.withColumn("r", cut).withColumn("k", n).join(before, "r").select("id", F.floor((C("before") + C("k") - 1) / 100).alias("chunk"))


# Joins


@query(w("u", "select id, min(id) over (partition by source_id, snippet) as original_id from u where snippet <> '' and source_id is not null"))
def joi13_originals(spark: SparkSession, d: str) -> DataFrame:
    """Each unit with the first unit of its source that has the same text."""
    u = v.units(spark, d).where("snippet <> '' and source_id is not null").select("id", "source_id", F.xxhash64("snippet").alias("h"), F.md5("snippet").alias("m"))
    return u.select("id", F.min("id").over(Window.partitionBy("source_id", "h", "m")).alias("original_id"))


@query(w("us", "select u.id, s.title, s.url, s.tier from u left join s on s.id = u.source_id"))
def joi1_enrich(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d).select(C("id").alias("source_id"), "title", "url", "tier")
    return v.units(spark, d).join(s, "source_id", "left").select("id", "title", "url", "tier")


@query(w("pfc", """with fc as (select f.project_id, f.claim, f.id, coalesce(list(c.sentence_index order by c.sentence_index, c.id) filter (where c.id is not null), []) as cited from f left join c on c.claim_field_id = f.id group by 1, 2, 3)
  select p.id, coalesce(list({'id': fc.id, 'claim': fc.claim, 'cited': fc.cited} order by fc.id) filter (where fc.id is not null), []) as fields from p left join fc on fc.project_id = p.id group by 1"""), lists=("fields",))
def joi2_nested(spark: SparkSession, d: str) -> DataFrame:
    f = op.nested(v.fields(spark, d).select("id", "project_id", "claim"), "id", v.citations(spark, d), "claim_field_id", ["sentence_index", "id"], ["sentence_index", "id"], "cs")
    f = f.select("id", "project_id", "claim", F.transform("cs", lambda x: x["sentence_index"]).alias("cited"))
    return op.nested(v.personas(spark, d).select("id"), "id", f, "project_id", ["id", "claim", "cited"], ["id"], "fields")


@query(w("u", "select source_id, id, quality_score from u qualify row_number() over (partition by source_id order by quality_score desc nulls last, id) <= 5"))
def joi3_top_children(spark: SparkSession, d: str) -> DataFrame:
    return op.top_per_parent(v.units(spark, d), "source_id", 5, [C("quality_score").desc_nulls_last(), C("id")]).select("source_id", "id", "quality_score")


@query(w("us", "select s.id, count(u.id) as n_units from s left join u on u.source_id = s.id group by 1"))
def joi4_child_count(spark: SparkSession, d: str) -> DataFrame:
    return op.child_counts(v.sources(spark, d).select("id"), "id", v.units(spark, d), "source_id", "n_units")


@query(w("cfp", "select c.id from c where claim_field_id in (select f.id from f where project_id in (select id from p where status = 'APPROVED'))"))
def joi5_semi(spark: SparkSession, d: str) -> DataFrame:
    p = v.personas(spark, d).where("status = 'APPROVED'").select(C("id").alias("project_id"))
    f = v.fields(spark, d).join(p, "project_id", "left_semi").select(C("id").alias("claim_field_id"))
    return v.citations(spark, d).join(f, "claim_field_id", "left_semi").select("id")


@query(w("uc", "select c.id, x.e as evidence_id from c, unnest(c.ids) as x(e) where not exists (select 1 from u where u.id = x.e)"))
def joi6_anti(spark: SparkSession, d: str) -> DataFrame:
    ids = v.citations(spark, d).select("id", F.explode("ids").alias("evidence_id"))
    return ids.join(v.units(spark, d).select(C("id").alias("evidence_id")), "evidence_id", "left_anti").select("id", "evidence_id")


@query(w("uc", "select c.id, max(u.quality_score) as best, count(distinct u.id) as n from c, unnest(c.ids) as x(e) join u on u.id = x.e group by 1"))
def joi7_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = v.citations(spark, d).select("id", F.explode("ids").alias("evidence_id"))
    u = v.units(spark, d).select(C("id").alias("evidence_id"), "quality_score")
    return ids.join(u, "evidence_id").groupBy("id").agg(F.max("quality_score").alias("best"), F.count_distinct("evidence_id").alias("n"))


@query(w("fc", "select f.id, coalesce(list({'sentence_index': c.sentence_index, 'id': c.id} order by c.sentence_index, c.id) filter (where c.id is not null), []) as citations from f left join c on c.claim_field_id = f.id group by 1"), lists=("citations",))
def joi14_fields_with_citations(spark: SparkSession, d: str) -> DataFrame:
    return op.nested(v.fields(spark, d).select("id"), "id", v.citations(spark, d), "claim_field_id", ["sentence_index", "id"], ["sentence_index", "id"], "citations")


@query(w("usfc", """select 'units' as relation, count(*) as orphans from u where source_id is not null and source_id not in (select id from s)
  union all select 'sources', count(*) from s where project_id is not null and project_id not in (select id from projects)
  union all select 'fields', count(*) from f where project_id is not null and project_id not in (select id from projects)
  union all select 'citations', count(*) from c where claim_field_id is not null and claim_field_id not in (select id from f)"""))
def joi15_integrity(spark: SparkSession, d: str) -> DataFrame:
    p, s, u, f, c = table(spark, d, "projects"), v.sources(spark, d), v.units(spark, d), v.fields(spark, d), v.citations(spark, d)
    return op.orphan_counts([("units", u, "source_id", s), ("sources", s, "project_id", p), ("fields", f, "project_id", p), ("citations", c, "claim_field_id", f)])


# Statistics


@query(w("s", "select tier, count(*) as n from s group by 1"))
def agg1_tiers(spark: SparkSession, d: str) -> DataFrame:
    return v.sources(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query(w("p", "select status, count(*) as n from p group by 1"))
def agg2_status(spark: SparkSession, d: str) -> DataFrame:
    return v.personas(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(w("usf", """with su as (select s.project_id, count(distinct s.id) as n_sources, count(u.id) as n_units, count(distinct s.id) filter (where s.tier = 'CANONICAL') as canonical, count(distinct s.id) filter (where s.tier = 'REPUTABLE') as reputable
   from s left join u on u.source_id = s.id group by 1), ff as (select project_id, count(distinct claim) as n_claims, count(*) as n_fields from f group by 1)
  select p.id, coalesce(n_sources, 0) as n_sources, coalesce(n_units, 0) as n_units, coalesce(canonical, 0) as canonical, coalesce(reputable, 0) as reputable, coalesce(n_claims, 0) as n_claims, coalesce(n_fields, 0) as n_fields
  from projects p left join su on su.project_id = p.id left join ff on ff.project_id = p.id"""))
def agg3_project_stats(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d)
    n_units = v.units(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    per = s.join(n_units, s["id"] == n_units["source_id"], "left").groupBy("project_id").agg(
        F.count("*").alias("n_sources"), F.sum(F.coalesce("n", F.lit(0))).alias("n_units"), F.count_if(C("tier") == "CANONICAL").alias("canonical"), F.count_if(C("tier") == "REPUTABLE").alias("reputable")
    )
    f = v.fields(spark, d).groupBy("project_id").agg(F.count_distinct("claim").alias("n_claims"), F.count("*").alias("n_fields"))
    p = table(spark, d, "projects").select(C("id").alias("project_id"))
    out = p.join(per, "project_id", "left").join(f, "project_id", "left")
    return out.select(C("project_id").alias("id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_units", "canonical", "reputable", "n_claims", "n_fields")])


@query(w("u", "select source_id, count(*) as n, round(avg(quality_score), 10) as avg_quality, count(*) filter (where quality_score >= 0.8) as high, count(*) filter (where quality_score >= 0.4 and quality_score < 0.8) as medium, count(*) filter (where quality_score < 0.4) as low from u group by 1"))
def agg4_source_stats(spark: SparkSession, d: str) -> DataFrame:
    b = op.buckets(C("quality_score"), 0.8, 0.4)
    return v.units(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 10).alias("avg_quality"), *[x.alias(k) for k, x in b.items()])


@query(w("u", f"select source_id, t.topic, count(*) as n from u, unnest({TOPIC_SQL}) as t(topic) group by 1, 2"))
def agg4_topic_histogram(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("source_id", F.explode(op.topic_list()).alias("topic")).groupBy("source_id", "topic").agg(F.count("*").alias("n"))


@query(w("u", "select source_id, count(*) filter (where quality_score >= 0.8) as high, count(*) filter (where quality_score >= 0.4 and quality_score < 0.8) as medium, count(*) filter (where quality_score < 0.4) as low, count(*) filter (where quality_score is null) as unscored from u group by 1"))
def agg5_evidence_stats(spark: SparkSession, d: str) -> DataFrame:
    b = op.buckets(C("quality_score"), 0.8, 0.4, unscored=True)
    return v.units(spark, d).groupBy("source_id").agg(*[x.alias(k) for k, x in b.items()])


@query(w("us", f"select distinct s.project_id, t.topic from u join s on s.id = u.source_id, unnest({TOPIC_SQL.replace('topics', 'u.topics')}) as t(topic)"))
def agg6_project_topics(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d).select(C("id").alias("source_id"), "project_id")
    return v.units(spark, d).select("source_id", F.explode(op.topic_list()).alias("topic")).join(s, "source_id").select("project_id", "topic").distinct()


@query(w("fc", """with n as (select claim_field_id, count(*) as k from c group by 1)
  select project_id, count(distinct claim) as n_claims, count(*) as n_fields, coalesce(sum(k), 0)::bigint as n_citations, round(avg(confidence), 10) as avg_confidence,
  count(*) filter (where confidence >= 0.8) as high, count(*) filter (where confidence >= 0.4 and confidence < 0.8) as medium, count(*) filter (where confidence < 0.4) as low
  from f left join n on n.claim_field_id = f.id group by 1"""))
def agg7_persona_stats(spark: SparkSession, d: str) -> DataFrame:
    n = v.citations(spark, d).groupBy(C("claim_field_id").alias("id")).agg(F.count("*").alias("k"))
    b = op.buckets(C("confidence"), 0.8, 0.4)
    return v.fields(spark, d).join(n, "id", "left").groupBy("project_id").agg(
        F.count_distinct("claim").alias("n_claims"), F.count("*").alias("n_fields"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_citations"),
        F.round(F.avg("confidence"), 10).alias("avg_confidence"), *[x.alias(k) for k, x in b.items()],
    )


@query(w("fc", "select distinct f.project_id, x.e as evidence_id from f join c on c.claim_field_id = f.id, unnest(c.ids) as x(e)"))
def agg8_referenced_evidence(spark: SparkSession, d: str) -> DataFrame:
    c = v.citations(spark, d).select(C("claim_field_id").alias("id"), F.explode("ids").alias("evidence_id"))
    return v.fields(spark, d).select("id", "project_id").join(c, "id").select("project_id", "evidence_id").distinct()


@query(w("a", """select action, lower(replace(entity, '_', '')) as entity, count(*) as n, count(*) filter (where case when json_valid(details) then details ->> '$.success' end = 'true') as successful from a group by 1, 2"""))
def agg9_audit_stats(spark: SparkSession, d: str) -> DataFrame:
    ok = F.get_json_object("details", "$.success") == "true"
    return v.audit(spark, d).groupBy("action", F.lower(F.replace("entity", F.lit("_"), F.lit(""))).alias("entity")).agg(F.count("*").alias("n"), F.count_if(ok).alias("successful"))


@query(w("u", f"""select source_id, round(avg(coalesce(quality_score, 0)), 10) as avg_quality, round(avg({CONF}), 10) as avg_confidence,
  count(*) filter (where coalesce(quality_score, 0) >= 0.7) as high, count(*) filter (where coalesce(quality_score, 0) >= 0.4 and coalesce(quality_score, 0) < 0.7) as medium, count(*) filter (where coalesce(quality_score, 0) < 0.4) as low from u group by 1"""))
def agg10_processing_stats(spark: SparkSession, d: str) -> DataFrame:
    conf = F.get_json_object("metadata", "$.confidenceScore").try_cast("double")
    b = op.buckets(C("quality_score"), 0.7, 0.4, null_as_zero=True)
    return v.units(spark, d).groupBy("source_id").agg(F.round(F.avg(F.coalesce("quality_score", F.lit(0.0))), 10).alias("avg_quality"), F.round(F.avg(conf), 10).alias("avg_confidence"), *[x.alias(k) for k, x in b.items()])


# Sort, page, sets, windows


@query(w("u", """select id, created_at, (select count(*) from u) as total, 2 as page, cast(ceil((select count(*) from u) / 20.0) as bigint) as total_pages, 2 < ceil((select count(*) from u) / 20.0) as has_next, true as has_prev
  from u order by created_at desc, id limit 20 offset 20"""), times=("created_at",))
def srt1_page(spark: SparkSession, d: str) -> DataFrame:
    return op.page(v.units(spark, d).select("id", "created_at"), 2, 20, [C("created_at").desc(), C("id")])


@query(w("u", "select id, quality_score from u order by quality_score desc nulls last, id"))
def srt2_quality_order(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("id", "quality_score").orderBy(C("quality_score").desc_nulls_last(), "id")


@query(w("sp", "select 'source' as kind, id, created_at from (select id, created_at from s order by created_at desc, id limit 10) union all select 'persona', id, created_at from (select id, created_at from p order by created_at desc, id limit 10)"), times=("created_at",))
def srt3_recent(spark: SparkSession, d: str) -> DataFrame:
    top = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "created_at").orderBy(C("created_at").desc(), "id").limit(10)
    return top(v.sources(spark, d), "source").unionByName(top(v.personas(spark, d), "persona"))


@query(w("u", "select source_id, id from u qualify row_number() over (partition by source_id order by char_start nulls last, id) <= 3"))
def srt4_first_units(spark: SparkSession, d: str) -> DataFrame:
    return op.top_per_parent(v.units(spark, d), "source_id", 3, [C("char_start").asc_nulls_last(), C("id")]).select("source_id", "id")


@query(w("u", """select id, (select count(*) from u) as total, 1 as page, 2 as next_page, cast(null as int) as prev_page from u order by created_at desc, id limit 20"""))
def srt7_envelope(spark: SparkSession, d: str) -> DataFrame:
    return op.envelope(op.page(v.units(spark, d).select("id", "created_at"), 1, 20, [C("created_at").desc(), C("id")])).select("id", "total", "page", "next_page", "prev_page")


@query(w("uc", "select id from u except select unnest(ids) from c"))
def set2_uncited(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("id").subtract(v.citations(spark, d).select(F.explode("ids").alias("id")))


@query(w("u", "select id, snippet as text from u where snippet <> '' union all select id, description from projects"))
def set3_append_corpus(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where("snippet <> ''").select("id", C("snippet").alias("text")).unionByName(table(spark, d, "projects").select("id", C("description").alias("text")))


@query(w("u", """select source_id, id, case when prev is not null then greatest(char_start - prev, 0) end as gap, case when prev is not null then greatest(prev - char_start, 0) end as overlap, coalesce(char_start >= prev, false) as touches
  from (select *, lag(char_end) over (partition by source_id order by char_start, id) as prev from u where char_start is not null and char_end is not null)"""))
def win1_gaps(spark: SparkSession, d: str) -> DataFrame:
    prev = F.lag("char_end").over(Window.partitionBy("source_id").orderBy("char_start", "id"))
    u = v.units(spark, d).where("char_start is not null and char_end is not null").withColumn("prev", prev)
    return u.select("source_id", "id", F.greatest(C("char_start") - C("prev"), F.when(C("prev").isNotNull(), 0)).alias("gap"), F.greatest(C("prev") - C("char_start"), F.when(C("prev").isNotNull(), 0)).alias("overlap"), F.coalesce(C("char_start") >= C("prev"), F.lit(False)).alias("touches"))


@query(w("s", "select project_id, id from s qualify row_number() over (partition by project_id order by created_at desc, id) <= 5"))
def win2_recent_per_parent(spark: SparkSession, d: str) -> DataFrame:
    return op.top_per_parent(v.sources(spark, d), "project_id", 5, [C("created_at").desc(), C("id")]).select("project_id", "id")

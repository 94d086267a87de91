"""Queries of the text functions (STR) and of the unitizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as fx
from tessera.operators import unitize as un
from tessera.plans import views as v
from tessera.plans.views import with_views as w
from tessera.runtime import spread, table

C = F.col


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return spread(t, t)


def scalar(name: str, column: str, spark_fn, sql_fn, where: str = "text is not null", lists: bool = False):
    """A query (doc_id, value) of a function of documents.text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return docs(spark, d).where(where).select("doc_id", spark_fn(C("text")).alias(column))

    run.__name__ = name
    query(f"select doc_id, {sql_fn('text')} as {column} from documents where {where}", lists=(column,) if lists else ())(run)


scalar("str1_normalize", "norm", fx.normalised, fx.normalised_sql)
scalar("str2_boundaries", "edges", lambda c: fx.boundaries(fx.normalised(c)), lambda c: fx.boundaries_sql(fx.normalised_sql(c)), lists=True)
scalar("str4_word_count", "n", fx.word_count, lambda c: f"len({fx.word_list_sql(c)})")
scalar("str5_sentence_pieces", "n", fx.sentence_pieces, fx.sentence_pieces_sql)
scalar("str11_simple_keywords", "words", fx.simple_keywords, fx.simple_keywords_sql, lists=True)
scalar("str12_simple_phrases", "phrases", fx.simple_phrases, fx.simple_phrases_sql, lists=True)
scalar("str15_citation_sentences", "parts", fx.citation_sentences, fx.citation_sentences_sql, lists=True)
scalar("str16_citation_tokens", "tokens", fx.citation_tokens, fx.citation_tokens_sql, lists=True)
scalar("str17_confidence_tokens", "tokens", lambda c: F.sort_array(fx.confidence_tokens(c)), lambda c: f"list_sort({fx.confidence_tokens_sql(c)})", lists=True)
scalar("str18_xss_clean", "clean", fx.xss_clean, fx.xss_clean_sql)
scalar("str21_redact", "redacted", fx.redact, fx.redact_sql)
scalar("str22_redact_log", "redacted", lambda c: fx.redact(c, fx.LOGGED), lambda c: fx.redact_sql(c, fx.LOGGED))
scalar("str25_token_estimate", "tokens", lambda c: F.ceil(F.length(c) / 4), lambda c: f"cast(ceil(length({c}) / 4.0) as bigint)")
scalar("fil13_excerpt", "excerpt", lambda c: fx.truncated(c, 100), lambda c: f"case when length({c}) > 100 then substring({c}, 1, 100) || '...' else {c} end")


@query("select doc_id, [0, length(t)] as edges from (select doc_id, " + fx.normalised_sql("text") + " as t from documents where text is not null)", lists=("edges",))
def str3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Normalised text has one paragraph: its edges are 0 and the length."""
    return docs(spark, d).where("text is not null").select("doc_id", F.array(F.lit(0), F.length(fx.normalised(C("text")))).alias("edges"))


NEAR = "list_filter({l}, lambda x: abs(x - ({t})) <= 100)"


def _near(edges: str, t: str) -> str:
    c = NEAR.format(l=edges, t=t)
    after = f"list_filter({c}, lambda x: x >= ({t}))"
    return f"(case when len({c}) = 0 then least(({t}) + 100, n) when len({after}) > 0 then list_min({after}) else list_max({c}) end)"


UNITS = f"""
with recursive base as (
  select doc_id, t, length(t) as n, {fx.boundaries_sql('t')} as edges from (select doc_id, {fx.normalised_sql('text')} as t from documents where text is not null) where t <> ''
), steps as (
  select doc_id, n, edges, 0 as unit, 0::bigint as s,
    case when n <= 400 or 300 >= n then n else (select case when abs(p - 300) <= abs(b - 300) then p else b end from (select {_near('edges', '300')} as b, {_near('[0, n]', '300')} as p)) end as e
  from base
  union all
  select doc_id, n, edges, unit + 1, place,
    case when place + 300 >= n then n else (select case when abs(p - place - 300) <= abs(b - place - 300) then p else b end from (select {_near('edges', 'place + 300')} as b, {_near('[0, n]', 'place + 300')} as p)) end
  from (select doc_id, n, edges, unit, case when x > s then x else e end as place from (select *, {_near('edges', 'greatest(s + 200, e - 50)')} as x from steps where e < n))
), units as (
  select steps.doc_id, unit, s as unit_start, e as unit_end, substring(t, (s + 1)::int, (e - s)::int) as unit_text, steps.n as doc_length,
    s = 0 or regexp_matches(substring(t, s::int, 2), '^[.!?] ') as complete_start, e >= steps.n or regexp_matches(substring(t, e::int, 2), '^[.!?] ') as complete_end
  from steps join base using (doc_id)
)
"""


@query(UNITS + "select doc_id, unit, unit_start, unit_end, unit_text from units")
def str9_unitize(spark: SparkSession, d: str) -> DataFrame:
    return un.unitize(docs(spark, d)).select("doc_id", "unit", "unit_start", "unit_end", "unit_text")


@query(UNITS + "select doc_id, unit, complete_start, complete_end from units")
def str6_edges(spark: SparkSession, d: str) -> DataFrame:
    return un.unitize(docs(spark, d)).select("doc_id", "unit", "complete_start", "complete_end")


@query(UNITS + f"select doc_id, unit, {_near('[0, 250, n]', 'unit_start')} as edge from (select *, doc_length as n from units)")
def str7_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of three edges after each unit's start."""
    u = un.unitize(docs(spark, d))
    edges = F.array(F.lit(0), F.lit(250), C("doc_length"))
    near = F.filter(edges, lambda x: F.abs(x - C("unit_start")) <= 100)
    after = F.filter(near, lambda x: x >= C("unit_start"))
    edge = F.when(F.size(near) == 0, F.least(C("unit_start") + 100, C("doc_length"))).when(F.size(after) > 0, F.array_min(after)).otherwise(F.array_max(near))
    return u.select("doc_id", "unit", edge.alias("edge"))


@query(UNITS + f"select doc_id, unit, len({fx.word_list_sql('unit_text')}) as words, {fx.sentence_pieces_sql('unit_text')} as sentences from units")
def str8_unit_features(spark: SparkSession, d: str) -> DataFrame:
    u = un.unitize(docs(spark, d))
    return u.select("doc_id", "unit", fx.word_count(C("unit_text")).alias("words"), fx.sentence_pieces(C("unit_text")).alias("sentences"))


@query(UNITS + f"""select doc_id, unit, round(least(1.0, 0.5 + case when complete_start and complete_end then 0.3 when complete_start or complete_end then 0.15 else 0 end
  + case when r between 0.8 and 1.2 then 0.2 when r between 0.6 and 1.5 then 0.1 else 0 end + 0.25
  + case when dens between 0.12 and 0.18 then 0.15 when dens between 0.08 and 0.22 then 0.07 else 0 end + case when pl > 0.1 and pl < 0.9 then 0.1 else 0.05 end), 6)::double as confidence
  from (select *, length(unit_text) / 300.0::double as r, len({fx.word_list_sql('unit_text')})::double / length(unit_text) as dens, unit_start::double / doc_length as pl from units)""")
def str10_unit_confidence(spark: SparkSession, d: str) -> DataFrame:
    return un.unit_confidence(un.unitize(docs(spark, d))).select("doc_id", "unit", F.round("confidence", 6).alias("confidence"))


@query(UNITS + """select doc_id, count(*) as n_units, round(avg(size), 6) as avg_size, min(size) as min_size, max(size) as max_size, round(sum(size)::double / max(doc_length), 6) as coverage,
  count(*) filter (where unit_start >= prev) as gaps, coalesce(sum(greatest(prev - unit_start, 0)), 0)::bigint as overlap, count(*) filter (where size > 400) as too_long, count(*) filter (where size < 200) as too_short,
  min(unit_start) > 0 as starts_late, max(unit_end) < max(doc_length) as ends_early
  from (select *, unit_end - unit_start as size, lag(unit_end) over (partition by doc_id order by unit_start) as prev from units) group by 1""")
def agg12_unitization_stats(spark: SparkSession, d: str) -> DataFrame:
    return un.findings(un.unitize(docs(spark, d)))


@query(UNITS + """select doc_id, count(*) filter (where size > 400) + count(*) filter (where unit_start >= prev) as errors, count(*) filter (where size < 200) as warnings
  from (select *, unit_end - unit_start as size, lag(unit_end) over (partition by doc_id order by unit_start) as prev from units) group by 1""")
def val7_unit_validation(spark: SparkSession, d: str) -> DataFrame:
    f = un.findings(un.unitize(docs(spark, d)))
    late = C("starts_late").cast("int") + C("ends_early").cast("int")
    return f.select("doc_id", (C("too_long") + C("gaps") + late).alias("errors"), C("too_short").alias("warnings"))


URLS, MAILS = r"(?i)https?://[^ \t\n\r]+", fx.REDACTIONS[0][1]
DATES = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"
NUMBERS = r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"


@query(f"select doc_id, regexp_extract_all(text, {fx.q(URLS)}) as urls, regexp_extract_all(text, {fx.q(MAILS)}) as emails, regexp_extract_all(text, {fx.q(DATES)}) as dates, regexp_extract_all(text, {fx.q(NUMBERS)})[1:10] as numbers from documents where text is not null", lists=("urls", "emails", "dates", "numbers"))
def str13_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = C("text")
    return docs(spark, d).where("text is not null").select("doc_id", fx.found(t, URLS).alias("urls"), fx.found(t, MAILS).alias("emails"), fx.found(t, DATES).alias("dates"), F.slice(fx.found(t, NUMBERS), 1, 10).alias("numbers"))


@query(w("s", f"select id, {fx.domain_sql('url')} as domain from s"))
def str14_domain(spark: SparkSession, d: str) -> DataFrame:
    return v.sources(spark, d).select("id", fx.domain(C("url")).alias("domain"))


WRAPPED = "'<b>' || coalesce(title, '') || '</b><script type=\"x\">a=1;</script><a onclick = \"x()\" href=\"javascript:y\">' || id"


@query(w("s", f"select id, {fx.html_clean_sql('h')} as clean from (select id, {WRAPPED} as h from s)"))
def str19_html_clean(spark: SparkSession, d: str) -> DataFrame:
    return v.sources(spark, d).select("id", F.expr(WRAPPED).alias("h")).select("id", fx.html_clean(C("h")).alias("clean"))


@query(w("s", "select id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) as ext, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) in ('txt', 'md', 'html', 'json') as allowed from s"))
def str20_extension(spark: SparkSession, d: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return v.sources(spark, d).select("id", ext.alias("ext"), ext.isin("txt", "md", "html", "json").alias("allowed"))


@query(w("us", """select s.id, string_agg('[' || u.id || '] "' || case when length(snippet) > 80 then substring(snippet, 1, 80) || '...' else snippet end || '"', chr(10) order by u.id) as prompt
  from s join u on u.source_id = s.id where snippet <> '' group by 1"""))
def str23_prompt(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), C("id"), F.lit('] "'), fx.truncated(C("snippet"), 80), F.lit('"'))
    got = v.units(spark, d).where("snippet <> ''").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))).alias("x"))
    return got.join(v.sources(spark, d).select(C("id").alias("source_id")), "source_id", "left_semi").select(C("source_id").alias("id"), F.array_join("x.l", "\n").alias("prompt"))


@query("select id, 'Describe ' || title || case when subject_type = 'real' then ' from evidence only.' else ' freely.' end || case when languages is null then '' else ' Languages: ' || languages || '.' end as prompt from projects")
def str24_prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    style = F.when(C("subject_type") == "real", " from evidence only.").otherwise(" freely.")
    langs = F.when(C("languages").isNull(), "").otherwise(F.concat(F.lit(" Languages: "), C("languages"), F.lit(".")))
    return table(spark, d, "projects").select("id", F.concat(F.lit("Describe "), "title", style, langs).alias("prompt"))


MARKS = r"\[(evidence_[A-Za-z0-9_-]+)\]"


@query(w("f", f"select id, pos, list_transform(regexp_extract_all(part, '{MARKS}'), lambda x: x[2:-2]) as ids from (select id, unnest({fx.citation_sentences_sql('text')}) as part, generate_subscripts({fx.citation_sentences_sql('text')}, 1) - 1 as pos from f where text is not null)"), lists=("ids",))
def str26_marks_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    parts = v.fields(spark, d).where("text is not null").select("id", F.posexplode(fx.citation_sentences(C("text"))).alias("pos", "part"))
    return parts.select("id", "pos", F.regexp_extract_all("part", F.lit(MARKS), F.lit(1)).alias("ids"))


@query(w("f", "select id, project_id is not null and claim <> '' and text is not null and trim(text) <> '' and coalesce(confidence between 0 and 1, true) as valid from f"))
def str27_output_shape(spark: SparkSession, d: str) -> DataFrame:
    ok = C("project_id").isNotNull() & (C("claim") != "") & C("text").isNotNull() & (F.trim("text") != "") & F.coalesce(C("confidence").between(0, 1), F.lit(True))
    return v.fields(spark, d).select("id", ok.alias("valid"))


@query(w("a", "select id, coalesce(try_cast(case when json_valid(details) then details ->> '$.ms' end as bigint), 1) as ms, coalesce(case when json_valid(details) then details ->> '$.support' end, 'direct') as support from a"))
def str28_reply(spark: SparkSession, d: str) -> DataFrame:
    """Values out of a JSON reply, with defaults where it has none or is broken."""
    r = F.from_json("details", "ms bigint, support string")
    return v.audit(spark, d).select("id", F.coalesce(r["ms"], F.lit(1)).alias("ms"), F.coalesce(r["support"], F.lit("direct")).alias("support"))


@query(w("f", f"""select id, list_sort(list_filter([case when n.claim is distinct from o.claim then 'claim' end, case when n.text is distinct from o.text then 'text' end, case when n.confidence is distinct from o.confidence then 'confidence' end], lambda x: x is not null)) as changed
  from f n join (select id, claim, nullif({fx.trimmed_sql('text')}, '') as text, coalesce(confidence, 0.0) as confidence from f) o using (id)"""), lists=("changed",))
def str29_diff(spark: SparkSession, d: str) -> DataFrame:
    """Keys that differ between two states of a row, by null-safe comparison."""
    new = v.fields(spark, d)
    old = v.fields(spark, d).select("id", C("claim").alias("o1"), F.nullif(fx.trimmed(C("text")), F.lit("")).alias("o2"), F.coalesce("confidence", F.lit(0.0)).alias("o3"))
    pairs = [("claim", "o1"), ("text", "o2"), ("confidence", "o3")]
    changed = F.array_compact(F.array(*[F.when(~C(a).eqNullSafe(C(b)), F.lit(a)) for a, b in pairs]))
    return new.join(old, "id").select("id", F.sort_array(changed).alias("changed"))


@query(f"select id, 'Attempt 2. Fix: ' || array_to_string(({fx.violations_sql()})[1:3], '; ') as prompt from projects")
def str30_retry_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("id", F.concat(F.lit("Attempt 2. Fix: "), F.array_join(F.slice(fx.violations(), 1, 3), "; ")).alias("prompt"))

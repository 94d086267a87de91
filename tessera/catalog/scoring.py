"""Queries of the scorers (SCO1-10, AGG17, AGG18, JOI9)."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.config import QualityConfig
from tessera.functions import patterns as P
from tessera.functions import scores as sc
from tessera.functions import text as fx
from tessera.operators import similarity as sm
from tessera.plans import views as v
from tessera.plans.views import with_views as w
from tessera.runtime import materialise, table

C = F.col
AS_OF = "2025-01-01 00:00:00"
TARGET = (list(P.TOPICS), list(P.FIELDS), ["budget", "loom"])


def measured(spark: SparkSession, d: str, units: DataFrame | None = None) -> DataFrame:
    """Units with text, word and sentence counts, edges and the content metrics."""
    q = table(spark, d, "evidence_quality").groupBy(C("evidence_unit_id").alias("id")).agg(F.max("has_complete_start").alias("ws"), F.max("has_complete_end").alias("we"))
    u = (units or v.units(spark, d)).where("snippet <> ''").select("id", "source_id", C("snippet").alias("text")).join(q, "id", "left")
    u = u.select("id", "source_id", "text", fx.word_count(C("text")).alias("n_words"), fx.sentence_pieces(C("text")).alias("n_sentences"), F.coalesce("ws", F.lit(False)).alias("whole_start"), F.coalesce("we", F.lit(False)).alias("whole_end"))
    return u.select("*", *[c.alias(k) for k, c in sc.content_metrics(C("text")).items()])


MEASURED = f"""with q as (select evidence_unit_id as id, bool_or(has_complete_start) as ws, bool_or(has_complete_end) as we from evidence_quality group by 1),
  m0 as (select u.id, source_id, snippet as text, len({fx.word_list_sql('snippet')}) as n_words, {fx.sentence_pieces_sql('snippet')} as n_sentences, coalesce(ws, false) as whole_start, coalesce(we, false) as whole_end
    from u left join q using (id) where snippet <> ''),
  m as (select *, coalesce(n_words::double / nullif(n_sentences, 0), 0.0) as per, {sc.content_metrics_sql('text')} from m0),
  parts as (select id, source_id, {', '.join(f'least(1.0, greatest(0.0, {x}))::double as {k}' for k, x in sc.CONTENT_SQL.items())} from m)
"""
CONTENT = "least(1.0, greatest(0.0, " + " + ".join(f"{k} * {x}" for k, x in P.CONTENT_WEIGHTS.items()) + "))"


@query(w("u", MEASURED + "select id, n_words, n_sentences, round(unique_ratio, 6) as unique_ratio, round(punct_ratio, 6) as punct_ratio, specific, vague, formal, structural, fillers, facts, transitions, past, present, contrasts from m"))
def sco2_content_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d)
    return m.select("id", "n_words", "n_sentences", F.round("unique_ratio", 6).alias("unique_ratio"), F.round("punct_ratio", 6).alias("punct_ratio"), "specific", "vague", "formal", "structural", "fillers", "facts", "transitions", "past", "present", "contrasts")


def content(spark: SparkSession, d: str) -> DataFrame:
    parts = sc.content_components()
    return measured(spark, d).select("id", "source_id", *[c.alias(k) for k, c in parts.items()]).withColumn("content", sc.content_score({k: C(k) for k in parts}))


@query(w("u", MEASURED + f"select id, round(specificity, 6) as specificity, round(completeness, 6) as completeness, round(readability, 6) as readability, round(density, 6) as density, round(coherence, 6) as coherence, round({CONTENT}, 6) as score from parts"))
def sco3_content(spark: SparkSession, d: str) -> DataFrame:
    c = content(spark, d)
    return c.select("id", *[F.round(k, 6).alias(k) for k in P.CONTENT_WEIGHTS], F.round("content", 6).alias("score"))


@query(w("u", f"select id, {sc.indicators_sql('snippet', P.SPECIFIC)} as n from u where snippet <> ''"))
def sco4_indicators(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where("snippet <> ''").select("id", sc.indicators(C("snippet"), P.SPECIFIC).alias("n"))


AUTH = f"select id, {sc.authority_sql()} as authority from (select id, tier, coalesce(domain, '') as domain, coalesce(title, '') as title, metadata from s)"


def authority(spark: SparkSession, d: str, sources: DataFrame | None = None, *keep: str) -> DataFrame:
    s = (sources or v.sources(spark, d)).select("id", "tier", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("title", F.lit("")).alias("title"), "metadata", *[C(c).alias("__" + c) for c in keep])
    return s.select("id", sc.authority().alias("authority"), *[C("__" + c).alias(c) for c in keep])


@query(w("s", f"select id, round(authority, 6) as authority from ({AUTH})"))
def sco1_authority(spark: SparkSession, d: str) -> DataFrame:
    return authority(spark, d).select("id", F.round("authority", 6).alias("authority"))


def age(at):
    """Days up to AS_OF, 0 for what is later or unknown."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(at)) / 86400))


def recency(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d).select(C("id").alias("source_id"), "title", "url", F.coalesce("published_at", "fetched_at").alias("at"))
    u = v.units(spark, d).where("snippet <> ''").join(s, "source_id").select("id", "title", C("snippet").alias("text"), "url", age(C("at")).alias("age"))
    e = sc.recency()
    u = u.withColumns(sc.recency_counts())
    return u.withColumn("kind", e["kind"]).withColumn("decay", e["decay"]).select("id", "kind", e["score"].alias("score"))


RECENCY_ROWS = f"select u.id, s.title, u.snippet as text, s.url, greatest(0, floor((epoch(timestamptz '{AS_OF}+00') - floor(epoch(coalesce(s.published_at, s.fetched_at)))) / 86400))::int as age from u join s on s.id = u.source_id where u.snippet <> ''"


@query(w("us", f"select id, kind, round(score, 6) as score from ({sc.recency_sql(RECENCY_ROWS)})"))
def sco5_recency(spark: SparkSession, d: str) -> DataFrame:
    return recency(spark, d).select("id", "kind", F.round("score", 6).alias("score"))


def same_author(a, b):
    """Equal names, or equal last names and first letters; null where an author is unknown."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    p, q = F.split(x, fx.WS + "+"), F.split(y, fx.WS + "+")
    alike = (F.element_at(p, -1) == F.element_at(q, -1)) & (F.left(p[0], F.lit(1)) == F.left(q[0], F.lit(1)))
    return (x == y) | (F.size(p) >= 2) & (F.size(q) >= 2) & alike


def scoped(spark: SparkSession, d: str, units: DataFrame, sources: DataFrame) -> DataFrame:
    """Units with text of a project, with what of their source tells whether they are independent."""
    author = F.nullif(F.trim(F.get_json_object("metadata", "$.author")), F.lit(""))
    s = sources.select(C("id").alias("source_id"), "project_id", "domain", "tier", "title", author.alias("author"), F.coalesce("published_at", "fetched_at").alias("at"))
    u = units.where("snippet <> '' and source_id is not null").join(s, "source_id").where("project_id is not null")
    told = F.concat_ws(" ", F.coalesce("title", F.lit("")), "snippet")
    wire = fx.matches(told, P.SYNDICATED[0]) | fx.matches(told, P.SYNDICATED[1]) | fx.matches(told, P.SYNDICATED[2])
    return u.select(C("project_id").alias("scope"), "id", "source_id", "domain", "tier", "author", "at", wire.alias("wire"), sm.shingles(sm.prepared(C("snippet"))).alias("sh"))


def corroboration(spark: SparkSession, d: str, units: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine, independent, x_*, y_*): units of other sources in the project that say the same."""
    u = materialise(scoped(spark, d, units or v.units(spark, d), sources or v.sources(spark, d)), "scoped")
    p = materialise(sm.cosine_pairs(u.select("scope", "id", "sh"), 0.7).select("a", "b", "cosine"), "pairs")
    both = p.unionByName(p.select(C("b").alias("a"), C("a").alias("b"), "cosine"))
    info = lambda k, x: u.select(C("id").alias(k), *[C(c).alias(f"{x}_{c}") for c in ("source_id", "domain", "tier", "author", "at", "wire")])
    j = both.join(info("a", "x"), "a").join(info("b", "y"), "b").where("x_source_id <> y_source_id")
    related = F.col("x_domain").eqNullSafe(F.col("y_domain"))
    for one, two in P.RELATED_DOMAINS:
        related = related | (C("x_domain").isin(one, two) & C("y_domain").isin(one, two))
    author = F.coalesce(same_author(C("x_author"), C("y_author")), F.lit(False))
    return j.withColumn("independent", ~related & ~author & ~C("x_wire") & ~C("y_wire") & (C("cosine") <= 0.95))


def related_sql(a: str, b: str) -> str:
    return f"({a} is not distinct from {b}" + "".join(f" or ({a} in ('{x}', '{y}') and {b} in ('{x}', '{y}'))" for x, y in P.RELATED_DOMAINS) + ")"


def same_author_sql(a: str, b: str) -> str:
    p, q = (f"string_split_regex(lower(trim({x})), '{fx.WS}+')" for x in (a, b))
    return f"coalesce(lower(trim({a})) = lower(trim({b})) or (len({p}) >= 2 and len({q}) >= 2 and {p}[-1] = {q}[-1] and left({p}[1], 1) = left({q}[1], 1)), false)"


_WIRE = lambda c: "(" + " or ".join(fx.matches_sql(c, p) for p in P.SYNDICATED) + ")"
PREP = "trim(regexp_replace(regexp_replace(lower(snippet), '[^A-Za-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
CORR = f"""with c0 as (select s.project_id as scope, u.id, u.source_id, s.domain, s.tier, coalesce(s.published_at, s.fetched_at) as at_, coalesce(s.title, '') || ' ' || snippet as told,
      nullif(trim(case when json_valid(s.metadata) then s.metadata ->> '$.author' end), '') as author, {PREP} as p from u join s on s.id = u.source_id where snippet <> '' and s.project_id is not null),
  c1 as (select *, case when len(string_split(p, ' ')) < 3 then [p] else list_distinct(list_transform(range(1, len(string_split(p, ' ')) - 1), lambda i: array_to_string(string_split(p, ' ')[i:i+2], ' '))) end as sh from c0),
  corr as (select a.id as a, b.id as b, len(list_intersect(a.sh, b.sh)) / sqrt(len(a.sh) * len(b.sh)) as cosine, b.domain as y_domain, b.tier as y_tier, b.at_ as y_at, b.author as y_author,
      not {related_sql('a.domain', 'b.domain')} and not {same_author_sql('a.author', 'b.author')} and not {_WIRE('a.told')} and not {_WIRE('b.told')} and len(list_intersect(a.sh, b.sh)) / sqrt(len(a.sh) * len(b.sh)) <= 0.95 as independent
    from c1 a join c1 b on a.scope = b.scope and a.id <> b.id and a.source_id <> b.source_id where len(list_intersect(a.sh, b.sh)) / sqrt(len(a.sh) * len(b.sh)) >= 0.7 - 1e-12)
"""


@query(w("us", CORR + "select a, b, round(cosine, 6) as cosine from corr"))
def joi9_corroborating(spark: SparkSession, d: str) -> DataFrame:
    return corroboration(spark, d).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(w("us", CORR + "select a, b, independent from corr"))
def sco7_independence(spark: SparkSession, d: str) -> DataFrame:
    return corroboration(spark, d).select("a", "b", "independent")


@query(w("us", CORR + "select a, round(avg(cosine), 6) as cosine from corr group by 1 order by cosine desc, a"))
def srt5_by_similarity(spark: SparkSession, d: str) -> DataFrame:
    return corroboration(spark, d).groupBy("a").agg(F.round(F.avg("cosine"), 6).alias("cosine")).orderBy(C("cosine").desc(), "a")


@query(w("us", CORR + "select a, count(*) as n, count(distinct y_domain) as domains, count(distinct y_tier) as tiers, cast(floor((epoch(max(y_at)) - epoch(min(y_at))) / 86400) as bigint) as days, count(*) filter (where independent) as independent from corr group by 1"))
def agg18_diversity(spark: SparkSession, d: str) -> DataFrame:
    return corroboration(spark, d).groupBy("a").agg(
        F.count("*").alias("n"), F.count_distinct("y_domain").alias("domains"), F.count_distinct("y_tier").alias("tiers"),
        F.floor((F.unix_micros(F.max("y_at")) - F.unix_micros(F.min("y_at"))) / 86_400_000_000).alias("days"), F.count_if("independent").alias("independent"),
    )


@query(w("us", CORR + "select a, round(case when count(*) <= 1 then 0 else var_pop(cosine) end, 9) as variance from corr group by 1"))
def agg17_variance(spark: SparkSession, d: str) -> DataFrame:
    return corroboration(spark, d).groupBy("a").agg(F.round(F.when(F.count("*") <= 1, 0.0).otherwise(F.var_pop("cosine")), 9).alias("variance"))


def corroboration_score(spark: SparkSession, d: str, units: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    g = corroboration(spark, d, units, sources).groupBy("a").agg(F.count_distinct("y_author").alias("authors"),
        F.count("*").alias("n"), F.count_distinct("y_domain").alias("domains"), F.count_distinct("y_tier").alias("tiers"), F.avg("cosine").alias("avg"),
        F.when(F.count("*") <= 1, 0.0).otherwise(F.var_pop("cosine")).alias("var"), F.count_if("independent").alias("ind"),
        ((F.unix_micros(F.max("y_at")) - F.unix_micros(F.min("y_at"))) / 86_400_000_000.0).alias("days"),
    )
    n = C("n")
    count = F.when(n == 1, 0.3).when(n == 2, 0.6).when(n <= 5, 0.8 + (n - 3) * 0.05).otherwise(1.0)
    diversity = C("domains") / n * 0.4 + C("tiers") / F.least(F.lit(4), n) * 0.25 + F.when(C("authors") > 0, C("authors") / n).otherwise(0.5) * 0.2 + F.least(F.lit(1.0), F.floor("days") / 30.0) * 0.15
    consistency = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 2 * C("var")) + F.greatest(F.lit(0.0), (C("avg") - 0.7) * 2))
    independence = F.least(F.lit(1.0), C("ind") / n + F.when(C("ind") > 0, 0.2).otherwise(0.0))
    return g.select(C("a").alias("id"), sc.clamp(count * 0.4 + diversity * 0.25 + consistency * 0.2 + independence * 0.15).alias("corroboration"))


CORR_SCORE = """select a as id, least(1.0, greatest(0.0, 0.4 * case when n = 1 then 0.3 when n = 2 then 0.6 when n <= 5 then 0.8 + (n - 3) * 0.05 else 1.0 end
  + 0.25 * (domains::double / n * 0.4 + tiers::double / least(4, n) * 0.25 + case when authors > 0 then authors::double / n else 0.5 end * 0.2 + least(1.0, floor(days) / 30.0) * 0.15)
  + 0.2 * least(1.0, greatest(0.0, 1 - 2 * vr) + greatest(0.0, (av - 0.7) * 2)) + 0.15 * least(1.0, ind::double / n + case when ind > 0 then 0.2 else 0 end)))::double as corroboration
  from (select a, count(*) as n, count(distinct y_domain) as domains, count(distinct y_tier) as tiers, count(distinct y_author) as authors, avg(cosine) as av, case when count(*) <= 1 then 0 else var_pop(cosine) end as vr, count(*) filter (where independent) as ind,
    (epoch(max(y_at)) - epoch(min(y_at))) / 86400 as days from corr group by 1)"""


@query(w("us", CORR + f"select id, round(corroboration, 6) as corroboration from ({CORR_SCORE})"))
def sco6_corroboration(spark: SparkSession, d: str) -> DataFrame:
    return corroboration_score(spark, d).select("id", F.round("corroboration", 6).alias("corroboration"))


@query(w("u", f"select id, round({sc.relevance_sql(*TARGET)}, 6) as relevance from (select id, snippet as text from u where snippet <> '')"))
def sco8_relevance(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where("snippet <> ''").select("id", C("snippet").alias("text")).select("id", F.round(sc.relevance(*TARGET), 6).alias("relevance"))


def quality(spark: SparkSession, d: str, corroborate: bool, relate: bool, weights: QualityConfig = QualityConfig()) -> DataFrame:
    """(id, quality): the weighted components; one that is left out or missing counts 0.

    Current units and sources are made once; content, recency and relevance are columns of one
    pass over the units, with their source joined by its id; only corroboration looks at pairs.
    """
    units, sources = v.units(spark, d), v.sources(spark, d)
    if corroborate:
        units = materialise(units.where("snippet <> ''").select("id", "source_id", "snippet"), "units")
        sources = materialise(sources.select("id", "project_id", "domain", "tier", "title", "url", "metadata", "published_at", "fetched_at"), "sources")
    s = authority(spark, d, sources, "title", "url", "published_at", "fetched_at").withColumnRenamed("id", "source_id")
    q = measured(spark, d, units).join(s, "source_id", "left").withColumn("age", age(F.coalesce("published_at", "fetched_at"))).withColumns(sc.recency_counts())
    parts, e = sc.content_components(), sc.recency()
    q = q.select("*", e["kind"].alias("kind")).select("*", e["decay"].alias("decay"))
    columns = [sc.content_score(parts).alias("content"), F.when(C("authority").isNotNull(), e["score"]).alias("recency")]
    if relate:
        columns.append(sc.relevance(*TARGET).alias("relevance"))
    q = q.select("id", "authority", *columns)
    if corroborate:
        q = q.join(corroboration_score(spark, d, units, sources), "id", "left")
    total = F.lit(0.0)
    for f in fields(QualityConfig):
        if f.name in q.columns:
            total = total + F.coalesce(C(f.name), F.lit(0.0)) * getattr(weights, f.name)
    return q.select("id", total.alias("quality"))


def _quality_sql(corroborate: bool, relate: bool) -> str:
    ctes = MEASURED + f""", au as ({AUTH}), re as ({sc.recency_sql(RECENCY_ROWS)})"""
    if corroborate:
        ctes += ", " + CORR.strip()[5:] + f", cs as ({CORR_SCORE})"
    parts = f"coalesce(au.authority, 0) * 0.3 + {CONTENT} * 0.25 + coalesce(re.score, 0) * 0.2" + (" + coalesce(cs.corroboration, 0) * 0.15" if corroborate else "") + (f" + {sc.relevance_sql(*TARGET)} * 0.1" if relate else "")
    joins = " left join cs on cs.id = parts.id" if corroborate else ""
    return w("us", ctes + f" select parts.id, round({parts}, 6) as quality from parts join m0 on m0.id = parts.id left join au on au.id = parts.source_id left join re on re.id = parts.id{joins}")


@query(_quality_sql(True, True))
def sco9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality(spark, d, True, True).select("id", F.round("quality", 6).alias("quality"))


@query(_quality_sql(False, False))
def sco10_quality_fast(spark: SparkSession, d: str) -> DataFrame:
    """The fast mode leaves out corroboration and relevance."""
    return quality(spark, d, False, False).select("id", F.round("quality", 6).alias("quality"))

"""Queries of claims, citations, grounding and calibration (SCO12-17, VAL, AGG15-25, JOI10, JOI11, SRT6, WIN7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import query
from tessera.functions import patterns as P
from tessera.functions import text as fx
from tessera.operators import claims as cl
from tessera.plans import views as v
from tessera.plans.views import with_views as w
from tessera.runtime import materialise, table

C = F.col
AS_OF = "2025-01-01 00:00:00"


def token_set(c):
    return F.array_distinct(fx.citation_tokens(c))


def project_units(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d).select(C("id").alias("source_id"), "project_id")
    return v.units(spark, d).where("snippet <> ''").join(s, "source_id").where("project_id is not null")


def field_sets(spark: SparkSession, d: str) -> DataFrame:
    f = v.fields(spark, d).where("text is not null and project_id is not null")
    return materialise(f.select(C("project_id").alias("scope"), "id", fx.confidence_tokens(C("text")).alias("set"), cl.negated(C("text")).alias("neg")), "fields")


def unit_sets(spark: SparkSession, d: str) -> DataFrame:
    u = project_units(spark, d)
    return materialise(u.select(C("project_id").alias("scope"), "id", fx.confidence_tokens(C("snippet")).alias("set"), cl.negated(C("snippet")).alias("neg"), F.coalesce("quality_score", F.lit(0.0)).alias("q"), "created_at"), "units")


SETS = f"""with fs as (select project_id as scope, id, {fx.confidence_tokens_sql('text')} as st, {fx.matches_sql('text', P.NEGATION)} as neg from f where text is not null and project_id is not null),
  us as (select s.project_id as scope, u.id, {fx.confidence_tokens_sql('snippet')} as st, {fx.matches_sql('snippet', P.NEGATION)} as neg, coalesce(quality_score, 0.0) as q, u.created_at from u join s on s.id = u.source_id where snippet <> '' and s.project_id is not null),
  cited as (select distinct c.claim_field_id as a, x.e as b from c, unnest(c.ids) as x(e)),
  ev0 as (select fs.scope, fs.id as a, us.id as b, coalesce(len(list_intersect(fs.st, us.st))::double / nullif(len(fs.st) + len(us.st) - len(list_intersect(fs.st, us.st)), 0), 0.0) as sim, fs.neg <> us.neg as xor_, us.q, us.created_at, cited.a is not null as is_cited
    from fs join us using (scope) left join cited on cited.a = fs.id and cited.b = us.id),
  ev as (select *, is_cited and sim > SUPPORT as supports, not is_cited and sim > CONFLICT and xor_ as conflicts from ev0 where is_cited or sim >= CONFLICT)
"""


def at(sql: str, support: float, conflict: float) -> str:
    return sql.replace("SUPPORT", str(support)).replace("CONFLICT", str(conflict))


def assessed(spark: SparkSession, d: str, support: float = 0.7, conflict: float = 0.8) -> DataFrame:
    """(a, b, sim, supports, conflicts, q, created_at): each claim field with what it cites and what is close to it.

    Pairs that are neither cited nor as similar as ``conflict`` are never built.
    """
    cited = v.citations(spark, d).select(C("claim_field_id").alias("a"), F.explode("ids").alias("b"))
    units = unit_sets(spark, d).withColumnRenamed("neg", "neg_b")
    pairs = cl.jaccard_pairs(field_sets(spark, d), units, conflict, cited)
    return pairs.select("a", "b", C("jaccard").alias("sim"), (C("named") & (C("jaccard") > support)).alias("supports"), (~C("named") & (C("jaccard") > conflict) & (C("neg") != C("neg_b"))).alias("conflicts"), "q", "created_at")


PAIRS = "select a, b, round(sim, 6) as sim, supports, conflicts from ev"


@query(at(w("usfc", SETS + PAIRS), 0.7, 0.8))
def joi10_assess(spark: SparkSession, d: str) -> DataFrame:
    return assessed(spark, d).select("a", "b", F.round("sim", 6).alias("sim"), "supports", "conflicts")


@query(at(w("usfc", SETS + PAIRS), 0.2, 0.3))
def joi10_assess_loose(spark: SparkSession, d: str) -> DataFrame:
    """The same with thresholds that pairs of these tables reach."""
    return assessed(spark, d, 0.2, 0.3).select("a", "b", F.round("sim", 6).alias("sim"), "supports", "conflicts")


def confidence(spark: SparkSession, d: str, support: float = 0.7, conflict: float = 0.8) -> DataFrame:
    decay = F.exp(-(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("created_at")) / F.lit(86_400_000_000.0) / 365)
    ok = C("supports") | C("conflicts")
    when = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    g = assessed(spark, d, support, conflict).groupBy(C("a").alias("id")).agg(
        F.count_if("supports").alias("s"), F.count_if("conflicts").alias("c"), when(C("q") * C("sim")).alias("q_sim"), when(C("sim")).alias("sim"), when(C("q") * decay).alias("q_rec"), when(C("q")).alias("q")
    )
    every = v.fields(spark, d).select("id").join(g, "id", "left").fillna(0)
    return cl.claim_confidence(every)


CONF = SETS + f""", g as (select f.id, count(*) filter (where supports) as s, count(*) filter (where conflicts) as c, coalesce(sum(q * sim) filter (where supports or conflicts), 0.0) as q_sim, coalesce(sum(sim) filter (where supports or conflicts), 0.0) as sim,
    coalesce(sum(q * exp(-(epoch_us(timestamptz '{AS_OF}+00') - epoch_us(ev.created_at)) / 86400000000.0 / 365)) filter (where supports or conflicts), 0.0) as q_rec, coalesce(sum(q) filter (where supports or conflicts), 0.0) as q from f left join ev on ev.a = f.id group by 1),
  k as (select id, s, c, case when s + c = 0 then 0 else greatest(0.0, s::double / (s + c) - 0.3 * c::double / (s + c)) end as agreement, case when s = 0 then 0 when s >= 10 then 1 else least(1.0, s / 2.0) end as n_score,
    greatest(0.0, (coalesce(q_sim / nullif(sim, 0), 0) - 0.5) / 0.5) as quality, coalesce(q_rec / nullif(q, 0), 0) as recency from g),
  k2 as (select *, least(1.0, greatest(0.0, agreement * 0.4 + n_score * 0.3 + quality * 0.2 + recency * 0.1))::double as score from k),
  conf as (select *, case when s + c = 0 then 0.5 else least(0.5, case when s + c < 2 then 0.3 * (1 - (s + c) / 2.0) else 0 end + 0.2 * c::double / (s + c) + 0.1 * (1 - 2 * abs(score - 0.5))) end as uncertainty from k2)
"""


SCORES = "select id, s, c, round(score, 6) as score, round(uncertainty, 6) as uncertainty, round(least(1.0, greatest(0.0, score - 1.96 * uncertainty)), 6) as low, round(least(1.0, greatest(0.0, score + 1.96 * uncertainty)), 6) as high from conf"


def _scores(c: DataFrame) -> DataFrame:
    return c.select("id", "s", "c", *[F.round(x, 6).alias(x) for x in ("score", "uncertainty", "low", "high")])


@query(at(w("usfc", CONF + SCORES), 0.7, 0.8))
def sco12_claim_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _scores(confidence(spark, d))


@query(at(w("usfc", CONF + SCORES), 0.2, 0.3))
def sco12_claim_confidence_loose(spark: SparkSession, d: str) -> DataFrame:
    return _scores(confidence(spark, d, 0.2, 0.3))


@query(at(w("usfc", CONF + "select id, round(agreement, 6) as agreement, round(quality, 6) as quality, round(recency, 6) as recency from conf"), 0.2, 0.3))
def agg16_weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    return confidence(spark, d, 0.2, 0.3).select("id", *[F.round(x, 6).alias(x) for x in ("agreement", "quality", "recency")])


@query(w("usf", f"""select f.id as a, u.id as b, {fx.matches_sql('f.text', P.NEGATION)} <> {fx.matches_sql('u.snippet', P.NEGATION)} as contradicts from f join s on s.project_id = f.project_id join u on u.source_id = s.id
   where f.text is not null and u.snippet <> '' and f.id in (select claim_field_id from citations) and (f.id, u.id) in (select trim(claim_field_id), trim(x) from citations, unnest(case when json_valid(evidence_ids) and json_type(evidence_ids) = 'ARRAY' then cast(evidence_ids as varchar[]) else [] end) t(x))"""))
def sco13_contradiction(spark: SparkSession, d: str) -> DataFrame:
    cited = v.citations(spark, d).select(C("claim_field_id").alias("a"), F.explode("ids").alias("b")).distinct()
    f = v.fields(spark, d).where("text is not null").select(C("id").alias("a"), "project_id", cl.negated(C("text")).alias("na"))
    u = project_units(spark, d).select(C("id").alias("b"), C("project_id").alias("p2"), cl.negated(C("snippet")).alias("nb"))
    return cited.join(f, "a").join(u, "b").where("project_id = p2").select("a", "b", (C("na") != C("nb")).alias("contradicts"))


def persona_fields(spark: SparkSession, d: str) -> DataFrame:
    n = v.citations(spark, d).groupBy(C("claim_field_id").alias("id")).agg(F.count("*").alias("support"))
    f = v.fields(spark, d).join(n, "id", "left")
    return f.select(C("project_id").alias("persona"), "id", C("confidence").alias("score"), F.coalesce("support", F.lit(0)).alias("support"))


PERSONA = """with n as (select claim_field_id as id, count(*) as support from c group by 1),
  pf as (select f.project_id as persona, f.id, f.confidence as score, coalesce(n.support, 0) as support, (least(1.0, coalesce(n.support, 0) / 3.0) + f.confidence) / 2 as wt from f left join n on n.id = f.id),
  pg as (select persona, count(score) as n, sum(score * wt) / nullif(sum(wt), 0) as weighted, min(score) as least_, max(score) as most, count(*) filter (where score > 0.8) as hi, count(*) filter (where score < 0.5) as lo from pf group by 1),
  po as (select *, case when n = 0 then 0 else least(1.0, greatest(0.0, coalesce(weighted, 0) * greatest(0.3, least_) + 0.05 * hi::double / n - 0.1 * lo::double / n)) end as overall from pg),
  pr as (select *, case when overall >= 0.85 and least_ >= 0.6 then 'approve' when overall >= 0.6 then 'review' else 'reject' end as recommendation from po)
"""


@query(w("fc", PERSONA + "select persona, n, round(weighted, 6) as weighted, least_ as least, most, round(overall, 6) as overall, recommendation from pr"))
def sco15_persona_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = cl.persona_confidence(persona_fields(spark, d))
    return p.select("persona", "n", F.round("weighted", 6).alias("weighted"), "least", "most", F.round("overall", 6).alias("overall"), "recommendation")


@query(w("fc", PERSONA + "select persona, round(coalesce(weighted, 0), 6) as weighted from pr"))
def agg15_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    return cl.persona_confidence(persona_fields(spark, d)).select("persona", F.round(F.coalesce("weighted", F.lit(0.0)), 6).alias("weighted"))


@query(w("f", "select project_id, round(avg(confidence), 6) as confidence from f group by 1"))
def sco16_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return v.fields(spark, d).groupBy("project_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


@query(w("fc", PERSONA + "select recommendation, count(*) as n, round(avg(overall), 6) as confidence from pr group by 1"))
def agg24_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return cl.persona_confidence(persona_fields(spark, d)).groupBy("recommendation").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("confidence"))


PRICES = [("article", 0.03, 0.06), ("transcript", 0.01, 0.03), ("review_note", 0.0005, 0.0015)]
PRICE_SQL = "(values " + ", ".join(f"('{k}', {a}::double, {b}::double)" for k, a, b in PRICES) + ") as pr(model, prompt, completion)"


@query(f"select doc_id, ceil(coalesce(length(text), 0) / 4.0)::bigint as tokens, round(ceil(coalesce(length(text), 0) / 4.0) * coalesce(prompt + completion, 0) / 2 / 1000, 9) as cost from documents left join {PRICE_SQL} on model = doc_kind")
def sco17_token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Tokens times the mean price of a model; an unknown model costs nothing."""
    prices = spark.createDataFrame(PRICES, "doc_kind string, prompt double, completion double")
    tokens = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4)
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", tokens.alias("tokens"))
    return docs.join(F.broadcast(prices), "doc_kind", "left").select("doc_id", "tokens", F.round(C("tokens") * F.coalesce(C("prompt") + C("completion"), F.lit(0.0)) / 2 / 1000, 9).alias("cost"))


POINTS = """with pts as (select f.id, f.confidence as predicted, avg(u.quality_score) as actual from f join c on c.claim_field_id = f.id, unnest(c.ids) as x(e) join u on u.id = x.e where f.confidence is not null group by 1, 2 having avg(u.quality_score) is not null)
"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each field against the mean quality of what it cites."""
    c = v.citations(spark, d).select(C("claim_field_id").alias("id"), F.explode("ids").alias("e"))
    u = v.units(spark, d).select(C("id").alias("e"), "quality_score")
    f = v.fields(spark, d).where("confidence is not null").select("id", C("confidence").alias("predicted"))
    return f.join(c, "id").join(u, "e").groupBy("id", "predicted").agg(F.avg("quality_score").alias("actual")).where("actual is not null")


@query(w("ufc", POINTS + "select count(*) as n, round(avg(abs(predicted - actual)), 6) as mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) as rmse from pts"))
def agg19_errors(spark: SparkSession, d: str) -> DataFrame:
    e = C("predicted") - C("actual")
    return points(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query(w("ufc", POINTS + "select round(coalesce(corr(predicted, actual), 0), 6) as r from pts"))
def agg20_correlation(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).agg(F.round(cl.correlation("predicted", "actual"), 6).alias("r"))


CAL = POINTS + ", cal as (select (floor(predicted * 10) + 0.5) / 10 as centre, avg(actual) as mean_actual, count(*) as n from pts where predicted >= 0 and predicted < 1 group by 1)"


@query(w("ufc", CAL + " select round(centre, 6) as centre, round(mean_actual, 6) as mean_actual, n from cal"))
def agg21_calibration(spark: SparkSession, d: str) -> DataFrame:
    return cl.calibration(points(spark, d)).select(F.round("centre", 6).alias("centre"), F.round("mean_actual", 6).alias("mean_actual"), "n")


@query(w("ufc", CAL + " select round(1 - (select sum(n * (centre - mean_actual) * (centre - mean_actual)) / sum(n) from cal), 6) as reliability, round((select var_pop(actual) from pts), 6) as resolution"))
def agg22_reliability(spark: SparkSession, d: str) -> DataFrame:
    p = materialise(points(spark, d), "points")
    gap = C("centre") - C("mean_actual")
    rel = cl.calibration(p).agg(F.round(1 - F.sum(C("n") * gap * gap) / F.sum("n"), 6).alias("reliability"))
    return rel.crossJoin(p.agg(F.round(F.var_pop("actual"), 6).alias("resolution")))  # one row each


# Citations

SENT = f"""with st as (select id, {fx.citation_sentences_sql('text')} as ss from f where text is not null),
  sent as (select id, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as i from st), n as (select f.id, coalesce(len(st.ss), 0) as n_sent from f left join st using (id)),
  refs as (select c.id as cid, c.claim_field_id as fid, c.sentence_index as i, unnest(c.ids) as e from c)
"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    f = v.fields(spark, d).where("text is not null")
    return f.select("id", F.posexplode(fx.citation_sentences(C("text"))).alias("i", "sentence"))


def references(spark: SparkSession, d: str) -> DataFrame:
    return v.citations(spark, d).select(C("id").alias("cid"), C("claim_field_id").alias("fid"), C("sentence_index").alias("i"), F.explode("ids").alias("e"))


@query(w("fc", SENT + """select (select count(*) from f) as n_claims, (select count(*) from sent) as n_sentences, (select count(*) from c where claim_field_id in (select id from f)) as n_citations,
  round((select count(*) from c where claim_field_id in (select id from f)) / (select count(*) from sent)::double, 6) as per_sentence, (select count(distinct e) from refs) as n_evidence"""))
def agg23_citation_stats(spark: SparkSession, d: str) -> DataFrame:
    f = v.fields(spark, d)
    n = f.agg(F.count("*").alias("n_claims")).crossJoin(sentences(spark, d).agg(F.count("*").alias("n_sentences")))  # one row each
    c = v.citations(spark, d).join(f.select(C("id").alias("claim_field_id")), "claim_field_id", "left_semi").agg(F.count("*").alias("n_citations"))
    e = references(spark, d).agg(F.count_distinct("e").alias("n_evidence"))
    return n.crossJoin(c).crossJoin(e).select("n_claims", "n_sentences", "n_citations", F.round(C("n_citations") / C("n_sentences"), 6).alias("per_sentence"), "n_evidence")  # one row each


FIND = SENT + f""", tk as (select id, i, list_distinct({fx.citation_tokens_sql('sentence')}) as st from sent), ut as (select id, list_distinct({fx.citation_tokens_sql('snippet')}) as st from u where snippet <> ''),
  al as (select r.cid, r.fid, r.i, max(coalesce(len(list_intersect(tk.st, ut.st))::double / nullif(len(tk.st) + len(ut.st) - len(list_intersect(tk.st, ut.st)), 0), 0.0)) as score from refs r join tk on tk.id = r.fid and tk.i = r.i left join ut on ut.id = r.e group by 1, 2, 3),
  per as (select s.id, s.i, count(c.id) as k from sent s left join c on c.claim_field_id = s.id and c.sentence_index = s.i group by 1, 2),
  found as (select fid as field_id, i as sentence_index, 'missing_evidence' as kind, 'critical' as severity, e as what from refs where fid in (select id from f) and e not in (select id from u)
    union all select c.claim_field_id, c.sentence_index, 'invalid_format', 'high', c.id from c join n on n.id = c.claim_field_id where c.sentence_index >= n.n_sent
    union all select c.claim_field_id, c.sentence_index, 'confidence_too_low', 'medium', c.id from c join n on n.id = c.claim_field_id join f on f.id = c.claim_field_id where c.sentence_index < n.n_sent and f.confidence < 0.7
    union all select fid, i, 'semantic_mismatch', 'medium', cid from al where score < 0.75
    union all select fid, i, 'weak_alignment', 'warning', cid from al where score >= 0.75 and score < 0.85
    union all select id, i, 'insufficient_citations', 'high', '' from per where k < 1
    union all select id, i, 'redundant_citations', 'warning', '' from per where k > 3)
"""


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """(cid, fid, i, score): the best similarity of each cited sentence to what it cites."""
    s = sentences(spark, d).select(C("id").alias("fid"), "i", token_set(C("sentence")).alias("sa"))
    u = v.units(spark, d).where("snippet <> ''").select(C("id").alias("e"), token_set(C("snippet")).alias("sb"))
    r = references(spark, d).join(s, ["fid", "i"]).join(u, "e", "left").withColumn("sb", F.coalesce("sb", F.array().cast("array<string>")))
    return cl.with_jaccard(r).groupBy("cid", "fid", "i").agg(F.max("jaccard").alias("score"))


def citation_findings(spark: SparkSession, d: str) -> DataFrame:
    f = v.fields(spark, d).select(C("id").alias("fid"), "confidence", F.coalesce(F.size(fx.citation_sentences(C("text"))), F.lit(0)).alias("n_sent"))
    c = v.citations(spark, d).select(C("id").alias("cid"), C("claim_field_id").alias("fid"), C("sentence_index").alias("i")).join(f, "fid")
    al = materialise(alignment(spark, d), "alignment")
    per = sentences(spark, d).join(v.citations(spark, d).groupBy(C("claim_field_id").alias("id"), C("sentence_index").alias("i")).agg(F.count("*").alias("k")), ["id", "i"], "left").fillna(0)
    refs = references(spark, d).join(f.select("fid"), "fid", "left_semi").join(v.units(spark, d).select(C("id").alias("e")), "e", "left_anti")
    row = lambda df, field, kind, severity, what: df.select(C(field).alias("field_id"), C("i").alias("sentence_index"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), what.alias("what"))
    none = F.lit("")
    parts = [
        row(refs, "fid", "missing_evidence", "critical", C("e")), row(c.where("i >= n_sent"), "fid", "invalid_format", "high", C("cid")),
        row(c.where("i < n_sent and confidence < 0.7"), "fid", "confidence_too_low", "medium", C("cid")), row(al.where("score < 0.75"), "fid", "semantic_mismatch", "medium", C("cid")),
        row(al.where("score >= 0.75 and score < 0.85"), "fid", "weak_alignment", "warning", C("cid")), row(per.where("k < 1"), "id", "insufficient_citations", "high", none), row(per.where("k > 3"), "id", "redundant_citations", "warning", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(w("ufc", FIND + "select * from found"))
def val1_findings(spark: SparkSession, d: str) -> DataFrame:
    return citation_findings(spark, d)


@query(w("ufc", FIND + "select field_id, count(*) filter (where severity in ('critical', 'high')) = 0 as valid from found group by 1"))
def val1_validity(spark: SparkSession, d: str) -> DataFrame:
    return citation_findings(spark, d).groupBy("field_id").agg((F.count_if(C("severity").isin("critical", "high")) == 0).alias("valid"))


MARK = r"\[evidence_[a-zA-Z0-9_-]+\]"
MARKS = f"""with mk as (select f.id, f.project_id, m.mark, m.pos from f, unnest(regexp_extract_all(text, '{MARK.replace(chr(92), chr(92))}')) with ordinality as m(mark, pos)),
  dup as (select *, row_number() over (partition by project_id, mark order by id, pos) > 1 as again from mk),
  fm as (select f.id, len({fx.citation_sentences_sql('coalesce(text, chr(32))')}) as expected, len(regexp_extract_all(coalesce(text, ''), '{MARK}')) as found, len(regexp_extract_all(coalesce(text, ''), '\\[evidence[^\\]]*\\]')) - len(regexp_extract_all(coalesce(text, ''), '{MARK}')) as malformed from f)
"""


def marks(spark: SparkSession, d: str) -> DataFrame:
    m = v.fields(spark, d).where("text is not null").select("id", "project_id", F.posexplode(fx.found(C("text"), MARK)).alias("pos", "mark"))
    again = F.row_number().over(Window.partitionBy("project_id", "mark").orderBy("id", "pos")) > 1
    return m.withColumn("again", again)


@query(w("f", MARKS + "select id, cast(pos - 1 as int) as pos, mark, again from dup"))
def win7_repeated_marks(spark: SparkSession, d: str) -> DataFrame:
    return marks(spark, d).select("id", "pos", "mark", "again")


def mark_format(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    dup = marks(spark, d).groupBy("id").agg(F.count_if("again").alias("repeated"))
    f = v.fields(spark, d).select("id", F.size(fx.citation_sentences(F.coalesce("text", F.lit(" ")))).alias("expected"), fx.count(t, MARK).alias("found"), (fx.count(t, r"\[evidence[^\]]*\]") - fx.count(t, MARK)).alias("malformed"))
    f = f.join(dup, "id", "left").fillna(0, ["repeated"])
    return f.withColumn("compliance", F.when(C("expected") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(C("found").cast("double"), C("expected")))))


FORMAT = MARKS + ", fmt as (select fm.*, coalesce(r.repeated, 0) as repeated, case when expected = 0 then 0 else least(1.0, found::double / expected) end as compliance from fm left join (select id, count(*) filter (where again) as repeated from dup group by 1) r using (id))"


@query(w("f", FORMAT + " select id, expected, found, malformed, repeated, round(compliance, 6) as compliance from fmt"))
def val2_mark_format(spark: SparkSession, d: str) -> DataFrame:
    return mark_format(spark, d).select("id", "expected", "found", "malformed", "repeated", F.round("compliance", 6).alias("compliance"))


GROUND = FORMAT + """, cq as (select claim_field_id as id, count(*) as k, count(*) filter (where len(ids) > 0) as ok, count(distinct case when len(ids) > 0 then ids[1] end) as used from c group by 1),
  gr as (select fmt.id, coalesce(f.confidence, 0) as conf, compliance, coalesce(ok::double / nullif(k, 0), 0) as quality, coalesce(100.0 * used / nullif(k, 0), 0) as utilisation from fmt join f using (id) left join cq using (id)),
  gs as (select *, least(1.0, greatest(0.0, 0.4 * quality + 0.2 * compliance + 0.2 * least(1.0, utilisation / 80) + 0.2 * conf))::double as score from gr)
"""


def grounding(spark: SparkSession, d: str) -> DataFrame:
    has = F.size("ids") > 0
    q = v.citations(spark, d).groupBy(C("claim_field_id").alias("id")).agg(F.count("*").alias("k"), F.count_if(has).alias("ok"), F.count_distinct(F.when(has, C("ids")[0])).alias("used"))
    g = mark_format(spark, d).join(v.fields(spark, d).select("id", F.coalesce("confidence", F.lit(0.0)).alias("conf")), "id").join(q, "id", "left")
    quality = F.coalesce(F.try_divide(C("ok").cast("double"), C("k")), F.lit(0.0))
    utilisation = F.coalesce(F.try_divide(C("used") * F.lit(100.0), C("k")), F.lit(0.0))
    g = g.select("id", "compliance", "conf", quality.alias("quality"), utilisation.alias("utilisation"))
    score = C("quality") * 0.4 + C("compliance") * 0.2 + F.least(F.lit(1.0), C("utilisation") / 80) * 0.2 + C("conf") * 0.2
    return g.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


@query(w("fc", GROUND + "select id, round(score, 6) as score, score >= 0.8 as grounded from gs"))
def val3_grounding(spark: SparkSession, d: str) -> DataFrame:
    return grounding(spark, d).select("id", F.round("score", 6).alias("score"), (C("score") >= 0.8).alias("grounded"))


@query(w("fc", GROUND + """select id, 'add_citations' as suggestion from gs where quality < 1 union all select id, 'add_marks' from gs where compliance < 1 union all select id, 'use_more_evidence' from gs where utilisation < 80 union all select id, 'raise_confidence' from gs where conf < 0.7"""))
def val4_suggestions(spark: SparkSession, d: str) -> DataFrame:
    g = grounding(spark, d)
    rules = [(C("quality") < 1, "add_citations"), (C("compliance") < 1, "add_marks"), (C("utilisation") < 80, "use_more_evidence"), (C("conf") < 0.7, "raise_confidence")]
    return g.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("suggestion"))


@query("select n::int as attempt, round(greatest(0.7 - 0.1 * n, 0.5), 6)::double as min_confidence, least(n + 1, 3)::int as citations, round(greatest(0.7 - 0.05 * n, 0.6), 6)::double as min_alignment from range(1, 4) t(n)")
def val5_retry_policy(spark: SparkSession, d: str) -> DataFrame:
    return cl.retry_policy(spark)


@query(w("ufc", SENT + "select n.id, not exists (select 1 from refs r where r.fid = n.id and r.e not in (select id from u)) and (select count(distinct sentence_index) from c where c.claim_field_id = n.id) >= n_sent as strict from n"))
def val6_strict(spark: SparkSession, d: str) -> DataFrame:
    """All cited ids exist and at least as many sentences are cited as there are."""
    f = v.fields(spark, d).select("id", F.coalesce(F.size(fx.citation_sentences(C("text"))), F.lit(0)).alias("n_sent"))
    bad = references(spark, d).join(v.units(spark, d).select(C("id").alias("e")), "e", "left_anti").select(C("fid").alias("id")).distinct().withColumn("bad", F.lit(True))
    k = v.citations(spark, d).groupBy(C("claim_field_id").alias("id")).agg(F.count_distinct("sentence_index").alias("k"))
    return f.join(bad, "id", "left").join(k, "id", "left").select("id", (C("bad").isNull() & (F.coalesce("k", F.lit(0)) >= C("n_sent"))).alias("strict"))


@query(w("us", "select s.project_id, count(*) between 1 and 100 as ok from u join s on s.id = u.source_id group by 1"))
def val8_request_limits(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d).select(C("id").alias("source_id"), "project_id")
    return v.units(spark, d).join(s, "source_id").groupBy("project_id").agg(F.count("*").between(1, 100).alias("ok"))


@query(w("ufc", SENT + "select f.id, least(1.0, greatest(0.0, coalesce(f.confidence, 0)))::double as confidence, count(distinct r.e) filter (where r.e in (select id from u)) as cited, count(distinct r.e) filter (where r.e not in (select id from u)) as unknown from f left join refs r on r.fid = f.id group by 1, 2"))
def val9_old_client(spark: SparkSession, d: str) -> DataFrame:
    known = v.units(spark, d).select(C("id").alias("e"), F.lit(True).alias("known"))
    r = references(spark, d).join(known, "e", "left").select(C("fid").alias("id"), "e", F.coalesce("known", F.lit(False)).alias("known"))
    f = v.fields(spark, d).select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"))
    return f.join(r, "id", "left").groupBy("id", "confidence").agg(F.count_distinct(F.when(C("known"), C("e"))).alias("cited"), F.count_distinct(F.when(~C("known"), C("e"))).alias("unknown"))


POT = SENT + f""", tk as (select sent.id, sent.i, f.project_id, list_distinct({fx.citation_tokens_sql('sentence')}) as st from sent join f using (id)), ut as (select u.id, s.project_id, list_distinct({fx.citation_tokens_sql('snippet')}) as st from u join s on s.id = u.source_id where snippet <> ''),
  pot as (select tk.id as field_id, tk.i as sentence_index, ut.id as evidence_id, len(list_intersect(tk.st, ut.st))::double / (len(tk.st) + len(ut.st) - len(list_intersect(tk.st, ut.st))) as score from tk join ut using (project_id) where len(list_intersect(tk.st, ut.st)) > 0 and len(list_intersect(tk.st, ut.st))::double / (len(tk.st) + len(ut.st) - len(list_intersect(tk.st, ut.st))) >= 0.3)
"""


def potential(spark: SparkSession, d: str) -> DataFrame:
    f = v.fields(spark, d).where("text is not null and project_id is not null")
    s = f.select(C("project_id").alias("scope"), "id", F.posexplode(fx.citation_sentences(C("text"))).alias("i", "sentence"))
    s = s.select("scope", F.concat_ws("#", "id", "i").alias("id"), token_set(C("sentence")).alias("set"))
    u = project_units(spark, d).select(C("project_id").alias("scope"), "id", token_set(C("snippet")).alias("set"))
    pairs = cl.jaccard_pairs(materialise(s, "sentences"), materialise(u, "units"), 0.3)
    return pairs.select(F.substring_index("a", "#", 1).alias("field_id"), F.substring_index("a", "#", -1).cast("int").alias("sentence_index"), C("b").alias("evidence_id"), C("jaccard").alias("score"))


@query(w("usfc", POT + "select field_id, sentence_index, evidence_id, round(score, 6) as score from pot"))
def joi11_potential_evidence(spark: SparkSession, d: str) -> DataFrame:
    return potential(spark, d).withColumn("score", F.round("score", 6))


@query(w("usfc", POT + "select field_id, sentence_index, evidence_id from pot qualify row_number() over (partition by field_id, sentence_index order by score desc, evidence_id) <= 2"))
def srt6_suggested(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("field_id", "sentence_index").orderBy(C("score").desc(), "evidence_id"))
    return potential(spark, d).withColumn("rn", rn).where("rn <= 2").select("field_id", "sentence_index", "evidence_id")

"""Queries of similarity and deduplication (SIM, JOI8, SET1, SET4, WIN4, WIN6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import graph
from tessera.operators import relational as rel
from tessera.operators import similarity as sm
from tessera.plans import views as v
from tessera.plans.views import with_views as w
from tessera.runtime import materialise

C = F.col
TAU = 0.7


def items(spark: SparkSession, d: str) -> DataFrame:
    """Units with text: (scope, id, sh), scoped by their source."""
    u = v.units(spark, d).where("snippet <> '' and source_id is not null")
    return materialise(u.select(C("source_id").alias("scope"), "id", sm.shingles(sm.prepared(C("snippet"))).alias("sh")), "shingles")


PREP = "trim(regexp_replace(regexp_replace(lower(snippet), '[^A-Za-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
SH = """case when len(ws) < 3 then [p] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) end"""
ITEMS = w("u", f"""with i0 as (select source_id as scope, id, snippet, {PREP} as p from u where snippet <> '' and source_id is not null),
  items as (select scope, id, snippet, p, {SH} as sh from (select *, string_split(p, ' ') as ws from i0)),
  pairs0 as (select a.scope, a.id as a, b.id as b, len(list_intersect(a.sh, b.sh)) as k, len(a.sh) as na, len(b.sh) as nb, a.sh as sa, b.sh as sb from items a join items b on a.scope = b.scope and a.id < b.id),
  pairs as (select scope, a, b, k / sqrt(na * nb) as cosine, k::double / (na + nb - k) as jaccard, sa, sb from pairs0)
""")
MIN = "list_transform(range(128), lambda i: list_min(list_transform({sh}, lambda s: ('0x' || substring(sha256(s || i), 1, 8))::bigint)))"
BIT = "(('0x' || substring(sha256(s), (1 + (p - 1) // 4)::int, 1))::int >> (3 - (p - 1) % 4)::int) & 1"
SIM = f"array_to_string(list_transform(range(1, 65), lambda p: case when list_sum(list_transform({{sh}}, lambda s: 2 * ({BIT}) - 1)) >= 0 then '1' else '0' end), '')"
HAM = "len(list_filter(range(1, 65), lambda p: substring({a}, p::int, 1) <> substring({b}, p::int, 1)))"
FULL = ITEMS + f""", cand as (select * from pairs where cosine >= {sm.cosine_bound(TAU)}),
  sig as (select scope, id, {MIN.format(sh='sh')} as mh, {SIM.format(sh='sh')} as sim from items where (scope, id) in (select scope, a from cand union select scope, b from cand)),
  scored as (select c.scope, c.a, c.b, c.cosine, c.jaccard, len(list_filter(range(1, 129), lambda i: x.mh[i] = y.mh[i])) / 128.0::double as minhash, 1 - {HAM.format(a='x.sim', b='y.sim')} / 64.0::double as simhash
    from cand c join sig x on x.scope = c.scope and x.id = c.a join sig y on y.scope = c.scope and y.id = c.b),
  links as (select *, 0.4 * cosine + 0.25 * jaccard + 0.2 * minhash + 0.15 * simhash as overall from scored where 0.4 * cosine + 0.25 * jaccard + 0.2 * minhash + 0.15 * simhash >= {TAU})
"""


@query(ITEMS + "select id, p as text from items")
def sim1_prepared(spark: SparkSession, d: str) -> DataFrame:
    u = v.units(spark, d).where("snippet <> '' and source_id is not null")
    return u.select("id", sm.prepared(C("snippet")).alias("text"))


@query(ITEMS + "select id, list_sort(sh) as shingles from items", lists=("shingles",))
def sim2_shingles(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", F.sort_array("sh").alias("shingles"))


@query(ITEMS + "select id, len(sh) as n from items")
def win4_sliding(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", F.size("sh").alias("n"))


@query(ITEMS + "select scope, a, b, round(jaccard, 6) as jaccard from pairs where cosine >= 0.5")
def sim3_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return sm.cosine_pairs(items(spark, d), 0.5).select("scope", "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(ITEMS + "select scope, a, b, round(cosine, 6) as cosine from pairs where cosine >= 0.5")
def sim4_cosine(spark: SparkSession, d: str) -> DataFrame:
    return sm.cosine_pairs(items(spark, d), 0.5).select("scope", "a", "b", F.round("cosine", 6).alias("cosine"))


@query(ITEMS + "select id, list_sort(list_transform(sh, lambda s: ('0x' || substring(sha256(s || 7), 1, 8))::bigint)) as hashes from items", lists=("hashes",))
def sim5_hash(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", F.sort_array(F.transform("sh", lambda s: sm.hash32(s, F.lit(7)))).alias("hashes"))


@query(ITEMS + f"select id, {MIN.format(sh='sh')} as signature from items", lists=("signature",))
def sim6_minhash(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", sm.minhash(C("sh")).alias("signature"))


@query(FULL + "select scope, a, b, minhash from scored")
def sim7_minhash_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = sm.cosine_pairs(items(spark, d), sm.cosine_bound(TAU))
    sig = items(spark, d).select("scope", "id", sm.minhash(C("sh")).alias("m"))
    a, b = sig.select("scope", C("id").alias("a"), C("m").alias("ma")), sig.select("scope", C("id").alias("b"), C("m").alias("mb"))
    return pairs.join(a, ["scope", "a"]).join(b, ["scope", "b"]).select("scope", "a", "b", sm.equal_share(C("ma"), C("mb")).alias("minhash"))


@query(ITEMS + f"select id, {SIM.format(sh='sh')} as bits from items")
def sim8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", sm.simhash(C("sh")).alias("bits"))


def _simhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = sm.cosine_pairs(items(spark, d), sm.cosine_bound(TAU))
    sig = items(spark, d).select("scope", "id", sm.simhash(C("sh")).alias("h"))
    a, b = sig.select("scope", C("id").alias("a"), C("h").alias("ha")), sig.select("scope", C("id").alias("b"), C("h").alias("hb"))
    return pairs.join(a, ["scope", "a"]).join(b, ["scope", "b"]).select("scope", "a", "b", sm.hamming(C("ha"), C("hb")).alias("distance"))


@query(FULL + "select scope, a, b, cast(round((1 - simhash) * 64) as int) as distance from scored")
def sim9_hamming(spark: SparkSession, d: str) -> DataFrame:
    return _simhash_pairs(spark, d)


@query(FULL + "select scope, a, b, simhash >= 0.85 as near from scored")
def sim10_fast_check(spark: SparkSession, d: str) -> DataFrame:
    return _simhash_pairs(spark, d).select("scope", "a", "b", (1 - C("distance") / 64 >= 0.85).alias("near"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return sm.similar_pairs(items(spark, d), TAU)


@query(FULL + "select scope, a, b, round(overall, 6) as overall from links")
def sim11_overall(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("scope", "a", "b", F.round("overall", 6).alias("overall"))


@query(FULL + "select scope, a as x, b as y, round(overall, 6) as overall from links union all select scope, b, a, round(overall, 6) from links union all select scope, id, id, 1.0 from items")
def sim12_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The symmetric matrix in sparse form: what reaches the threshold, and the diagonal."""
    l = links(spark, d).select("scope", C("a").alias("x"), C("b").alias("y"), F.round("overall", 6).alias("overall"))  # noqa: E741
    diagonal = items(spark, d).select("scope", C("id").alias("x"), C("id").alias("y"), F.lit(1.0).alias("overall"))
    return l.unionByName(l.select("scope", C("y").alias("x"), C("x").alias("y"), "overall")).unionByName(diagonal)


@query(FULL + "select scope, count(*) as n_pairs from links group by 1")
def joi8_dedup_join(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy("scope").agg(F.count("*").alias("n_pairs"))


@query(ITEMS + "select scope, a, b, k as shared, na + nb - k as joint from pairs0 where k / sqrt(na * nb) >= 0.5")
def set1_sizes(spark: SparkSession, d: str) -> DataFrame:
    it = items(spark, d)
    p = sm.cosine_pairs(it, 0.5).select("scope", "a", "b")
    a, b = it.select("scope", C("id").alias("a"), C("sh").alias("sa")), it.select("scope", C("id").alias("b"), C("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return p.join(a, ["scope", "a"]).join(b, ["scope", "b"]).select("scope", "a", "b", both.alias("shared"), F.size(F.array_union("sa", "sb")).alias("joint"))


@query(w("u", "select id, min(id) over (partition by trim(snippet)) as original, count(*) over (partition by trim(snippet)) as n from u where trim(snippet) <> '' qualify count(*) over (partition by trim(snippet)) > 1"))
def sim13_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One row per copy with the least id of its group; groups are counted before they are joined back."""
    t = v.units(spark, d).select("id", F.trim("snippet").alias("t")).where("t <> ''")
    g = t.groupBy("t").agg(F.min("id").alias("original"), F.count("*").alias("n")).where("n > 1")
    return t.join(g, "t").select("id", "original", "n")


COMP = """, e as (select a, b from links union select b, a from links), reach as (select a as id, a as x from e union select b, b from e),
  walk(id, x) as (select id, x from reach union select r.id, e.b from walk r join e on e.a = r.x), comp as (select id, min(x) as grp from walk group by 1)
"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """(group, id, quality, confidence, text, topics, seq) of the units in clusters."""
    comp = graph.components(links(spark, d)).select(C("node").alias("id"), "group")
    u = v.units(spark, d).select("id", C("quality_score").alias("quality"), F.get_json_object("metadata", "$.confidenceScore").try_cast("double").alias("confidence"), C("snippet").alias("text"), rel.topic_list().alias("topics"), F.unix_micros("created_at").alias("seq"))
    return comp.join(u, "id")


CLUS = FULL.replace("with u", "with recursive u", 1) + COMP + """, m as (select comp.grp, u.id, u.quality_score as quality, try_cast(case when json_valid(metadata) then metadata ->> '$.confidenceScore' end as double) as confidence, u.snippet, u.created_at, u.topics from comp join u on u.id = comp.id)
"""


@query(CLUS + 'select grp as "group", id from m')
def sim14_components(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d).select("group", "id")


@query(CLUS + """select x.grp as "group", round(avg(p.jaccard), 6) as avg_similarity from pairs p join m x on x.id = p.a join m y on y.id = p.b and y.grp = x.grp group by 1""")
def sim15_cluster_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mean Jaccard over all member pairs, those below the threshold included."""
    m = clusters(spark, d).select("group", "id").join(items(spark, d).select("id", "sh"), "id")
    a, b = m.select("group", C("id").alias("a"), C("sh").alias("sa")), m.select("group", C("id").alias("b"), C("sh").alias("sb"))
    pairs = a.join(b, "group").where("a < b")
    return pairs.groupBy("group").agg(F.round(F.avg(sm.jaccard(C("sa"), C("sb"))), 6).alias("avg_similarity"))


@query(CLUS + """select grp as "group", id from m qualify row_number() over (partition by grp order by coalesce(quality, 0) + coalesce(confidence, 0) desc, created_at, id) = 1""")
def sim16_representatives(spark: SparkSession, d: str) -> DataFrame:
    return sm.representatives(clusters(spark, d).withColumn("seq", F.struct("seq", "id")))


@query(CLUS + """select grp as "group", id from m qualify row_number() over (partition by grp order by length(snippet) desc, created_at, id) = 1""")
def win6_argmax(spark: SparkSession, d: str) -> DataFrame:
    return sm.representatives(clusters(spark, d).withColumn("seq", F.struct("seq", "id")), "longest")


@query(CLUS + """select grp as "group", max(length(snippet)) as longest, round(avg(quality), 6) as quality, round(avg(confidence), 6) as confidence, count(*) as merged_count from m group by 1""")
def sim17_merged(spark: SparkSession, d: str) -> DataFrame:
    m = sm.merged(clusters(spark, d))
    return m.select("group", F.length("text").alias("longest"), F.round("quality", 6).alias("quality"), F.round("confidence", 6).alias("confidence"), "merged_count")


@query(CLUS + """select grp as "group", list_sort(list_distinct(flatten(list(case when json_valid(topics) and json_type(topics) = 'ARRAY' then list_transform(cast(topics as json[]), lambda x: x ->> '$') else [] end)))) as topics from m group by 1""", lists=("topics",))
def set4_topic_union(spark: SparkSession, d: str) -> DataFrame:
    return sm.merged(clusters(spark, d)).select("group", "topics")


@query(CLUS + "select (select count(*) from items) as n_units, count(distinct grp) as n_clusters, count(*) - count(distinct grp) as n_removed from m")
def sim19_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    c = clusters(spark, d).agg(F.count_distinct("group").alias("n_clusters"), (F.count("*") - F.count_distinct("group")).alias("n_removed"))
    return items(spark, d).agg(F.count("*").alias("n_units")).crossJoin(c)  # one row each


@query(FULL + "select a, b, round(cosine, 6) as cosine, round(jaccard, 6) as jaccard, round(minhash, 6) as minhash, round(simhash, 6) as simhash from links")
def sim20_pair_report(spark: SparkSession, d: str) -> DataFrame:
    l = links(spark, d)  # noqa: E741
    return l.select("a", "b", *[F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "minhash", "simhash")])

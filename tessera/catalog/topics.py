"""Queries of keywords and topics (KEY, TOP, AGG13, AGG14, AGG26, AGG27, WIN3, WIN5, SET5, JOI12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import query
from tessera.operators import keywords as kw
from tessera.operators import topics as tp
from tessera.runtime import materialise, spread, table

C = F.col
TERMS = "list_filter(string_split_regex(regexp_replace(lower(text), '[^A-Za-z0-9_ -]', ' ', 'g'), ' +'), lambda x: length(x) between 3 and 20)"
TF = f"""with occ as (select doc_id as doc, unnest({TERMS}) as term, generate_subscripts({TERMS}, 1) - 1 as pos from documents where text is not null),
  n as (select doc, term, count(*) as n, min(pos) as first from occ group by 1, 2),
  tf as (select *, sum(n) over (partition by doc) as total, n::double / sum(n) over (partition by doc) as tf from n),
  df as (select term, count(*) as df from tf group by 1), nd as (select count(distinct doc) as docs from tf),
  stop as (select term from df, nd where df > docs * 0.2),
  w as (select tf.*, df.df, tf * ln(docs::double / df.df) as weight, tf * ln((docs + 1)::double / (df.df + 1)) as own from tf join df using (term), nd where term not in (select term from stop))
"""


def tf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return kw.frequencies(spread(docs.where("text is not null").select("doc_id", "text"), docs), "doc_id", "text")


def weighted(spark: SparkSession, d: str, own: bool = False, stop: list[str] | None = None) -> DataFrame:
    """Weighted terms without stop words: the given ones, or those that the corpus shows."""
    t = materialise(tf(spark, d), "tf")
    df = materialise(kw.document_frequencies(t), "df")
    words = kw.stop_words(t, df=df) if stop is None else kw.listed(spark, stop)
    return kw.tf_idf(t, own, df).join(F.broadcast(words), "term", "left_anti")  # at most a few words of each text can stand in so many


@query(f"select doc_id, {TERMS} as terms from documents where text is not null", lists=("terms",))
def key1_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", kw.terms(C("text")).alias("terms"))


@query(TF + "select term from stop")
def key2_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return kw.stop_words(tf(spark, d))


STEM = "case " + " ".join(f"when ends_with(term, '{s}') and length(term) > {len(s) + 2} then substring(term, 1, length(term) - {len(s)})" for s in kw.SUFFIXES) + " when ends_with(term, 's') and length(term) > 3 and not ends_with(term, 'ss') then substring(term, 1, length(term) - 1) else term end"


GIVEN = ["the", "and", "for", "with", "of", "was", "that", "this"]


@query(TF + f"select doc, term, round(weight, 9) as weight, rank from (select *, row_number() over (partition by doc order by weight desc, n desc, first) as rank from (select tf.*, tf * ln(docs::double / df.df) as weight from tf join df using (term), nd where term not in ({', '.join(repr(x) for x in GIVEN)}))) where rank <= 5")
def key2_listed_stop_words(spark: SparkSession, d: str) -> DataFrame:
    """Top terms with a list of stop words given as data."""
    return kw.top(weighted(spark, d, stop=GIVEN), "weight", 5).select("doc", "term", F.round("weight", 9).alias("weight"), "rank")


@query(TF + f"select term, {STEM} as stem from df")
def key3_stems(spark: SparkSession, d: str) -> DataFrame:
    return tf(spark, d).select("term").distinct().select("term", kw.stem(C("term")).alias("stem"))


@query(TF + "select doc, term, round(own, 9) as weight, rank from (select *, row_number() over (partition by doc order by own desc, n desc, first) as rank from w) where rank <= 5")
def key4_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The text itself is counted once more, in its frequency and in the number of texts."""
    return kw.top(weighted(spark, d, True), "weight", 5).select("doc", "term", F.round("weight", 9).alias("weight"), "rank")


@query(TF + "select doc, term, n, rank from (select *, row_number() over (partition by doc order by tf desc, n desc, first) as rank from tf where term not in (select term from stop)) where rank <= 5")
def key5_simple_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = materialise(tf(spark, d), "tf")
    return kw.top(t.join(kw.stop_words(t), "term", "left_anti"), "tf", 5).select("doc", "term", "n", "rank")


@query(TF + "select doc, term, rank from (select *, row_number() over (partition by doc order by weight desc, n desc, first) as rank from w) where rank <= 4")
def win3_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return kw.top(weighted(spark, d), "weight", 4).select("doc", "term", "rank")


@query(TF + """, pairs as (select doc as a, lead(doc) over (order by doc) as b from (select distinct doc from tf)), nm as (select doc, sqrt(sum(n * n)) as nm from tf group by 1)
  select p.a, p.b, round(coalesce((select sum(x.n * y.n) from tf x join tf y using (term) where x.doc = p.a and y.doc = p.b) / (na.nm * nb.nm), 0), 6) as cosine from pairs p join nm na on na.doc = p.a join nm nb on nb.doc = p.b where p.b is not null""")
def key6_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each text against the text with the next id."""
    t = materialise(tf(spark, d), "tf")
    ids = t.select("doc").distinct().repartitionByRange("doc")
    bucket = materialise(ids.withColumn("part", F.spark_partition_id()), "ranges")
    inside = bucket.withColumn("b", F.lead("doc").over(Window.partitionBy("part").orderBy("doc"))).withColumnRenamed("doc", "a")
    heads = bucket.groupBy("part").agg(F.min("doc").alias("head"))  # a row per range
    nxt = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("head"))  # a row per range
    pairs = inside.join(F.broadcast(nxt), "part", "left").select("a", F.coalesce("b", "head").alias("b")).where("b is not null")
    return kw.cosine(t, pairs).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(TF + "select doc, term, n, round(tf, 9) as tf from tf")
def agg13_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tf(spark, d).select("doc", "term", "n", F.round("tf", 9).alias("tf"))


@query(TF + "select doc, term, df, round(weight, 9) as weight from w")
def agg14_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    return weighted(spark, d).select("doc", "term", "df", F.round("weight", 9).alias("weight"))


@query(TF + "select doc, term, list(pos order by pos) as places from occ group by 1, 2", lists=("places",))
def win5_positions(spark: SparkSession, d: str) -> DataFrame:
    o = kw.occurrences(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return o.groupBy("doc", "term").agg(F.array_sort(F.collect_list("pos")).alias("places"))


@query(TF + "select term, df from df where term not in (select term from stop)")
def set5_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    t = materialise(tf(spark, d), "tf")
    return kw.document_frequencies(t).join(kw.stop_words(t), "term", "left_anti")


TOPK = TF + ", k as (select * from (select *, row_number() over (partition by doc order by weight desc, n desc, first) as rank from w) where rank <= 4)"


def topics(spark: SparkSession, d: str) -> DataFrame:
    return materialise(kw.top(weighted(spark, d), "weight", 4), "topics")


@query(TOPK + " select doc, list({'term': term, 'n': n} order by rank) as topics from k group by 1", lists=("topics",))
def top1_topics(spark: SparkSession, d: str) -> DataFrame:
    g = topics(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))).alias("x"))
    return g.select("doc", F.transform("x", lambda s: F.struct(s["term"].alias("term"), s["n"].alias("n"))).alias("topics"))


CONF = "least(1.0, 0.5 + 0.4 * least(weight / 0.5, 1) + 0.25 * least(10 * tf, 1) + case when n > 1 then 0.2 else 0.1 end + case when length(term) between 4 and 12 then 0.15 when length(term) between 3 and 15 then 0.07 else 0 end)"


@query(TOPK + f""" select doc, round(least(1.0, 0.6 * avg({CONF}) + case when count(*) >= 2.8 then 0.25 else 0.1 end + case when max(len_) between 100 and 500 then 0.15 else 0.07 end), 6) as confidence
  from k join (select doc_id as doc, length(text) as len_ from documents) using (doc) group by 1""")
def top2_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("term")
    one = F.least(F.lit(1.0), 0.5 + 0.4 * F.least(C("weight") / 0.5, F.lit(1.0)) + 0.25 * F.least(C("tf") * 10, F.lit(1.0)) + F.when(C("n") > 1, 0.2).otherwise(0.1) + F.when(n.between(4, 12), 0.15).when(n.between(3, 15), 0.07).otherwise(0.0))
    size = table(spark, d, "documents").select(C("doc_id").alias("doc"), F.length("text").alias("len"))
    g = topics(spark, d).withColumn("c", one).join(size, "doc").groupBy("doc").agg(F.avg("c").alias("avg"), F.count("*").alias("k"), F.max("len").alias("len"))
    score = C("avg") * 0.6 + F.when(C("k") >= 2.8, 0.25).otherwise(0.1) + F.when(C("len").between(100, 500), 0.15).otherwise(0.07)
    return g.select("doc", F.round(F.least(F.lit(1.0), score), 6).alias("confidence"))


@query(TOPK + " select doc, list({'term': term, 'x': round(weight * 1000000)::bigint} order by term) as features from k group by 1", lists=("features",))
def top3_features(spark: SparkSession, d: str) -> DataFrame:
    """Sparse feature vectors over the vocabulary of all topics."""
    return topics(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("term", F.round(C("weight") * 1_000_000).cast("long").alias("x")))).alias("features"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query()
def top4_elbow(spark: SparkSession, d: str) -> DataFrame:
    k = tp.elbow(vectors(spark, d), "embedding", 6)
    return spark.createDataFrame([(k, tp.elbow(vectors(spark, d), "embedding", 6, compatible=True))], "k int, compatible_k int")


@query()
def top5_kmeans(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d)
    return tp.assigned(e, "embedding", tp.kmeans(e, "embedding", 4)).select("vec_id", "cluster")


@query("select label, count(*) as n, min(vec_id) as first_member from embeddings group by 1 having count(*) >= 2")
def top6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters large enough; their members stay rows of the assignment (joi12), never a list in one row."""
    return vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_member")).where("n >= 2")


@query("""with c as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) t(i) group by 1, 2), u as (select label, vec_id, sum(embedding[i]::double * embedding[i]) as q, list(embedding[i]::double order by i) as e from embeddings, range(1, 65) t(i) group by 1, 2),
  s as (select label, i, sum(e[i] / sqrt(q)) as s, count(*) as n from u, range(1, 65) t(i) group by 1, 2)
  select label, round(case when max(n) < 2 then 1 else (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) end, 6) as coherence from s group by 1""")
def top7_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise cosine of each cluster from the sum of its unit vectors: (|sum|^2 - n) / (n (n - 1)), no pair is built."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors(spark, d).select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") / norm).alias("u"))
    s = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    g = s.groupBy("label").agg(F.sum(C("s") * C("s")).alias("q"), F.max("n").alias("n"))
    return g.select("label", F.round(F.when(C("n") < 2, 1.0).otherwise(F.try_divide(C("q") - C("n"), C("n") * (C("n") - 1))), 6).alias("coherence"))


CENT = """with c as (select label, i, avg(embedding[i]::double) as m, count(*) as n from embeddings, range(1, 65) t(i) group by 1, 2)"""


@query(CENT + """, dist as (select e.vec_id, e.label, c.label as other, max(c.n) as n, sqrt(sum((e.embedding[c.i]::double - c.m) * (e.embedding[c.i]::double - c.m))) as dist from embeddings e, c group by 1, 2, 3)
  select vec_id, label, round(case when max(n) filter (where other = label) = 1 then 1 else coalesce((min(dist) filter (where other <> label) - max(dist) filter (where other = label)) / greatest(min(dist) filter (where other <> label), max(dist) filter (where other = label)), 0) end, 6) as silhouette from dist group by 1, 2""")
def top8_silhouette(spark: SparkSession, d: str) -> DataFrame:
    s = tp.silhouette(vectors(spark, d), "vec_id", "label", "embedding")
    return s.select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


@query(CENT + " select e.vec_id, round(sqrt(sum((e.embedding[c.i]::double - c.m) * (e.embedding[c.i]::double - c.m))), 6) as distance from embeddings e join c on c.label = e.label group by 1")
def top9_distance(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d)
    c = tp.centroids(e, "label", "embedding").select(C("cluster").alias("label"), "centroid")
    return e.join(F.broadcast(c), "label").select("vec_id", F.round(tp.euclidean(C("embedding"), C("centroid")), 6).alias("distance"))


@query()
def top10_batch(spark: SparkSession, d: str) -> DataFrame:
    """Vectors clustered, with the topics of a text each where there is one of the same number."""
    e = vectors(spark, d)
    a = tp.assigned(e, "embedding", tp.kmeans(e, "embedding", 4)).select(C("vec_id").alias("doc"), "cluster")
    t = topics(spark, d).groupBy("doc").agg(F.collect_list("term").alias("terms"))
    return a.join(t, "doc", "left")


LABELS = TOPK + ", cl as (select k.*, documents.source as cluster from k join documents on doc_id = doc where documents.source is not null), cc as (select cluster, term, count(*) as n from cl group by 1, 2), r as (select *, row_number() over (partition by cluster order by n desc, term) as rn from cc)"


@query(LABELS + " select cluster, list(term order by rn) as keywords, string_agg(term, ', ' order by rn) filter (where rn <= 3) as label from r where rn <= 5 group by 1", lists=("keywords",))
def agg26_cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "documents").where("source is not null").select(C("doc_id").alias("doc"), C("source").alias("cluster"))
    n = topics(spark, d).join(src, "doc").groupBy("cluster", "term").agg(F.count("*").alias("n"))
    r = n.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(C("n").desc(), "term"))).where("rn <= 5")
    g = r.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda s: s["term"]).alias("keywords"))
    return g.select("cluster", "keywords", F.array_join(F.slice("keywords", 1, 3), ", ").alias("label"))


@query(CENT + " select label, i - 1 as i, round(m, 6) as m from c")
def agg27_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = tp.centroids(vectors(spark, d), "label", "embedding")
    return c.select(C("cluster").alias("label"), F.posexplode("centroid").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))


@query("""select e.vec_id, m.label as cluster, m.n as cluster_size from embeddings e left join (select label, count(*) as n from embeddings group by 1 having count(*) >= 2) m using (label)""")
def joi12_cluster_back_join(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d)
    m = e.groupBy("label").agg(F.count("*").alias("cluster_size")).where("cluster_size >= 2")
    return e.select("vec_id", "label").join(m.withColumn("cluster", C("label")), "label", "left").select("vec_id", "cluster", "cluster_size")

"""Terms of documents: frequencies, weights, stop words by rule, stems, top terms, cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Suffixes in the order in which they are tried.
SUFFIXES = "ing ed er est ly tion sion ness ment able ible".split()


def terms(c: Column, least: int = 3, most: int = 20) -> Column:
    """Small words of ASCII letters, digits, _ and -, of the given lengths, in order."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_ -]", " "), " +")
    return F.filter(words, lambda x: (F.length(x) >= least) & (F.length(x) <= most))


def stem(c: Column) -> Column:
    out = None
    cut = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    cases = [(F.endswith(c, F.lit(s)) & (F.length(c) > len(s) + 2), cut(len(s))) for s in SUFFIXES]
    cases.append((F.endswith(c, F.lit("s")) & (F.length(c) > 3) & ~F.endswith(c, F.lit("ss")), cut(1)))
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(c)


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, pos): a row per term of each text."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(terms(F.col(text))).alias("pos", "term"))


def frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, n, first, total, tf): term counts, first places and shares in each text.

    Counted inside each row: its terms are sorted with their places, and runs of
    equal terms are its counts, so nothing is shuffled. Keys must be unique.
    """
    sorted_ = F.array_sort(F.transform(terms(F.col(text)), lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    rows = docs.select(F.col(key).alias("doc"), sorted_.alias("s")).where(F.size("s") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["t"] != F.get("s", i - 1)["t"]))
    rows = rows.select("doc", "s", F.size("s").alias("all"), starts.alias("k"))
    runs = F.transform("k", lambda i, j: F.struct(
        F.get("s", i)["t"].alias("term"), (F.coalesce(F.get(F.col("k"), j + 1), F.col("all")) - i).cast("long").alias("n"), F.get("s", i)["i"].alias("first")
    ))
    return rows.select("doc", F.col("all").cast("long").alias("total"), F.inline(runs)).select("doc", "term", "n", "first", "total", (F.col("n") / F.col("total")).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def documents(tf: DataFrame) -> DataFrame:
    """(docs): the number of texts with terms: in each, one term is the first."""
    return tf.agg(F.count_if(F.col("first") == 0).alias("docs"))


def stop_words(tf: DataFrame, share: float = 0.2, df: DataFrame | None = None) -> DataFrame:
    """(term): the terms of more than ``share`` of all texts, where no list is given (see ``listed``)."""
    df = document_frequencies(tf) if df is None else df
    return df.crossJoin(F.broadcast(documents(tf))).where(F.col("df") > F.col("docs") * share).select("term")  # one row


def listed(spark: SparkSession, words: list[str]) -> DataFrame:
    """(term): a given list of stop words, as data, for those who want the words of another system."""
    return spark.createDataFrame([(w,) for w in sorted({w.lower() for w in words})], "term string")


def tf_idf(tf: DataFrame, self_counted: bool = False, df: DataFrame | None = None) -> DataFrame:
    """tf with (df, docs, weight = tf * ln(docs / df)); ``self_counted`` counts the text itself once more."""
    more = 1 if self_counted else 0
    docs = documents(tf).select((F.col("docs") + more).alias("docs"))
    df = (document_frequencies(tf) if df is None else df).withColumn("df", F.col("df") + more)
    return tf.join(df, "term").crossJoin(F.broadcast(docs)).withColumn("weight", F.col("tf") * F.log(F.col("docs") / F.col("df")))  # one row


def top(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best terms of each text; equal scores in order of frequency, then of first occurrence."""
    w = Window.partitionBy("doc").orderBy(F.col(score).desc(), F.col("n").desc(), "first")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(tf: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of the texts' term counts, for pairs (a, b); 0 where nothing is shared."""
    norm = tf.groupBy("doc").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a = tf.select(F.col("doc").alias("a"), "term", F.col("n").alias("x"))
    b = tf.select(F.col("doc").alias("b"), "term", F.col("n").alias("y"))
    dot = pairs.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = norm.select(F.col("doc").alias("a"), F.col("norm").alias("na")), norm.select(F.col("doc").alias("b"), F.col("norm").alias("nb"))
    full = pairs.join(dot, ["a", "b"], "left").join(na, "a", "left").join(nb, "b", "left")
    return full.select("a", "b", F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))

"""Shingle similarity: set measures, min-wise and bit signatures, lossless join, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import let
from tessera.runtime import materialise

SEEDS, BITS = 128, 64


def prepared(c: Column) -> Column:
    """Small letters, everything but ASCII word characters blanked, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_ ]", " "), " +", " "))


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct runs of k words of a prepared text; fewer words are one run."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(found))

    return let(F.split(c, " "), runs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(a) * F.size(b))), F.lit(1.0))


def hash32(s: Column, seed: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(s, seed.cast("string")), 256), 1, 8), 16, 10).cast("long")


def minhash(sh: Column, seeds: int = SEEDS) -> Column:
    return let(sh, lambda a: F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda i: F.array_min(F.transform(a, lambda s: hash32(s, i)))))


def equal_share(a: Column, b: Column) -> Column:
    hits = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return hits / F.size(a)


def simhash(sh: Column) -> Column:
    """64 characters 0 or 1: the vote of the shingles' hashes on each bit, ties to 1."""
    bits = F.transform(sh, lambda s: F.lpad(F.conv(F.substring(F.sha2(s, 256), 1, 16), 16, 2), 64, "0"))
    vote = lambda all_, p: F.aggregate(all_, F.lit(0), lambda a, b: a + F.when(F.substring(b, p, F.lit(1)) == "1", 1).otherwise(-1))
    return let(bits, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: F.when(vote(x, p) >= 0, "1").otherwise("0")), ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two bit strings, by words of 32 bits."""
    part = lambda c, i: F.conv(F.substring(c, i, 32), 2, 10).cast("long")
    return F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 33).bitwiseXOR(part(b, 33)))


def overall(cos: Column, jac: Column, mh: Column, sim: Column) -> Column:
    return cos * 0.4 + jac * 0.25 + mh * 0.2 + sim * 0.15


def cosine_bound(threshold: float) -> float:
    """The least cosine of a pair whose overall similarity reaches the threshold."""
    return max((threshold - 0.35) / 0.65, 0.0)


def cosine_pairs(items: DataFrame, bound: float) -> DataFrame:
    """(scope, a, b, cosine, jaccard): all pairs of items (scope, id, sh) of a scope with cosine >= bound.

    Lossless prefix join: with shingles ordered from rare to common, two sets
    with cosine >= t share one of the first n - ceil(t * t * n) + 1 of each. Only
    those are joined, so common shingles meet nothing; what meets is checked by
    the sets themselves.
    """
    if not 0 < bound <= 1:
        raise ValueError("the bound must be above 0: without one every pair qualifies")
    items = materialise(items, "items")
    rows = items.select("scope", "id", F.size("sh").alias("n"), F.explode("sh").alias("x"))
    df = rows.groupBy("x").agg(F.count("*").alias("df"))
    ranked = rows.join(df, "x").withColumn("r", F.row_number().over(Window.partitionBy("scope", "id").orderBy("df", "x")))
    head = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(bound * bound) * F.col("n") - 1e-9) + 1).select("scope", "id", "n", "x")
    l = head.select("scope", "x", F.col("id").alias("a"), F.col("n").alias("na"))  # noqa: E741
    r = head.select("scope", "x", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(bound * bound) * F.greatest("na", "nb") - 1e-9)
    met = l.join(r, ["scope", "x"]).where(near).select("scope", "a", "b").distinct()
    sa = items.select("scope", F.col("id").alias("a"), F.col("sh").alias("sa"))
    sb = items.select("scope", F.col("id").alias("b"), F.col("sh").alias("sb"))
    full = met.join(sa, ["scope", "a"]).join(sb, ["scope", "b"])
    out = full.select("scope", "a", "b", cosine(F.col("sa"), F.col("sb")).alias("cosine"), jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))
    return out.where(F.col("cosine") >= bound - 1e-12)


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(scope, a, b, cosine, jaccard, minhash, simhash, overall) of all pairs with overall >= threshold.

    The signatures are made for the items of pairs above the cosine bound only.
    """
    items = materialise(items, "items")
    pairs = materialise(cosine_pairs(items, cosine_bound(threshold)), "pairs")
    ids = pairs.select("scope", F.explode(F.array("a", "b")).alias("id")).distinct()
    sig = items.join(ids, ["scope", "id"], "left_semi").select("scope", "id", minhash(F.col("sh")).alias("mh"), simhash(F.col("sh")).alias("sim"))
    sig = materialise(sig, "signatures")
    a = sig.select("scope", F.col("id").alias("a"), F.col("mh").alias("ma"), F.col("sim").alias("ha"))
    b = sig.select("scope", F.col("id").alias("b"), F.col("mh").alias("mb"), F.col("sim").alias("hb"))
    full = pairs.join(a, ["scope", "a"]).join(b, ["scope", "b"]).select(
        "scope", "a", "b", "cosine", "jaccard", equal_share(F.col("ma"), F.col("mb")).alias("minhash"), (1 - hamming(F.col("ha"), F.col("hb")) / 64).alias("simhash")
    )
    return full.withColumn("overall", overall(F.col("cosine"), F.col("jaccard"), F.col("minhash"), F.col("simhash"))).where(F.col("overall") >= threshold)


STRATEGIES = ("quality", "longest", "first", "merge")


def representatives(members: DataFrame, strategy: str = "quality") -> DataFrame:
    """(group, id): of each group (group, id, quality, confidence, text, seq) the item that stays, the first of equals."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    order = {
        "quality": [(F.coalesce("quality", F.lit(0.0)) + F.coalesce("confidence", F.lit(0.0))).desc()], "longest": [F.length("text").desc()],
        "first": [], "merge": [F.length("text").desc()],
    }[strategy]
    w = Window.partitionBy("group").orderBy(*order, F.col("seq"))
    return members.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("group", "id")


def merged(members: DataFrame) -> DataFrame:
    """(group, text, quality, confidence, merged_count, topics) of each group: the longest text, means, union of topics.

    Who was merged is told by the membership table; no list of members is built.
    """
    best = F.max_by("text", F.struct(F.length("text"), -F.col("seq")))
    sums = members.groupBy("group").agg(best.alias("text"), F.avg("quality").alias("quality"), F.avg("confidence").alias("confidence"), F.count("*").alias("merged_count"))
    topics = members.select("group", F.explode("topics").alias("t")).distinct().groupBy("group").agg(F.array_sort(F.collect_list("t")).alias("topics"))
    return sums.join(topics, "group", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))

"""Mixing sources to target weights (problem 9).

Method: a tree root -> domain -> language -> source carries the weights. A
source's target share is spread over its languages in proportion to the tokens
it has in each, so a leaf is (domain, language, source). A leaf can give at most
``max_repeats`` times its tokens. What a leaf can't give is offered to its
siblings under the same language first, then to the domain's other languages,
then to the whole tree, always in proportion to the weights. From each leaf
whole epochs are taken, and of the last epoch the prefix, in a seeded order, of
which the tokens fit the budget.

The tree has one leaf per language of a source named in the targets and is the
only thing brought to the driver. Prefix sums run over seeded buckets, so no
leaf is sorted in one task, whatever its size.

Defined cases: source names compare without case and outer blanks; rows of
sources without a target or with share 0, and rows with a null source, are not
used; null and empty texts have no tokens and are not used; a null language is
a language of its own ('und'); an empty table gives an empty mix, with shares 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.tokens import VOCABULARY, token_counts
from tessera.runtime import materialise


def source_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def domain_of(source: str) -> str:
    """The first part of a source's name stands for its domain."""
    return source.split("-")[0]


def language_key(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(F.substring_index(F.regexp_replace(c, "_", "-"), "-", 1))), F.lit("")), F.lit("und"))


@dataclass
class Leaf:
    domain: str
    lang: str
    source: str
    tokens: int
    weight: float
    cap: int
    budget: float = 0.0


def _pour(leaves: list[Leaf], amount: float) -> float:
    """Give amount to the leaves by weight up to their caps; return what found no place."""
    while amount > 1e-9:
        open_ = [x for x in leaves if x.cap - x.budget > 1e-9 and x.weight > 0]
        total = sum(x.weight for x in open_)
        if not open_:
            return amount
        given = 0.0
        for x in open_:
            part = min(amount * x.weight / total, x.cap - x.budget)
            x.budget += part
            given += part
        amount -= given
    return 0.0


def budgets(leaves: list[Leaf], total: float) -> list[Leaf]:
    """Fill in the budgets: shares by weight, shortages to siblings, then up the tree."""
    weight = sum(x.weight for x in leaves)
    if not weight:
        return leaves
    groups: dict[tuple, float] = {}
    for x in leaves:
        want = total * x.weight / weight
        x.budget = min(want, x.cap)
        groups[(x.domain, x.lang)] = groups.get((x.domain, x.lang), 0.0) + want - x.budget
    domains: dict[str, float] = {}
    for (d, lang), short in groups.items():
        domains[d] = domains.get(d, 0.0) + _pour([x for x in leaves if (x.domain, x.lang) == (d, lang)], short)
    rest = 0.0
    for d, short in domains.items():
        rest += _pour([x for x in leaves if x.domain == d], short)
    _pour(leaves, rest)
    return leaves


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17,
    vocabulary: str = VOCABULARY, bucket_rows: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares reached).

    The mix has a row per use of a record: doc_id, source, lang, epoch, n_tokens.
    ``total_tokens`` is the wanted size; without it, as many tokens as the named
    sources hold once. Shares: source, target_share, reached_share, n_tokens,
    n_records, available_tokens, max_repeats.
    """
    spark = docs.sparkSession
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("reps")).where(
        "source is not null"
    ).groupBy("source").agg(F.max("share").alias("share"), F.max("reps").alias("reps"))
    wanted = F.broadcast(t.select("source"))  # grouped by source name; bounded by the targets
    meta = docs.where("text <> ''").select("doc_id", "text", source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang")).where("source is not null").join(wanted, "source")
    # only the named sources are encoded; the row's key carries what is needed after, so nothing is joined back
    keyed = meta.select(F.struct("doc_id", "source", "lang").alias("doc"), "text")
    sized = materialise(token_counts(keyed, "doc", "text", vocabulary).select("doc.doc_id", "doc.source", "doc.lang", "n").where("n > 0"), "sized")
    per_leaf = sized.groupBy("source", "lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("records"))
    rows = per_leaf.join(F.broadcast(t), "source").collect()  # one row per named source and language
    of_source: dict[str, int] = {}
    for r in rows:
        of_source[r.source] = of_source.get(r.source, 0) + r.tokens
    leaves = [
        Leaf(domain_of(r.source), r.lang, r.source, r.tokens, max(r.share or 0.0, 0.0) * r.tokens / of_source[r.source], r.tokens * max(int(r.reps or 1), 1))
        for r in rows
    ]
    budgets(leaves, float(total_tokens if total_tokens is not None else sum(x.tokens for x in leaves if x.weight > 0)))
    records = {(r.source, r.lang): r.records for r in rows}
    plan = []
    for x in leaves:
        whole, rest = divmod(int(x.budget), x.tokens)
        buckets = max(1, -(-records[(x.source, x.lang)] // bucket_rows))
        plan.append((x.source, x.lang, whole, rest, buckets))
    plan_df = spark.createDataFrame(plan, "source string, lang string, whole int, rest long, buckets int")
    placed = sized.join(F.broadcast(plan_df), ["source", "lang"])
    full = placed.where("whole > 0").select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"), F.col("n").alias("n_tokens"))
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))
    last = placed.where("rest > 0").withColumn("h", order).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    key = ["source", "lang", "bucket"]
    before = (
        last.groupBy(*key).agg(F.sum("n").alias("s"))
        .withColumn("before", F.sum("s").over(Window.partitionBy("source", "lang").orderBy("bucket")) - F.col("s"))
        .drop("s")
    )
    inside = F.sum("n").over(Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = (
        last.withColumn("upto", inside).join(before, key).where(F.col("before") + F.col("upto") <= F.col("rest"))
        .select("doc_id", "source", "lang", (F.col("whole") + 1).alias("epoch"), F.col("n").alias("n_tokens"))
    )
    mixed = full.unionByName(part)
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"))
    have = spark.createDataFrame(list(of_source.items()), "source string, available_tokens long")
    total = used.agg(F.sum("n_tokens").alias("all_tokens"))
    shares = (
        t.join(F.broadcast(have), "source", "left").join(used, "source", "left").crossJoin(F.broadcast(total))  # one row of totals
        .select(
            "source", F.col("share").alias("target_share"),
            F.round(F.coalesce(F.try_divide(F.col("n_tokens"), F.col("all_tokens")), F.lit(0.0)), 6).alias("reached_share"),
            F.coalesce("n_tokens", F.lit(0)).cast(T.LongType()).alias("n_tokens"),
            F.coalesce("n_records", F.lit(0)).cast(T.LongType()).alias("n_records"),
            F.coalesce("available_tokens", F.lit(0)).cast(T.LongType()).alias("available_tokens"),
            F.col("reps").alias("max_repeats"),
        )
    )
    return mixed, shares

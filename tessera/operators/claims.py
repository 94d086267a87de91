"""Claims against their evidence: confidence, citation findings, grounding, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import ConfidenceConfig
from tessera.functions import patterns as P
from tessera.functions import text as fx
from tessera.functions.scores import clamp
from tessera.operators import overlaps
from tessera.runtime import materialise, ship


def jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float, named: DataFrame | None = None) -> DataFrame:
    """(scope, a, b, jaccard) of left (scope, id, set) x right (scope, id, set) at or above the threshold.

    Lossless, in blocks of one scope's left rows and right rows: pairs are
    counted inside a task (overlaps.near), so only the sets are shuffled, in
    packs, never pairs that merely meet. Sets of a scope without rows on the other side stay
    out; empty sets meet nothing. ``left`` and ``right`` should be written
    tables, as they are counted first.

    named (a, b): pairs that come out whatever their similarity, if both are
    in the same scope; a column named tells them. Further columns of either side
    come out with its rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    ship(left.sparkSession)
    a, b = left.withColumnRenamed("id", "a"), right.withColumnRenamed("id", "b")
    of_a = ["scope", "a", *[c for c in a.columns if c not in ("scope", "a", "set")]]
    of_b = ["b", *[c for c in b.columns if c not in ("scope", "b", "set")]]
    n = lambda df, most: df.groupBy("scope").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    cuts = n(a, overlaps.LEFT_ROWS).withColumnRenamed("n", "na").join(n(b, overlaps.RIGHT_ROWS).withColumnRenamed("n", "nb"), "scope")
    cuts = materialise(cuts, "cuts").select(F.col("scope").alias("of"), F.col("na").alias("parts_a"), F.col("nb").alias("parts_b"))
    blocks = cuts.agg(F.coalesce(F.sum(F.col("parts_a").cast("long") * F.col("parts_b")), F.lit(0))).first()[0]
    part = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    in_scope = lambda df: df.join(cuts, F.col("scope") == F.col("of"))
    keys = ["of", "own", "others"]
    kinds = T.StructType([T.StructField("of", a.schema["scope"].dataType), T.StructField("own", T.IntegerType()), T.StructField("others", T.IntegerType()), T.StructField("pack", T.BinaryType())])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return overlaps.pack(batches, keys)

    of = lambda df, key, own, others, columns: in_scope(df).select("of", part(key, own).alias("own"), F.col(others).alias("others"), "set", *columns).mapInArrow(packs, kinds)
    rows = of(a, "a", "parts_a", "parts_b", of_a).select(F.lit(overlaps.LEFT).alias("side"), "of", F.col("own").alias("part_a"), every("others").alias("part_b"), "pack")
    rows = rows.unionByName(of(b, "b", "parts_b", "parts_a", of_b).select(F.lit(overlaps.RIGHT).alias("side"), "of", every("others").alias("part_a"), F.col("own").alias("part_b"), "pack"))
    if named is not None:
        pairs = in_scope(named.select("a", "b").join(a.select("scope", "a"), "a"))
        rows = rows.unionByName(pairs.select(F.lit(overlaps.NAMED).alias("side"), "of", part("a", "parts_a").alias("part_a"), part("b", "parts_b").alias("part_b"), "a", "b"), True)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return overlaps.block(batches, threshold, of_a, of_b)

    schema = T.StructType([*[a.schema[c] for c in of_a], *[b.schema[c] for c in of_b], T.StructField("jaccard", T.DoubleType()), T.StructField("named", T.BooleanType())])
    block = ["of", "part_a", "part_b"]
    out = rows.repartition(max(1, min(blocks, 200_000)), *block).groupBy(*block).applyInArrow(pairs_of, schema)  # a block's bytes don't tell its work
    return out if named is not None else out.drop("named")


def with_jaccard(pairs: DataFrame) -> DataFrame:
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.withColumn("jaccard", F.coalesce(F.try_divide(both.cast("double"), F.size("sa") + F.size("sb") - both), F.lit(0.0)))


def negated(c: Column) -> Column:
    return fx.matches(c, P.NEGATION)


def claim_confidence(support: DataFrame, config: ConfidenceConfig = ConfidenceConfig()) -> DataFrame:
    """(id, agreement, n_score, quality, recency, score, uncertainty, low, high) from per-claim sums.

    support: id, s (supporting), c (conflicting), q_sim (sum of quality x
    similarity), sim (sum of similarity), q_rec (sum of decayed quality), q (sum
    of quality).
    """
    s, c = F.col("s"), F.col("c")
    n = s + c
    agreement = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(s.cast("double"), n) - 0.3 * F.try_divide(c.cast("double"), n)))
    count = F.when(s == 0, 0.0).when(s >= config.most, 1.0).otherwise(F.least(F.lit(1.0), s / F.lit(float(config.least))))
    quality = F.greatest(F.lit(0.0), (F.coalesce(F.try_divide(F.col("q_sim"), F.col("sim")), F.lit(0.0)) - 0.5) / 0.5)
    recency = F.coalesce(F.try_divide(F.col("q_rec"), F.col("q")), F.lit(0.0))
    out = support.select("id", "s", "c", agreement.alias("agreement"), count.alias("n_score"), quality.alias("quality"), recency.alias("recency"))
    out = out.withColumn("score", clamp(F.col("agreement") * config.agreement + F.col("n_score") * config.count + F.col("quality") * config.quality + F.col("recency") * config.recency))
    few = F.when(n < config.least, 0.3 * (1 - n / F.lit(float(config.least)))).otherwise(0.0)
    u = F.when(n == 0, 0.5).otherwise(F.least(F.lit(0.5), few + 0.2 * F.try_divide(c.cast("double"), n) + 0.1 * (1 - 2 * F.abs(F.col("score") - 0.5))))
    out = out.withColumn("uncertainty", u)
    return out.withColumn("low", clamp(F.col("score") - 1.96 * F.col("uncertainty"))).withColumn("high", clamp(F.col("score") + 1.96 * F.col("uncertainty")))


def persona_confidence(fields: DataFrame) -> DataFrame:
    """(persona, n, weighted, least, most, overall, recommendation) of fields (persona, score, support); no field rejects."""
    w = (F.least(F.lit(1.0), F.col("support") / F.lit(3.0)) + F.col("score")) / 2
    g = fields.groupBy("persona").agg(
        F.count("score").alias("n"), F.try_divide(F.sum(F.col("score") * w), F.sum(F.when(F.col("score").isNotNull(), w))).alias("weighted"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.count_if(F.col("score") > 0.8).alias("hi"), F.count_if(F.col("score") < 0.5).alias("lo"),
    )
    overall = F.when(F.col("n") == 0, 0.0).otherwise(clamp(F.coalesce("weighted", F.lit(0.0)) * F.greatest(F.lit(0.3), F.col("least")) + 0.05 * F.try_divide(F.col("hi").cast("double"), F.col("n")) - 0.1 * F.try_divide(F.col("lo").cast("double"), F.col("n"))))
    g = g.withColumn("overall", overall)
    verdict = F.when((F.col("overall") >= 0.85) & (F.col("least") >= 0.6), "approve").when(F.col("overall") >= 0.6, "review").otherwise("reject")
    return g.withColumn("recommendation", verdict)


def calibration(points: DataFrame, bins: int = 10) -> DataFrame:
    """(centre, mean_actual, n) of points (predicted, actual) in half-open bins; empty bins are left out, 1.0 falls in none."""
    i = F.floor(F.col("predicted") * bins)
    inside = points.where((F.col("predicted") >= 0) & (F.col("predicted") < 1)).withColumn("bin", i)
    return inside.groupBy("bin").agg(F.avg("actual").alias("mean_actual"), F.count("*").alias("n")).select(((F.col("bin") + 0.5) / bins).alias("centre"), "mean_actual", "n")


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; 0 where a side doesn't vary."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    up = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    down = F.sqrt(F.greatest(F.lit(0.0), (n * F.sum(F.col(x) * F.col(x)) - sx * sx) * (n * F.sum(F.col(y) * F.col(y)) - sy * sy)))
    return F.coalesce(F.try_divide(up, F.when(down > 1e-12, down)), F.lit(0.0))


def retry_policy(spark, attempts: int = 3, confidence: float = 0.7, per_sentence: int = 1, alignment: float = 0.75) -> DataFrame:
    """(attempt, min_confidence, citations, min_alignment) of each retry."""
    n = F.col("attempt")
    return spark.range(1, attempts + 1).select(F.col("id").cast("int").alias("attempt")).select(
        "attempt", F.round(F.greatest(F.lit(confidence) - n * 0.1, F.lit(0.5)), 6).alias("min_confidence"), F.least(n + 1, F.lit(3)).alias("citations"), F.round(F.greatest(0.7 - n * 0.05, F.lit(0.6)), 6).alias("min_alignment")
    )

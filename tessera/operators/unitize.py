"""Documents cut into overlapping units at sentence ends (a generator)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fx


@dataclass(frozen=True)
class Sizes:
    least: int = 200
    most: int = 400
    overlap: int = 50
    preferred: int = 300
    reach: int = 100


def nearest(edges: list[int], at: int, reach: int, length: int, after: bool = True) -> int:
    """The edge next to ``at`` on the wanted side within reach, else the nearest within reach on
    the other side, else the end of the reach."""
    lo, hi = bisect_left(edges, at - reach), bisect_right(edges, at + reach)
    if lo == hi:
        return min(length, at + reach) if after else max(0, at - reach)
    if after:
        i = bisect_left(edges, at, lo, hi)
        return edges[i] if i < hi else edges[hi - 1]
    i = bisect_right(edges, at, lo, hi)
    return edges[i - 1] if i > lo else edges[lo]


def spans(length: int, edges: list[int], z: Sizes = Sizes()) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text of the given length with the given sentence edges."""
    if not length:
        return
    if length <= z.most:
        yield 0, length
        return
    ends = [0, length]
    at = 0
    while True:
        end = at + z.preferred
        if end >= length:
            end = length
        else:
            by_sentence, by_paragraph = nearest(edges, end, z.reach, length), nearest(ends, end, z.reach, length)
            end = by_paragraph if abs(by_paragraph - end) <= abs(by_sentence - end) else by_sentence
            if end - at > z.most:
                end = nearest(edges, at + z.most, z.reach, length, after=False)
            if end - at < z.least and end < length:
                end = nearest(edges, at + z.least, z.reach, length)
        yield at, end
        if end >= length:
            return
        nxt = nearest(edges, max(at + z.least, end - z.overlap), z.reach, length)
        at = nxt if nxt > at else end


def unitize(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(key, unit, unit_start, unit_end, unit_text) of the normalised texts.

    Normalising, edges and unit texts are built-in expressions; only the walk
    over the edges, which depends on the cut before, runs in Arrow batches of
    integers. Null, empty and blank texts have no units.
    """
    kt = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("key"), fx.normalised(F.col(text)).alias("t")).where("t <> ''")
    edges = base.select("key", "t", F.length("t").alias("n"), fx.boundaries(F.col("t")).alias("edges"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"s": s, "e": e} for s, e in spans(n, sorted(edge), sizes)] for n, edge in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], names=["key", "t", "spans"])

    cut = edges.mapInArrow(walk, f"key {kt}, t string, spans array<struct<s: int, e: int>>")
    return cut.select(F.col("key").alias(key), "t", F.posexplode("spans").alias("unit", "x")).select(
        key, "unit", F.col("x.s").alias("unit_start"), F.col("x.e").alias("unit_end"), F.substring(F.col("t"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("unit_text"), F.length("t").alias("doc_length"),
        ((F.col("x.s") == 0) | F.rlike(F.substring(F.col("t"), F.col("x.s"), F.lit(2)), F.lit("^[.!?] "))).alias("complete_start"),
        ((F.col("x.e") >= F.length("t")) | F.rlike(F.substring(F.col("t"), F.col("x.e"), F.lit(2)), F.lit("^[.!?] "))).alias("complete_end"),
    )


def findings(units: DataFrame, key: str = "doc_id", sizes: Sizes = Sizes()) -> DataFrame:
    """(key, n_units, avg_size, min_size, max_size, coverage, gaps, overlap, too_long, too_short, starts_late, ends_early)."""
    from pyspark.sql.window import Window

    prev = F.lag("unit_end").over(Window.partitionBy(key).orderBy("unit_start"))
    size = F.col("unit_end") - F.col("unit_start")
    u = units.withColumn("prev", prev).withColumn("size", size)
    return u.groupBy(key).agg(
        F.count("*").alias("n_units"), F.round(F.avg("size"), 6).alias("avg_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.round(F.sum("size") / F.max("doc_length"), 6).alias("coverage"), F.count_if(F.col("unit_start") >= F.col("prev")).alias("gaps"),
        F.coalesce(F.sum(F.greatest(F.col("prev") - F.col("unit_start"), F.lit(0))), F.lit(0)).alias("overlap"),
        F.count_if(F.col("size") > sizes.most).alias("too_long"), F.count_if(F.col("size") < sizes.least).alias("too_short"),
        (F.min("unit_start") > 0).alias("starts_late"), (F.max("unit_end") < F.max("doc_length")).alias("ends_early"),
    )


def unit_confidence(u: DataFrame) -> DataFrame:
    """units with their confidence from edges, length, sentences, word density and place."""
    n = F.length("unit_text")
    words, r = fx.word_count(F.col("unit_text")), F.length("unit_text") / F.lit(300.0)
    density, place = F.try_divide(words, n), F.try_divide(F.col("unit_start"), F.col("doc_length"))
    both, one = F.col("complete_start") & F.col("complete_end"), F.col("complete_start") | F.col("complete_end")
    score = (
        F.lit(0.5) + F.when(both, 0.3).when(one, 0.15).otherwise(0.0) + F.when(r.between(0.8, 1.2), 0.2).when(r.between(0.6, 1.5), 0.1).otherwise(0.0)
        + F.when(fx.sentence_pieces(F.col("unit_text")) >= 1, 0.25).otherwise(0.1) + F.when(density.between(0.12, 0.18), 0.15).when(density.between(0.08, 0.22), 0.07).otherwise(0.0)
        + F.when((place > 0.1) & (place < 0.9), 0.1).otherwise(0.05)
    )
    return u.withColumn("confidence", F.least(F.lit(1.0), score))

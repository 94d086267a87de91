"""Lines repeated across the pages of one site (problem 2).

Method: distributed PrefixSpan over the line sequences of each domain. Level 1
counts, for each (domain, line), the distinct pages that hold it; pages are
projected to their frequent lines, and pages with the same projection become one
sequence with a weight. From then on the projected database grows: of each
frequent prefix it keeps the suffixes that follow its first match, equal suffixes
added up; each line of a suffix, at its first place, grows the prefix, gaps
allowed; grown prefixes that enough distinct pages hold are frequent. Growth ends
where nothing is frequent any more, or at ``max_length`` if one is given: page
frames of n lines have 2^n frequent sequences, so a limit is a matter of cost.

The occurrences of all frequent sequences, single lines included, are deleted: the
lines of all frequent sequences are collected and their places on the pages come
out. A line of a frequent sequence is itself frequent on its own, so a limit of the
length changes nothing of what is deleted.

Lines compare without case, outer white space and differences in runs of white
space; domains without case, leading 'www.' and trailing dot, and where the
domain is null or blank the host of the url counts. Lines are compared by two
64-bit hashes. Counting combines before the shuffle, so a domain with a third
of all pages spreads over all tasks by its lines, and a line on all its pages
is one row a task.

Defined cases: null and empty texts have no lines; pages without domain and
host are in no domain and keep their lines; rows with a null id are ignored; of
repeated deliveries the latest counts; blank lines are neither counted nor
deleted; a line that a page holds twice counts once for it and is deleted twice,
and is an item of its sequences twice.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import broadcast_below, latest, materialise


def site(domain: Column, url: Column) -> Column:
    """The domain in one spelling, or the url's host where the domain is missing."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    own = F.nullif(F.trim(domain), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(own, host))), r"^www\.", ""), r"\.$", "")
    return F.nullif(plain, F.lit(""))


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " "))


def page_lines(sources: DataFrame) -> DataFrame:
    """(site, id, lines): of each page its non-blank lines (line_no, h1, h2)."""
    pages = latest(sources, "id", "updated_at").select("id", site(F.col("domain"), F.col("url")).alias("site"), "text_raw")
    lines = F.filter(
        F.transform(F.split("text_raw", "\n"), lambda x, i: F.struct(i.cast("int").alias("line_no"), squeezed(x).alias("t"))), lambda s: s["t"] != ""
    )
    return pages.where("site is not null and text_raw <> ''").select("site", "id", lines.alias("l")).select(
        "site", "id",
        F.transform("l", lambda s: F.struct(s["line_no"].alias("line_no"), F.xxhash64("site", s["t"]).alias("h1"), F.xxhash64(s["t"], F.lit(1), "site").alias("h2"))).alias("lines"),
    )


def frequent_lines(pages: DataFrame, support: int) -> DataFrame:
    """(h1, h2, n): lines on at least ``support`` distinct pages of their site (level 1)."""
    held = F.array_distinct(F.transform("lines", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))
    return pages.select(F.inline(held)).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def occurrences(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """(site, id, line_no, h1): the places of the frequent lines on the pages."""
    side, _ = broadcast_below(frequent.select("h1", "h2"))
    return pages.select("site", "id", F.inline("lines")).join(side, ["h1", "h2"]).select("site", "id", "line_no", "h1")


def projections(hits: DataFrame) -> DataFrame:
    """(site, items, n): the distinct sequences of frequent lines of a site's pages, with the number of pages."""
    order = F.array_sort(F.collect_list(F.struct("line_no", "h1")))
    pages = hits.groupBy("site", "id").agg(F.transform(order, lambda x: x["h1"]).alias("items"))
    return pages.groupBy("site", "items").agg(F.count("*").alias("n"))


def grown(projected: DataFrame) -> DataFrame:
    """(site, pattern, suffix, n) -> the same of the prefixes longer by one line: each distinct line of a
    suffix grows the prefix at its first place, what follows it is the new suffix; equal ones are added up."""
    first = F.array_distinct("suffix")
    at = F.col("at").cast("int")
    step = projected.select("site", "pattern", "suffix", "n", F.explode(first).alias("item")).withColumn("at", F.array_position("suffix", F.col("item")))
    rest = F.slice("suffix", at + 1, F.greatest(F.size("suffix") - at, F.lit(0)))
    return step.groupBy("site", F.concat("pattern", F.array("item")).alias("pattern"), rest.alias("suffix")).agg(F.sum("n").alias("n"))


def prefix_span(sources: DataFrame, support: int = 5, max_length: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """(occurrences, sequences).

    occurrences: (site, id, line_no) of every line in a frequent sequence, to be
    deleted. sequences: (site, length, pattern, support): every frequent sequence,
    gaps allowed, as the hashes of its lines, with the number of pages that hold it.
    Without ``max_length`` sequences of any length are found.
    """
    if max_length is not None and max_length < 1:
        raise ValueError("max_length must be at least 1")
    pages = materialise(page_lines(sources), "lines")
    frequent = materialise(frequent_lines(pages, support), "frequent")
    hits = materialise(occurrences(pages, frequent), "hits")
    projected = projections(hits).select("site", F.array().cast("array<bigint>").alias("pattern"), F.col("items").alias("suffix"), "n")
    levels: list[DataFrame] = []
    while max_length is None or len(levels) < max_length:
        projected = materialise(grown(projected), "projected")
        found = materialise(projected.groupBy("site", "pattern").agg(F.sum("n").alias("support")).where(F.col("support") >= support), "level")
        side, n = broadcast_below(found.select("site", "pattern"))
        if not n and levels:
            break
        levels.append(found.select("site", F.lit(len(levels) + 1).alias("length"), "pattern", "support"))
        projected = projected.join(side, ["site", "pattern"]).where(F.size("suffix") > 0)
    sequences = functools.reduce(DataFrame.unionByName, levels)
    lines = materialise(sequences.select(F.explode("pattern").alias("h1")).distinct(), "items")
    side, _ = broadcast_below(lines)
    return hits.join(side, "h1").select("site", "id", "line_no"), sequences


def without(sources: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_id, text): the pages without the given (id, line_no); null texts stay null."""
    pages = latest(sources, "id", "updated_at").select("id", "text_raw")
    gone = lines.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    left = F.filter(F.split("text_raw", "\n"), lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i.cast("int")))
    return pages.join(gone, "id", "left").select(F.col("id").alias("source_id"), F.array_join(left, "\n").alias("text"))

"""Passages that were cut off (problem 6).

Method: the length of every passage is taken in several encodings (code points,
UTF-8 bytes, UTF-16 units, HTML-escaped, JSON-escaped with and without ASCII,
with CR LF line ends). Grouped by each, per site and over all, a storage limit
shows as a length that far more passages with an open ending have than the lengths
around it. All endings are then inspected: the passage is found in the text it was
taken from, whatever a cut left behind is set aside, and it is cut if it stops
neither at the end of a line nor at the end of a sentence of that text. Where the
text can't tell (the passage isn't found in it, or ends with the page, which may
itself stop in mid-transfer), the limits of its site do: a passage at a limit is
cut unless its ending is closed, one that is at no limit needs a sign of a cut.

Defined cases: null and blank passages are not cut; rows with a null id are
ignored; of repeated deliveries the latest counts; a passage without source, or
not found in it, is judged by its ending; swapped, null or wrong positions are
only hints. Sources with very many passages are split over several tasks, passages
without a source stay where they are read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.sentences import MARK, Evidence, segment
from tessera.runtime import broadcast_below, materialise, parts_for, written_bytes

#: What a cut may add at the end (fixed values).
ADDED = re.compile(
    r"(?:\s*(?:\.\.\.|…|\[…\]|\[\.\.\.\]|\(\.\.\.\)|\((?:continued|more|cont\.|suite|fortsetzung|mehr|sigue|continúa)\)|\[(?:more|truncated|cut)\]|read more|�|&(?:#?\w{0,8})?|\\u?[0-9a-fA-F]{0,3}|<\w{0,6}))+\s*$", re.I
)
TERMS = ".!?。！？।؟…"
CLOSERS = "\"'”’»›)]」』】）》"
_MARK_END = re.compile(MARK + "$")
RUN_END = re.compile(r"[)）]\s*$")
LISTED = re.compile(r"^\s*(?:[-–—•*·]|\d{1,2}[.)])\s")

LENGTHS = {
    "chars": "char_length(t)",
    "utf8": "octet_length(t)",
    "utf16": "octet_length(encode(t, 'UTF-16BE')) div 2",
    "html": "char_length(t) + 4 * regexp_count(t, '[&\\']') + 3 * regexp_count(t, '[<>]') + 5 * regexp_count(t, '\"')",
    "html_utf8": "octet_length(t) + 4 * regexp_count(t, '[&\\']') + 3 * regexp_count(t, '[<>]') + 5 * regexp_count(t, '\"')",
    "json": "char_length(t) + regexp_count(t, '[\"\\\\\\\\\\n\\r\\t]')",
    "json_ascii": "char_length(t) + regexp_count(t, '[\"\\\\\\\\\\n\\r\\t]') + 5 * regexp_count(t, '[^\\\\x00-\\\\x7F]')",
    "crlf": "char_length(t) + regexp_count(t, '\\n')",
}


def with_lengths(units: DataFrame) -> DataFrame:
    """units (…, t) with a column lengths: (measure, length) in every encoding."""
    parts = ", ".join(f"struct('{k}' as measure, cast({v} as int) as length)" for k, v in LENGTHS.items())
    return units.withColumn("lengths", F.expr(f"array({parts})"))


#: An ending without closing mark, or with one that a cut adds.
OPEN = r"[^.!?。！？।؟\"'”’»›)\]」』】）》]$|\.\.\.$|…$"


def length_counts(units: DataFrame) -> DataFrame:
    """(site, measure, length, n): passages with an open ending by length, for each site and (site null) over all."""
    each = units.where(F.rtrim("t").rlike(OPEN)).select(F.explode(F.array_distinct(F.array(F.col("site"), F.lit(None).cast("string")))).alias("site"), "lengths")
    return each.select("site", F.inline("lengths")).groupBy("site", "measure", "length").agg(F.count("*").alias("n"))


def storage_limits(counts: DataFrame, chance: float = 0.01, around: int = 15) -> DataFrame:
    """(site, measure, length, n): lengths that stand out from those around them.

    With m passages a length expected from the ``around`` lengths on each side,
    so many as n at one length must have a probability (Poisson, Chernoff's
    bound) of at most ``chance`` over all lengths, measures and sites that are
    tried. Nothing else depends on the size of the tables. ``counts`` has a row
    per site, measure and length, whatever the number of passages.
    """
    tried = max(1, counts.count())
    w = Window.partitionBy("site", "measure").orderBy("length").rangeBetween(-around, around)
    n = F.col("n")
    m = (F.sum("n").over(w) - n + 1) / (2.0 * around)
    near = counts.withColumn("m", m)
    return near.where((n > F.col("m")) & (n - F.col("m") - n * F.log(n / F.col("m")) <= math.log(chance / tried))).select("site", "measure", "length", "n")


def closed(text: str, end: int) -> bool:
    """Whether text[:end] ends with a closing mark, quotes, brackets and evidence marks after it."""
    while end:
        c = text[end - 1]
        if c == "]" and (k := text.rfind("[evidence_", 0, end)) >= 0 and _MARK_END.match(text, k, end):
            end = k
        elif c in CLOSERS or c.isspace():
            end -= 1
        else:
            return c in TERMS
    return False


def longest(n: int, there) -> int:
    """The greatest k up to n for which there(k); what holds for k holds for less."""
    if there(n):
        return n
    low, high = 0, n
    while low < high - 1:
        mid = (low + high) // 2
        if there(mid):
            low = mid
        else:
            high = mid
    return low


class Page:
    """A source text with the ends of its lines in blank-normalised positions."""

    def __init__(self, raw: str | None):
        self.lines, self.starts, at = [], [], 0
        for line in (raw or "").split("\n"):
            if norm := " ".join(line.split()):
                self.lines.append(norm)
                self.starts.append(at)
                at += len(norm) + 1
        self.text = " ".join(self.lines)
        self.ends = [s + len(x) for s, x in zip(self.starts, self.lines)]
        self._cuts: dict[int, set[int]] = {}
        self._known: Evidence | None = None

    def place(self, s: str, *hints: int | None) -> tuple[int, int]:
        """(start, n): the longest begin of s that the page holds, at a hint if it is there; n characters of s."""
        for x in hints:
            if x is not None and 0 <= x < len(self.text) and self.text.startswith(s, x):
                return x, len(s)
        n = longest(len(s), lambda k: s[:k] in self.text)
        for x in hints:
            if n and x is not None and 0 <= x < len(self.text) and self.text.startswith(s[:n], x):
                return x, n
        return self.text.find(s[:n]), n

    def stop(self, s: str, *hints: int | None) -> int | None:
        """Where in the page s stops, without what a cut adds; None if s isn't from the page.

        Where the page and s part, and what follows is no addition, the longest end of s that the page
        holds further on decides, if it has a few words: s was changed inside.
        """
        start, n = self.place(s, *hints)
        body = ADDED.sub("", s)
        if n >= len(body) and n:
            return start + (n if n == len(s) else len(body))
        k = longest(len(body), lambda k: self.text.find(body[len(body) - k :], start) >= 0)
        end = body[len(body) - k :]
        if k > n or end.count(" ") > 3:
            return self.text.find(end, start) + k
        return start + n if 2 * n > len(s) else None

    def complete(self, e: int) -> bool | None:
        """Whether position e ends a line or a sentence; None at the end of the page."""
        while e and self.text[e - 1 : e] == " ":
            e -= 1
        i = bisect_left(self.ends, e)
        if i >= len(self.ends):
            return None
        if e == self.ends[i]:
            return None if i == len(self.ends) - 1 else True
        at = e - self.starts[i]
        if at <= 0:
            return True
        line = self.lines[i]
        if not closed(line, at):
            return False
        if i not in self._cuts:
            if self._known is None:
                self._known = Evidence(self.text)
            self._cuts[i] = {b for _, b in segment(line, ev=self._known)}
        return at in self._cuts[i]


_NO_END = re.compile(r"(?:^|\s)(?:\S{0,3}\d|Dr|Mr|Mrs|No|Nr)\.$")


def ending_complete(s: str, at_limit: bool) -> bool:
    """Judged by the passage alone: a closing mark, or a run or list line that closes and is at no limit."""
    body = ADDED.sub("", s)
    if body != s and not closed(body, len(body)):
        return False
    if closed(s, len(s)):
        return not _NO_END.search(s)
    return bool(RUN_END.search(s)) or bool(LISTED.match(s)) and not at_limit


def is_cut(s: str, a: int | None, b: int | None, page: Page | None, at_limit: bool) -> bool:
    t = " ".join(s.split())
    if page is not None and page.text:
        stop = page.stop(t, a, b)
        if stop is None and (plain := " ".join(html.unescape(t).split())) != t:
            stop, t = page.stop(plain, a, b), plain
        if stop is not None:
            done = page.complete(stop)
            if done is not None:
                return not done
            last = page.lines[-1]
            if closed(last, len(last)) or RUN_END.search(last):
                return False
            if LISTED.match(last):
                return at_limit or last.count("(") + last.count("（") > last.count(")") + last.count("）")
            return True
    return not ending_complete(t, at_limit)


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (source, salt, side): the page first, then its passages -> (id, source, cut, at a limit)."""
    key, page = None, None
    for batch in batches:
        ids, sources, cuts, hits = [], [], [], []
        for src, salt, side, id_, text, a, b, hit in zip(*(c.to_pylist() for c in batch.columns)):
            if (src, salt) != key:
                key, page = (src, salt), None
            if side == 0:
                page = Page(text)
                continue
            ids.append(id_)
            sources.append(src)
            cuts.append(is_cut(text, a, b, page, bool(hit)))
            hits.append(bool(hit))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sources, pa.string()), pa.array(cuts, pa.bool_()), pa.array(hits, pa.bool_())], names=["id", "source_id", "cut", "at_limit"])


def with_limits(measured: DataFrame) -> DataFrame:
    """measured with hit: whether a length of the passage is a storage limit of its site or of all sites.

    The limits, a few numbers a site, come to the passages by their site.
    """
    found = materialise(storage_limits(materialise(length_counts(measured), "counts")), "limits")
    spot = F.collect_list(F.struct("measure", "length"))
    own, _ = broadcast_below(materialise(found.where("site is not null").groupBy("site").agg(spot.alias("own")), "own"))
    every = F.broadcast(found.where("site is null").agg(spot.alias("every")))  # one row, of at most a few lengths a measure
    met = lambda c: F.coalesce(F.arrays_overlap("lengths", c), F.lit(False))
    return measured.join(own, "site", "left").crossJoin(every).withColumn("hit", met("own") | met("every")).drop("own", "every", "lengths")


def inspect(units: DataFrame, sources: DataFrame, hot: int = 50_000) -> DataFrame:
    """(id, source_id, cut, at_limit) of units (id, source_id, site, t, a, b) with text; sources (id, text)."""
    units = units.where("id is not null and t is not null and trim(t) <> ''").select("id", "source_id", "site", "t", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    measured = materialise(with_limits(with_lengths(units)), "measured")
    crowded = measured.groupBy("source_id").agg(F.ceil(F.count("*") / hot).cast("int").alias("split")).where("split > 1")
    crowded, _ = broadcast_below(materialise(crowded, "crowded"))
    split = F.coalesce("split", F.lit(1))
    mine = ["source_id", "salt", "side", "id", "text", "a", "b", "hit"]
    known, alone = measured.where("source_id is not null"), measured.where("source_id is null")
    u = known.join(crowded, "source_id", "left").select("source_id", F.pmod(F.xxhash64("id"), split).cast("int").alias("salt"), F.lit(1).alias("side"), "id", F.col("t").alias("text"), "a", "b", "hit")
    p = (
        sources.where("id is not null").select(F.col("id").alias("source_id"), "text").join(crowded, "source_id", "left")
        .select("source_id", F.explode(F.sequence(F.lit(0), split - 1)).alias("salt"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("id"), "text",
                F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("boolean").alias("hit"))
    )
    n = parts_for(units.sparkSession, 16 * written_bytes(measured))  # passages and their pages, packed files holding about a quarter
    both = u.unionByName(p).repartition(n, "source_id", "salt").sortWithinPartitions("source_id", "salt", "side")
    out = "id string, source_id string, cut boolean, at_limit boolean"
    rest = alone.select("source_id", F.lit(0).alias("salt"), F.lit(1).alias("side"), "id", F.col("t").alias("text"), "a", "b", "hit").select(*mine)
    return both.select(*mine).mapInArrow(_inspect, out).unionByName(rest.mapInArrow(_inspect, out))


def shares(inspected: DataFrame) -> DataFrame:
    """(source_id, n_units, n_cut, n_at_limit, share) of each source."""
    return inspected.groupBy("source_id").agg(F.count("*").alias("n_units"), F.count_if("cut").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit")).withColumn("share", F.round(F.col("n_cut") / F.col("n_units"), 6))

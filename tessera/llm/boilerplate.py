"""Main content of web pages by inferred site wrappers (problem 4).

Method: union-free regular-expression inference over the line streams of each
host, in three steps. Lines are read as tokens, with numbers and the site's own
name as text slots; a second token has runs of capitalised words as slots too.

Support. A token can only align with other pages if it stands on them, and belongs
to the frame only if it stands on a large part (``FIXED``) of the pages: of its
sites together, each site counting by its pages, but by ``WEIGHT`` at most, so that
a site of one page is read by the frames of the others; or surely (``SURE``) of the
own site's, and then for this site only. Headings that articles share stand on
many sites, but on few pages of each, and stay text.

Alignment. The streams of a host's pages are folded into one expression: the
tokens both sides have in the same order (a longest common subsequence) are
matched; a token that one side lacks becomes optional; one that a page repeats
becomes repeated; one that stands elsewhere keeps its place and is counted as
moved; what matches nothing is a text slot after the token before it. Each task
folds its own pages, and the partial expressions of a host, small and one a task,
are aligned with each other in a tree, so a host with a third of all pages is no
single task. A slot in which several title-like lines stand page after page is a
repeated group (teasers); by the host's own pages, or by those of all hosts where
it has few. A rarer line that nearly wherever it stands is in a gap of at most
``GAP`` lines between tokens is an optional group of its host.

Matching. Each page is aligned with its host's expression. What is matched is frame,
as is what stands in repeated and optional groups. A token out of its place is text
if it surely keeps its place on the host's pages (all but ``MOVES`` of them). The article is what lies in the text slots,
without user comments and notes on authors.

Defined cases: null and empty texts have no line; rows with a null id are
ignored; of repeated deliveries the latest counts; pages without domain and host
are aligned as one site; blank lines belong to nothing; a page whose slots are
empty has no article.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import site
from tessera.runtime import broadcast_below, latest, materialise

#: Share of the pages of its sites on which a wrapper token stands at least.
FIXED = 0.32
#: Pages that a site counts for at most where sites are pooled.
WEIGHT = 50
#: Standard deviations by which the own site's share must be known to decide for it; as many as for a test of each line of each site.
SURE = 4.0
#: Lines between fixed tokens up to which a gap can be an optional group.
GAP = 3

_U = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_CLOSED = re.compile(r"[.!?。！？…:：][\"”’»›)\]」』）]*$")
_LIST = re.compile(r"^\s*(?:[-–—•*·▪‣]|\(?\d{1,2}[.)])\s")
_CAPS = re.compile(rf"(?<![\w@])[{_U}][\w’'-]*")
_USER = re.compile(r"^\s*[^\W\d_][\w.-]*\d+\s?[:：]\s")
_NOTE = re.compile(rf"^\s*[{_U}][\w’'-]+(?: [{_U}]\.)* [{_U}][\w’'-]+ ?[:：] \S.*$")
_ORG = re.compile(r"\b(?:Works|Institute)\s*[:：]")
_INNER = re.compile(r"[^\W\d_A-Z]{3}[.!?][\"”»“]? \S|[。！？].")
_DATA = re.compile(r"[(（][^()（）]*[,、][^()（）]*[)）]$")
_SEP = re.compile(r"\s*[·|>/｜»•]\s*")

#: Characters of scripts without blanks: about three make a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")

OPEN, PROSE, LIST, RUN, USER, NOTE, TITLE = range(7)
#: Elements of every expression: the begin of the page, and a line of menu entries in any order.
BEGIN, MENU = 0, 1
#: Share of its pages on which an element may be out of its place to be held to it.
MOVES = 0.02
#: Occurrences that a site needs for its own evidence on a slot.
OWN = 8


def hashed(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def site_words(host: str | None) -> str:
    parts = (host or "").split(".")
    return (parts[-2] if len(parts) > 1 else parts[0]).replace("-", " ")


def token(line: str, name: str) -> str:
    """The line with numbers and the site's name as slots."""
    t = re.sub(r"\d+", "#", " ".join(line.lower().split()))
    return t.replace(name, "@") if name else t


def loose(line: str, name: str) -> str:
    """The line with runs of capitalised words as slots too; a leading label keeps its word."""
    t = " ".join(line.split())
    if name:
        t = re.sub(re.escape(name), "@", t, flags=re.I)
    m = re.match(r"[\w ]{1,20} ?[:：]", t)
    if t.isupper() and not m:  # capitals hide the names: take them by their place
        words = t.split()
        t = "*, @" if t.endswith(", @") else "*" + t[t.rindex(",") :] if "," in t else " ".join(["*", *words[2:]])
        return re.sub(r"\d+", "#", t.lower())
    head, rest = (m.group(), t[m.end() :]) if m and " " not in m.group().rstrip(" :：") else ("", t)
    rest = re.sub(r"\*(?: \*)+", "*", _CAPS.sub("*", rest))
    return re.sub(r"\d+", "#", (head + rest).lower())


def loosely(line: str, name: str) -> int | None:
    """The hash of the loose token; None if nothing but slots is left of the line."""
    t = loose(line, name)
    return hashed("~" + t) if re.search(r"[^\W\d_]|@", t) else None


def kind_of(line: str, title: str) -> int:
    t = " ".join(line.split())
    if title and t.lower() == title:
        return TITLE
    if _USER.match(t):
        return USER
    if _LIST.match(t):
        return LIST
    if _NOTE.match(t) and not _ORG.match(t) and _CLOSED.search(t):
        return NOTE
    if _DATA.search(t) or t.count(", ") >= 2 or t.count("、") >= 3 or max(map(len, t.split())) > 40 and t.isascii():
        return PROSE if _CLOSED.search(t) else RUN
    return PROSE if _CLOSED.search(t) or len(t) > 120 or _INNER.search(t) else OPEN


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, id, title, text) -> of each page its lines: number, kind, hashes of token, loose token, parts."""
    line = pa.struct([("line_no", pa.int32()), ("kind", pa.int8()), ("words", pa.int16()), ("token", pa.int64()), ("loose", pa.int64()), ("parts", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for host, title, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            name, head = site_words(host), " ".join((title or "").lower().split())
            rows = []
            for i, raw in enumerate((text or "").split("\n")):
                if not raw.strip():
                    continue
                words = len(raw.split())
                kind = kind_of(raw, head)
                parts = [p for p in _SEP.split(" ".join(raw.lower().split())) if p] if kind == OPEN or words <= 12 else []
                if len(parts) == 1 and 3 <= words <= 24 and kind == OPEN:
                    parts = parts[0].split()
                rows.append({
                    "line_no": i, "kind": kind, "words": min(words + len(_UNSPACED.findall(raw)) // 3, 999), "token": hashed(token(raw, name)),
                    "loose": hashed("user") if kind == USER else loosely(raw, name) if words <= 7 else None,
                    "parts": [hashed(p) for p in parts] if len(parts) > 1 else [],
                })
            out.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(line))], names=["site", "id", "lines"])


LINES = "site string, id string, lines array<struct<line_no: int, kind: tinyint, words: smallint, token: bigint, loose: bigint, parts: array<bigint>>>"


def page_tokens(sources: DataFrame) -> DataFrame:
    pages = latest(sources, "id", "updated_at").select(F.coalesce(site(F.col("domain"), F.col("url")), F.lit("")).alias("site"), F.col("id").cast("string"), "title", F.col("text_raw").alias("text"))
    return pages.where("text is not null and text <> ''").mapInArrow(_tokens, LINES)


def alignment(pages: DataFrame) -> DataFrame:
    """(token, round, n, sites, share, kind, words, own): tokens on at least 3 pages with their share of their sites' pages.

    own lists the sites whose own pages suffice to call the token fixed (the lower
    Wilson bound of its share there).
    """
    size = pages.groupBy("site").agg(F.count("*").alias("pages"))
    each = pages.select("site", F.explode(F.array_distinct(F.concat(
        F.transform("lines", lambda x: F.struct(x["token"].alias("token"), F.lit(0).alias("round"), x["kind"].alias("kind"), x["words"].alias("words"))),
        F.transform(F.filter("lines", lambda x: x["loose"].isNotNull()), lambda x: F.struct(x["loose"].alias("token"), F.lit(1).alias("round"), x["kind"].alias("kind"), x["words"].alias("words"))),
    ))).alias("t"))
    per_site = each.groupBy("site", "t.token", "t.round").agg(F.count("*").alias("n"), F.max("t.kind").alias("kind"), F.max("t.words").alias("words"))
    joined = per_site.join(size, "site").withColumn("weight", F.least("pages", F.lit(WEIGHT)))
    n, m, z2 = F.col("n"), F.col("pages"), SURE * SURE
    low = (n + z2 / 2 - SURE * F.sqrt(n * (m - n) / m + z2 / 4)) / (m + z2)
    own = F.collect_list(F.when((low >= FIXED) & (n >= F.when(F.col("round") == 0, 5).otherwise(8)), F.col("site")))
    return (
        joined.groupBy("token", "round").agg(F.sum("n").alias("n"), F.count("*").alias("sites"), (F.sum(n / m * F.col("weight")) / F.sum("weight")).alias("share"), F.max("kind").alias("kind"), F.max("words").alias("words"), own.alias("own"))
        .where("n >= 3")
    )


def wrapper_tokens(aligned: DataFrame) -> DataFrame:
    """(token, at, role): role 1 for fixed tokens, 2 for headings that articles share; at is the only site it holds for, or null.

    A long line must stand on two sites or five pages: copies of an article are
    no wrapper. A loosely aligned line needs five pages on two sites, or eight.
    """
    fixed = F.col("share") >= FIXED
    exact = (F.col("round") == 0) & fixed & ((F.col("words") < 12) | (F.col("sites") >= 2) | (F.col("n") >= 5))
    slots = (F.col("round") == 1) & fixed & (((F.col("sites") >= 2) & (F.col("n") >= 5)) | (F.col("n") >= 8))
    heading = (F.col("round") == 0) & ~fixed & (F.col("sites") >= 5) & (F.col("words") <= 5) & (F.col("kind") == OPEN)
    role = F.when(exact | slots, 1).when(heading, 2)
    every = aligned.select("token", F.lit(None).cast("string").alias("at"), role.cast("tinyint").alias("role")).where("role is not null")
    own = aligned.where(~F.coalesce(role == 1, F.lit(False))).select("token", F.explode("own").alias("at"), F.lit(1).cast("tinyint").alias("role"))
    return every.unionByName(own).distinct()


def known_lines(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, roles): of each page's lines that hold a wrapper token: the role, whether the exact token has it, whether most entries of a menu line have it."""
    side, _ = broadcast_below(tokens)
    one = lambda k, of: F.struct(k.alias("k"), F.lit(of).alias("of"))
    keys = F.filter(F.concat(F.array(one(F.col("x.token"), 1), one(F.col("x.loose"), 2)), F.transform(F.coalesce("x.parts", F.array().cast("array<bigint>")), lambda k: one(k, 0))), lambda y: y["k"].isNotNull())
    seen = pages.select("site", "id", F.explode("lines").alias("x")).select("site", "id", "x.line_no", F.size("x.parts").alias("entries"), F.explode(keys).alias("y")).select("site", "id", "line_no", "entries", "y.k", "y.of")
    hit = seen.join(side.withColumnRenamed("token", "k"), "k").where("at is null or at = site")
    fixed = F.col("role") == 1
    roles = hit.groupBy("id", "line_no").agg(
        F.max(F.when(F.col("of") > 0, F.when(fixed, 9).otherwise(F.col("role")))).alias("role"),
        F.coalesce(F.bool_or((F.col("of") == 1) & fixed), F.lit(False)).alias("exact"),
        ((F.max("entries") >= 2) & (F.count_if((F.col("of") == 0) & fixed) >= 0.8 * F.max("entries"))).alias("menu"),
    )
    return roles.groupBy("id").agg(F.collect_list(F.struct("line_no", "role", "exact", "menu")).alias("roles"))


def stream(lines: list[dict], roles: list[dict] | None) -> list[dict]:
    """The lines in order with fixed / heading flags and the key of their element."""
    by = {r["line_no"]: r for r in roles or ()}
    lines.sort(key=lambda x: x["line_no"])
    for x in lines:
        x["fixed"] = x["heading"] = False
        x["key"] = None
        if r := by.get(x["line_no"]):
            if x["kind"] != TITLE and (r["role"] == 9 or r["menu"] and x["kind"] in (OPEN, RUN)):
                x["fixed"] = True
                x["key"] = MENU if r["role"] != 9 else x["token"] if r["exact"] else x["loose"]
            else:
                x["heading"] = r["role"] == 2
    return lines


def title_like(x: dict) -> bool:
    return not x["fixed"] and not x["heading"] and x["kind"] in (OPEN, TITLE)


def in_order(places: list[int]) -> list[int]:
    """The indexes of a longest increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        if k:
            before[i] = last[k - 1]
        if k == len(ends):
            ends.append(p)
            last.append(i)
        else:
            ends[k], last[k] = p, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


#: What an element counts: pages that have it, that repeat it, on which it moved; its occurrences, those before
#: title-like lines, the number of these lines; pages with text after it.
STATS = ("count", "again", "moved", "seen", "open", "run", "text")
ELEMENTS = "array<struct<key: bigint, " + ", ".join(f"{c}: bigint" for c in STATS) + ", id: string, line_no: int>>"
_ELEMENT = pa.struct([("key", pa.int64()), *((c, pa.int64()) for c in STATS), ("id", pa.string()), ("line_no", pa.int32())])


class Expression:
    """The wrapper of a host: elements in order, each with its counts and the place of one occurrence."""

    def __init__(self):
        self.pages = 0
        self.keys: list[int] = []
        self.at: dict[int, int] = {}
        self.counts: dict[int, list] = {}

    def merge(self, keys: list[int], counts: dict[int, list], pages: int) -> None:
        """Align with another expression: elements in the same order match, the others are kept in between."""
        common = [i for i, k in enumerate(keys) if k in self.at]
        matched = {common[i] for i in in_order([self.at[keys[i]] for i in common])}
        after: dict[int, list[int]] = {}
        place = -1
        for i, k in enumerate(keys):
            new = counts[k]
            if k not in self.at:
                after.setdefault(place, []).append(k)
                self.counts[k] = list(new)
                continue
            old = self.counts[k]
            for j in range(len(STATS)):
                old[j] += new[j]
            if new[7:] < old[7:]:
                old[7:] = new[7:]
            if i in matched:
                place = self.at[k]
            else:
                old[2] += new[0]
        if after:
            order = after.get(-1, [])
            for p, k in enumerate(self.keys):
                order.append(k)
                order += after.get(p, ())
            self.keys = order
            self.at = {k: p for p, k in enumerate(order)}
        self.pages += pages

    def add_page(self, id_: str, s: list[dict]) -> None:
        keys, counts = [BEGIN], {BEGIN: [1, 0, 0, 1, 0, 0, 0, id_, -1]}
        here, i, n = counts[BEGIN], 0, len(s)
        while True:
            j = i
            while j < n and title_like(s[j]):
                j += 1
            here[4] += j > i
            here[5] += j - i
            while j < n and not s[j]["fixed"]:
                j += 1
            here[6] |= j > i
            if j == n:
                break
            x = s[j]
            here = counts.get(x["key"])
            if here is None:
                keys.append(x["key"])
                here = counts[x["key"]] = [1, 0, 0, 0, 0, 0, 0, id_, x["line_no"]]
            else:
                here[1] = 1
            here[3] += 1
            i = j + 1
        self.merge(keys, counts, 1)

    def rows(self) -> list[dict]:
        names = ("key", *STATS, "id", "line_no")
        return [dict(zip(names, (k, *self.counts[k]))) for k in self.keys]

    def add_rows(self, rows: list[dict], pages: int) -> None:
        self.merge([r["key"] for r in rows], {r["key"]: [*(r[c] for c in STATS), r["id"], r["line_no"]] for r in rows}, pages)


FOLDED = f"site string, part long, pages long, elements {ELEMENTS}, token long, seen long"


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(_ELEMENT), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["site", "part", "pages", "elements", "token", "seen"])


def _fold(held: int = 200_000):
    """(site, id, lines, roles) -> a partial expression for each site of the task, and the number of pages (token
    set) on which a line that is no token stands in a short gap. What is held is passed on beyond ``held`` elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        sites: dict[str, Expression] = {}
        for batch in batches:
            gaps: dict[tuple, int] = {}
            for site_, id_, lines, roles in zip(*(c.to_pylist() for c in batch.columns)):
                s = stream(lines, roles)
                fixed = [-1, *(i for i, x in enumerate(s) if x["fixed"]), len(s)]
                for t in {x["token"] for a, b in zip(fixed, fixed[1:]) if 1 < b - a <= GAP + 1 and b - a <= len(s) for x in s[a + 1 : b] if not x["heading"] and x["kind"] != TITLE}:
                    gaps[site_, t] = gaps.get((site_, t), 0) + 1
                e = sites.get(site_)
                if e is None:
                    e = sites[site_] = Expression()
                e.add_page(id_, s)
            if gaps:
                yield _folded([(k[0], None, None, None, k[1], n) for k, n in gaps.items()])
            if sum(len(e.keys) for e in sites.values()) > held:
                yield _folded([(k, part, e.pages, e.rows(), None, None) for k, e in sites.items()])
                sites = {}
        if sites:
            yield _folded([(k, part, e.pages, e.rows(), None, None) for k, e in sites.items()])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial expressions (site, part, pages, elements) sorted by site and part -> one for each."""
    now, e = None, Expression()
    for batch in batches:
        out = []
        for site_, part, pages, elements in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (site_, part) != now:
                if now:
                    out.append((*now, e.pages, e.rows(), None, None))
                now, e = (site_, part), Expression()
            e.add_rows(elements, pages)
        if out:
            yield _folded(out)
    if now:
        yield _folded([(*now, e.pages, e.rows(), None, None)])


def expressions(folded: DataFrame, fan: int = 64) -> DataFrame:
    """(site, pages, elements): one expression a site, its partial ones aligned ``fan`` at a time and those again."""
    e = folded.where("elements is not null")
    parts = (e.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        up = F.floor(F.col("part") / fan) if parts > fan else F.lit(0).cast("long")
        first = F.element_at("elements", 1)["id"]
        e = e.select("site", up.alias("part"), "pages", "elements", first.alias("first")).repartition("site", "part").sortWithinPartitions("site", "part", "first")
        e = materialise(e.select("site", "part", "pages", "elements").mapInArrow(_merge, FOLDED), "expressions")
        if parts <= fan:
            return e.select("site", "pages", "elements")
        parts = -(-parts // fan)


def with_slots(expressions: DataFrame) -> DataFrame:
    """(site, pages, elements, groups): groups are the elements after which a repeated group stands.

    Title-like lines follow nearly always, and several: by the site's own pages, or where the element stands
    less than ``OWN`` times there, by those of all sites.
    """
    one = expressions.select("site", F.explode("elements").alias("x")).select("site", "x.key", "x.seen", "x.open", "x.run").where(F.col("key") != BEGIN)
    every = one.groupBy("key").agg(*(F.sum(c).alias("all_" + c) for c in ("seen", "open", "run")))
    opens = lambda p: (F.col(p + "open") >= 0.8 * F.col(p + "seen")) & (F.col(p + "run") >= 1.6 * F.col(p + "seen"))
    known = one.join(every, "key").where(F.when(F.col("seen") >= OWN, opens("")).otherwise((F.col("all_seen") >= 3) & opens("all_")))
    groups = known.groupBy("site").agg(F.collect_list("key").alias("groups"))
    return expressions.join(groups, "site", "left").select("site", "pages", "elements", F.coalesce("groups", F.array().cast("array<bigint>")).alias("groups"))


def optional_groups(known: DataFrame, folded: DataFrame) -> DataFrame:
    """(id, optional): of each page the lines that nearly always stand in a short gap of their site's wrapper, on 5 pages at least."""
    total = folded.where("token is not null").groupBy("site", "token").agg(F.sum("seen").alias("seen")).where("seen >= 5")
    gaps, _ = broadcast_below(materialise(total, "followers"))
    held = materialise(known.select("site", "id", F.explode(F.array_distinct("lines.token")).alias("token")).join(gaps, ["site", "token"]), "gaps")
    kept, _ = broadcast_below(materialise(held.groupBy("site", "token", "seen").agg(F.count("*").alias("n")).where("seen >= 0.9 * n").select("site", "token"), "optional"))
    return held.join(kept, ["site", "token"]).groupBy("id").agg(F.collect_set("token").alias("optional"))


class Wrapper:
    """A host's expression, ready to be matched: places of its elements, those that move, those that open groups."""

    def __init__(self, keys: list[int], moved: list[bool], groups: list[int]):
        self.at = {k: i for i, k in enumerate(keys)}
        self.floating = {k for k, m in zip(keys, moved) if m}
        self.groups = set(groups)

    def match(self, s: list[dict]) -> None:
        """Take the fixed mark from the lines that are out of their place though they surely keep it elsewhere."""
        fixed = [x for x in s if x["fixed"]]
        known = [x for x in fixed if x["key"] in self.at and x["key"] not in self.floating]
        first: dict[int, dict] = {}
        for x in known:
            first.setdefault(x["key"], x)  # repetitions go with the first
        line = list(first.values())
        kept = {line[i]["key"] for i in in_order([self.at[x["key"]] for x in line])}
        for x in known:
            if x["key"] not in kept:
                x["fixed"] = False


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lines, roles, optional, site, keys, moved, groups) -> (source_id, line_no) of the article's lines."""
    known: dict[str, Wrapper] = {}
    for batch in batches:
        ids, nos = [], []
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for n, (id_, lines, roles, optional, site_) in enumerate(zip(*cols)):
            w = known.get(site_)
            if w is None:
                if len(known) > 2_000:
                    known.clear()
                w = known[site_] = Wrapper(*(batch.column(i)[n].as_py() or [] for i in (5, 6, 7)))
            extra = set(optional or ())
            s = stream(lines, roles)
            w.match(s)
            inside = False
            for x in s:
                if x["fixed"]:
                    inside = x["key"] in w.groups
                elif x["token"] in extra and x["kind"] != TITLE or inside and title_like(x) and x["kind"] != TITLE:
                    pass  # an optional group, or an element of the repeated group
                else:
                    inside = False
                    if x["kind"] not in (USER, NOTE):
                        ids.append(id_)
                        nos.append(x["line_no"])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32())], names=["source_id", "line_no"])


def _inferred(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages with the roles of their lines, folded, expressions with slots)."""
    pages = materialise(page_tokens(sources), "tokens")
    tokens = materialise(wrapper_tokens(alignment(pages)), "wrapper")
    slim = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["kind"].alias("kind"), x["token"].alias("token"), x["loose"].alias("loose")))
    known = materialise(pages.join(known_lines(pages, tokens), "id", "left").select("site", "id", slim.alias("lines"), "roles"), "known")
    folded = materialise(known.select("site", "id", "lines", "roles").mapInArrow(_fold(), FOLDED), "folded")
    return known, folded, materialise(with_slots(expressions(folded)), "slots")


def _at_most(m: Column, n: Column) -> Column:
    """The upper Wilson bound of m / n."""
    z2 = SURE * SURE
    return (m + z2 / 2 + SURE * F.sqrt(m * (n - m) / n + z2 / 4)) / (n + z2)


def article_lines(sources: DataFrame) -> DataFrame:
    """(source_id, line_no) of the non-blank lines of each page's article."""
    known, folded, inferred = _inferred(sources)
    moves = F.transform("elements", lambda x: _at_most(x["moved"], x["count"]) > MOVES)
    slim, _ = broadcast_below(inferred.select("site", F.col("elements.key").alias("keys"), moves.alias("moved"), "groups"))
    rows = known.join(optional_groups(known, folded), "id", "left").join(slim, "site")
    return rows.select("id", "lines", "roles", "optional", "site", "keys", "moved", "groups").mapInArrow(_label, "source_id string, line_no int")


def wrappers(sources: DataFrame) -> DataFrame:
    """(site, pages, wrapper): each site's wrapper as a union-free expression, as article_lines matches it.

    Elements stand in the order of the alignment, each as one of its lines; ``( )?`` is one that some
    pages lack, ``( )+`` one that a page repeats, ``#TEXT`` a text slot, ``(#TEXT)+`` a repeated group.
    """
    _, _, inferred = _inferred(sources)
    e = inferred.select("site", "pages", "groups", F.posexplode("elements").alias("at", "x")).select("site", "pages", "at", "x.*", F.array_contains("groups", F.col("x.key")).alias("opens"))
    e = materialise(e, "elements")
    text = latest(sources, "id", "updated_at").select(F.col("id").cast("string").alias("id"), F.col("text_raw").alias("t"))
    named = e.join(text, "id", "left").withColumn("word", F.when(F.col("key") == BEGIN, "").otherwise(F.trim(F.split("t", "\n")[F.col("line_no")])))
    part = F.when(F.col("again") > 0, F.concat(F.lit("("), "word", F.lit(")+"))).otherwise(F.col("word"))
    part = F.when(F.col("count") < F.col("pages"), F.concat(F.lit("("), part, F.lit(")?"))).otherwise(part)
    slot = F.when(F.col("opens"), " (#TEXT)+").when(F.col("text") > 0, " #TEXT").otherwise("")
    g = named.groupBy("site").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list(F.struct("at", F.concat(part, slot).alias("p")))).alias("x"))
    return g.select("site", "pages", F.trim(F.array_join("x.p", " ")).alias("wrapper"))

"""Sentences of texts in many scripts (problem 1).

Method: document-centred disambiguation. Whether the word before a period is an
abbreviation is asked of the document first (does it show the word before a
period that can't be an end? does it show it in the same spelling without a
period?), then of counts over the whole corpus, and only where both are silent
of a short list. Whether the word after it is a name is likewise asked of the
document (does it occur in small letters? as a capital in mid sentence?) and then
of the corpus. The longer a word, the more often must it be seen with a period to
be learned as an abbreviation; there is no greatest length. Other scripts have
their own terminators: full-width marks end a sentence without a blank, the danda
and the Arabic question mark do so before one, ';' asks in Greek, and in Thai a
blank ends a sentence unless it stands beside a number.

The corpus counts every word once a batch, in small letters, and is joined to
documents by the words that stand beside their periods.

Defined cases: null, empty and blank texts have no sentence; rows with a null id
are ignored; of repeated deliveries the latest counts; a list line is one
sentence; a paragraph without closing mark is a sentence; quotes and brackets
that never close are plain text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common abbreviations. Those before a name never end a sentence,
# those before a number don't before a digit, those inside never do, the rest end
# one where a capital follows.
BEFORE_NAME = "dr mr mrs ms prof st hr fr sr sra srta dra mme mlle mgr rev gen col capt sgt lt hon κ δρ د أ डॉ श्री ул им гр проф д-р г-н г-жа пл пр"
BEFORE_NUMBER = "no nr nos fig figs p pp vol ch sec art pág págs núm num bd kap abb s v d г стр рис гл кв д № c ca"
INSIDE = "i.e e.g vs cf z.b d.h bzw ggf u.a p.ej c.-à-d resp approx ca al viz"
CLOSING = "etc usw p.m a.m ltd inc co corp jr sr ph.d m.d u.s т.д т.п и.т.д"
NAME, NUMBER, WITHIN, CLOSE = (frozenset(x.split()) for x in (BEFORE_NAME, BEFORE_NUMBER, INSIDE, CLOSING))

MARK = r"\[evidence_[^\]\s]*\]"
CLOSERS = "\"'”’»›)\\]」』】）》〉］“‘"
_LIST = re.compile(r"[^\S\n]*(?:[-–—•*·▪‣◦][^\S\n]+|\(?\d{1,2}[.)][^\S\n]+|\(?[a-z]\)[^\S\n]+)\S")
_TERM = re.compile(r"[.!?…؟।॥]+|[。！？｡]+|;")
_TAIL = re.compile(rf"(?:\s*{MARK})+")
_TOKEN = re.compile(r"[^\W\d_](?:[^\s\W_]|[̀-ͯऀ-ॣً-ٟ'’-]|\.(?=[^\W\d_]))*$")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_SOLID = re.compile(r"\S")
_THAI = re.compile(r"[฀-๿]")
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "„": "“", "《": "》", "‹": "›", "[": "]"}
#: A word, the single period after it if there is one, the blank and the character after that.
_WORD = re.compile(r"(?<![^\W\d_.])([^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u0900-\u0963\u064b-\u065f])*)((?<!\.)\.(?!\.))?(?=(\s*)(.?))")


def caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is list line) of paragraphs and list lines."""
    start, at = 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        if not line.strip():
            yield start, at, False
            start = end
        elif _LIST.match(line):
            yield start, at, False
            yield at, end, True
            start = end
        at = end + 1
    yield start, len(text), False


def _spans_of_quotes(text: str) -> list[tuple[int, int]]:
    """(open, close) of the outermost closed quotes and brackets of a block, in order."""
    pairs, stack = [], []
    for i, c in enumerate(text):
        if stack and c == stack[-1][1]:
            pairs.append((stack.pop()[0], i))
        elif c in _PAIRS and not (c == "[" and text.startswith("[evidence_", i)):
            stack.append((i, _PAIRS[c]))
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):  # what never closes is plain text and holds nothing
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


class Evidence:
    """What a document, and behind it the corpus, shows of words.

    short: words of the corpus that are abbreviations; usual: words of the corpus
    that are none; plain: words of the corpus that are written small unless they
    begin a sentence. All in small letters.
    """

    def __init__(self, text: str, short: set[str] | frozenset = frozenset(), usual: set[str] | frozenset = frozenset(), plain: set[str] | frozenset = frozenset()):
        self.short, self.usual, self.corpus_plain = short, usual, plain
        self.dotted, self.bare, self.inside, self.plain = document_words(text)

    def abbreviation(self, word: str) -> bool | None:
        """Whether the word is an abbreviation: by the document, the corpus, the list; None if nobody knows."""
        low = word.lower()
        shown = self.dotted.get(low, 0)
        if shown and not self.bare.get(low):
            return True if 4 * shown >= len(word) or low in self.short else None
        if self.bare.get(word) and not shown:
            return False
        if low in self.short:
            return True
        if low in self.usual:
            return False
        return True if low in NAME or low in WITHIN or low in CLOSE or "." in low else None

    def name(self, word: str) -> bool:
        """Whether a capitalised word is a name rather than the begin of a sentence."""
        low = word.lower()
        if low in self.plain:
            return False
        if low in self.inside:
            return True
        return low not in self.corpus_plain


def _word_before(block: str, i: int) -> str:
    """The word that ends at i, with periods inside; of scripts without blanks a few characters."""
    k, seen = i, 0
    while k and not block[k - 1].isspace() and seen < 3:
        k -= 1
        seen += bool(_UNSPACED.match(block[k]))
    m = _TOKEN.search(block, k, i)
    return m.group() if m else ""


def _solid(block: str, i: int) -> int:
    """The place of the first character from i on that is no blank."""
    m = _SOLID.search(block, i)
    return m.start() if m else len(block)


_BARE_WORD = re.compile(r"[^\W\d_]+")
_ONE_LETTER = re.compile(r"[^\W\d_]\.")
_MONTH = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")


def _period_ends(block: str, i: int, j: int, ev: Evidence) -> bool:
    """Whether the single period at i ends a sentence; j is the end of mark and closers."""
    word = _word_before(block, i)
    if any(len(x) > 2 for x in word.split(".")):  # two sentences without a blank between them
        word = word.rpartition(".")[2]
    low = word.lower()
    after = block[j : j + 1]
    if after and not after.isspace():
        if after.isdigit():
            return not (block[i - 1 : i].isdigit() or not word or low in NAME or low in NUMBER)
        if not after.isalpha():
            return after in "“«„「『《¿¡([–—" and len(word) > 2
        if caseless(after):
            return True
        return after.isupper() and (len(word) > 2 or block[i - 1 : i].isdigit() and not word) and not ev.abbreviation(word)
    at = _solid(block, j)
    first = block[at : at + 1]
    if not first:
        return True
    if first.islower():
        return False
    if not word:  # a number or bracket before the period
        digits = re.search(r"(?<![\d.,])\d{1,2}$", block[max(0, i - 4) : i])
        if not (digits and first.isupper() and j == i + 1):
            return True
        ordinal = re.search(r"\b(?:der|die|das|den|dem|des|am|im|zum|zur|vom|beim)\s+\d+$", block[max(0, i - 12) : i], re.I)
        return not (ordinal or _MONTH.match(block, at))
    if re.search(r"(?:^|\s)т\.\s?$", block[max(0, i - len(word) - 4) : i - len(word)]):
        return low in ("д", "п")
    if len(word) == 1 and low not in NAME and low not in NUMBER:
        return not (word.isupper() or caseless(word) or first.isdigit() or _ONE_LETTER.match(block, at))
    short = ev.abbreviation(word)
    if first.isdigit():  # without a period words don't tell of numbering: "no", "art"
        return not (short or low in NUMBER or low in NAME or len(word) == 1)
    if len(word) == 1 and (word.isupper() or caseless(word) or _ONE_LETTER.match(block, at)):
        return False
    if not short:
        return len(word) > 1 or low not in NAME
    if low in NAME or low in WITHIN:
        return False
    if low in CLOSE or "." in low:
        return True
    w = _BARE_WORD.match(block, at)
    return bool(w and not ev.name(w.group()))


def _running(block: str, ev: Evidence) -> list[int]:
    """Ends of the sentences of a running block."""
    ends: list[int] = []
    quotes = _spans_of_quotes(block)
    opens, shut = [a for a, _ in quotes], {b for _, b in quotes}
    start, pos = 0, 0

    def quoted(i: int) -> tuple[int, int] | None:
        k = bisect_left(opens, i) - 1
        return quotes[k] if k >= 0 and i <= quotes[k][1] else None

    while m := _TERM.search(block, pos):
        i, j = m.span()
        pos = j
        mark = m.group()
        if mark == ";":
            k = i - 1
            while k >= 0 and not block[k].isalpha():
                k -= 1
            if k < 0 or not ("Ͱ" <= block[k] <= "Ͽ" or "ἀ" <= block[k] <= "῿"):
                continue
        hold = quoted(i)
        while j < len(block) and (block[j] in CLOSERS or block[j] in "   " and block[j + 1 : j + 2] in ("»", "›")) and not block.startswith("[evidence_", j):
            c = block[j]
            if c in "\"'" and j + 1 < len(block) and not block[j + 1].isspace() and block[j + 1] not in CLOSERS + ".,;:!?[":
                break
            if c in "“‘" and j not in shut:
                break
            j += 2 if c in "   " else 1
        if hold and j <= hold[1]:
            continue  # inside a quote or bracket that goes on
        closed = hold and j > hold[1]
        tail = _TAIL.match(block, j)
        stop = tail.end() if tail else j
        at = _solid(block, stop)
        first = block[at : at + 1]
        if not first:
            continue
        if closed:
            a, _ = hold
            lead = block[start:a].strip()
            if tail is None and (first in ",，、;:" or first in "–—-" and block[at + 1 : at + 2].isspace()):
                continue
            if first.islower():
                continue
            if block[a] in "(（[" and lead:
                continue
            if caseless(first):
                own = not lead and block[a] in "(（"
                said = lead.endswith("：") and mark[-1] in ".。！!।" or lead.endswith(":") and mark[-1] in ".।"
                if not (own or said or tail):
                    continue
        elif mark == ".":
            if not _period_ends(block, i, stop if tail else j, ev):
                continue
        elif mark[0] in "。！？｡":
            if first in ",，、" or first in "）」』":
                continue
        else:
            gap = block[stop : stop + 1]
            if first.islower() or first in ",;:":
                continue
            if not gap.isspace() and not (first.isupper() or caseless(first) or first in "“«„「¿¡([") and tail is None:
                continue
            if mark[0] in "…." and not gap.isspace() and tail is None and not first.isupper():
                continue
        ends.append(stop)
        start = pos = stop
    if _THAI.search(block):
        marks = {m.end(): m.start() for m in re.finditer(rf"(?:\s*{MARK})+", block)}
        for m in re.finditer(r"\s+", block):
            a, b = m.span()
            left = marks.get(a, a)
            x, y = block[left - 1 : left], block[b : b + 1]
            if not x or not y or block.startswith("[evidence_", b):
                continue
            if _THAI.match(x) and not x.isdigit() and not y.isdigit() and (_THAI.match(y) or y.isalpha() or y in "“«\"("):
                ends.append(a)
    return sorted(set(ends))


def segment(text: str | None, known: set[str] | frozenset = frozenset(), usual: set[str] | frozenset = frozenset(), plain: set[str] | frozenset = frozenset(), ev: Evidence | None = None) -> list[tuple[int, int]]:
    """Spans of the sentences; known, usual and plain are what the corpus shows of words (see Evidence), ev the evidence of a whole document that text is part of."""
    if not text or not text.strip():
        return []
    ev = ev or Evidence(text, known, usual, plain)
    spans = []
    for a, b, is_list in _blocks(text):
        block = text[a:b]
        if not block.strip():
            continue
        cuts = [0, *([] if is_list else _running(block, ev)), len(block)]
        for x, y in zip(cuts, cuts[1:]):
            part = block[x:y]
            if part.strip():
                lead = len(part) - len(part.lstrip())
                spans.append((a + x + lead, a + x + len(part.rstrip())))
    return spans


def document_words(text: str) -> tuple[Counter, Counter, set[str], set[str]]:
    """Of a text's words: (before a period that can't be an end, without one, capitals in mid sentence, in small letters).

    The first, third and fourth are in small letters, the second holds both spellings.
    """
    dotted, bare, inside, plain = Counter(), Counter(), set(), set()
    after = ""  # what stands before the word: a small letter or comma means mid sentence
    end = 0
    for m in _WORD.finditer(text):
        w = m[1]
        low = w.lower()
        if m[2]:
            if m[3] and (m[4].islower() or m[4] == ",") or not m[3] and m[4] in ",;:" and m[4]:
                dotted[low] += 1
        elif m[4] or m[3]:
            bare[w] += 1
            if w != low:
                bare[low] += 1
        if w[0].islower():
            plain.add(low)
        elif w != low and after and text[end : m.start()] == " ":
            inside.add(low)
        after = "" if m[2] else w[-1] if w[-1].islower() else ""
        end = m.end(1)
    return dotted, bare, inside, plain


_COUNTS = ("dotted", "bare", "inner", "small", "inside")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> counts of words in small letters, summed by batch: with a period, without, with one that
    can't be an end (before small letters, commas, digits), in small letters, as a capital in mid sentence.

    Words of scripts without blanks are left out: their runs are no words.
    """
    for batch in batches:
        n = {c: Counter() for c in _COUNTS}
        for text in batch.column(0).to_pylist():
            end, after = 0, False
            for m in _WORD.finditer(text or ""):
                w = m[1]
                low = w.lower()
                if low == w.upper() and _UNSPACED.match(w):
                    continue
                if m[2]:
                    n["dotted"][low] += 1
                    n["inner"][low] += m[4].islower() or m[4].isdigit() or m[4] in ",;:" and m[4] != ""
                elif m[3] or m[4]:
                    n["bare"][low] += 1
                if w[0].islower():
                    n["small"][low] += 1
                elif w != low and after and text[end : m.start()] == " ":
                    n["inside"][low] += 1
                after, end = not m[2] and w[-1].islower(), m.end(1)
        words = sorted(set(n["dotted"]) | set(n["bare"]))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([n[c][w] for w in words], pa.int64()) for c in _COUNTS)], names=["word", *_COUNTS])


SHORT, USUAL, PLAIN = 1, 2, 4


def corpus_words(texts: DataFrame, column: str = "text", least: int = 3) -> DataFrame:
    """(word, shows): what the corpus shows of each word that it shows anything of, as a sum of
    SHORT (stands nearly always with a period, and often where no sentence can end), USUAL (nearly
    never does) and PLAIN (is written small more often than as a capital in mid sentence)."""
    counts = texts.select(column).mapInArrow(_count_words, "word string, " + ", ".join(f"{c} long" for c in _COUNTS))
    total = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    c = F.col
    seen = F.greatest(F.lit(least), F.ceil(F.length("word") / 4))
    short = (c("dotted") >= seen) & (c("bare") * 9 <= c("dotted")) & (c("inner") * 20 >= c("dotted"))
    usual = (c("bare") >= least) & (c("inner") * 9 <= c("bare")) & (c("dotted") * 9 <= c("bare"))
    shows = F.when(short, SHORT).when(usual, USUAL).otherwise(0) + F.when(c("small") > c("inside"), PLAIN).otherwise(0)
    return total.select("word", shows.cast("int").alias("shows")).where("shows > 0")


def _asked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> the words beside the single periods of each text, in small letters."""
    for batch in batches:
        ids, words = [], []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got, follows = set(), False
            for m in _WORD.finditer(text):
                if m[2]:
                    got.add(m[1].lower())
                if follows:
                    got.add(m[1].lower())
                follows = bool(m[2])
            ids += [id_] * len(got)
            words += sorted(got)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.string())], names=["id", "word"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for id_, text, known in zip(*(c.to_pylist() for c in batch.columns)):
            shown = known or ()
            sets = [{w["word"] for w in shown if w["shows"] & bit} for bit in (SHORT, USUAL, PLAIN)]
            for k, (a, b) in enumerate(segment(text, *sets)):
                out.append((id_, k, a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int32(), pa.int32(), pa.int32()])], names=["id", "sentence_index", "char_start", "char_end"])


def sentences(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, sentence_index, char_start, char_end) of every sentence of docs."""
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    corpus = corpus_words(base)
    asked = base.mapInArrow(_asked_words, "id string, word string")
    known = asked.join(corpus, "word").groupBy("id").agg(F.collect_list(F.struct("word", "shows")).alias("known"))
    return base.join(known, "id", "left").select("id", "text", "known").mapInArrow(_segment_rows, "id string, sentence_index int, char_start int, char_end int")

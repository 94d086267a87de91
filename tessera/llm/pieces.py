"""Cutting oversized items at natural boundaries (problem 7).

Method: every item is worked on in ranges. A worker detects the boundaries of its
range, with a halo on both sides: as much before it as it takes to be in step
with what a scan of the whole item would see, and the longest piece after it. A
piece that begins in a range can then be cut by that range alone. What a range
can't know is where the first piece in it begins. It therefore works out, for
every place where one could begin, where the chain of pieces leaves it and after
how many pieces. These short tables are stitched in range order: the lengths of
the ranges are summed up to offsets, the pieces to numbers, and each range learns
its first piece. Then all ranges emit their pieces at once, by offset. An item of
one range needs no stitching and is cut where it is read. Files are read by byte
ranges in the same way, so no file is ever loaded whole, and a task holds one range.

A piece has at most ``max_chars`` code points and starts ``overlap`` code points
before the end of the one before it. Its end is the best boundary in the second
half of the window (paragraph, line, sentence, clause, blank; the last of the
best kind), else the best one anywhere that moves on past the overlap, else the
window's end, moved back from before a combining mark. The size of the ranges
changes nothing of the pieces.

Defined cases: null and empty texts give no piece; a text within the limit is
one piece; white space is not dropped, positions point into the text as it is;
rows with a null id or without a limit are ignored; of repeated deliveries the
latest counts; an empty table gives an empty result. Files must be valid UTF-8.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialise, parts_for, ship, written_bytes

BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4, 5

_SPOT = re.compile(
    r"(?P<p>\s*?\n[^\S\n]*\n)|(?P<l>[^\S\n]*\n)|(?P<s>[.!?…؟।]+[\"'”’»)\]]*(?=\s))|(?P<c>[。！？]+[」』”’）》]*)|(?P<k>[,;:،؛](?=\s)|[，、；：])|(?P<b>\s+)"
)
_SHORT = re.compile(r"(?:^|[\s(\[«“„])(?:\w|\w\.\w|[A-ZÀ-ÞА-Я]\w{1,2})\.$")
#: Characters before a scan's begin that the kind of a period looks at.
CONTEXT = 8


def in_step(text: str, at: int, least: int = 0) -> int:
    """The last place up to ``at`` from which a scan finds what a scan of all finds: after a letter or
    digit, which no boundary holds; 0 or less than ``least`` if there is none."""
    while at > least and not text[at - 1].isalnum():
        at -= 1
    return at


def spots(text: str, lo: int, hi: int, begin: int = 0) -> tuple[list[int], list[int]]:
    """Boundaries with lo < position <= hi and their kinds, best kind at equal positions; begin is in step."""
    at: list[int] = []
    kind: list[int] = []
    for m in _SPOT.finditer(text, begin):
        if m.start() > hi:
            break
        g = m.lastgroup
        if g in ("p", "l", "b"):
            pos, k = m.start(), PARAGRAPH if g == "p" else LINE if g == "l" else BLANK
        elif g == "k":
            pos, k = m.end(), CLAUSE
        else:
            pos, k = m.end(), SENTENCE
            if g == "s" and m.group()[0] == "." and (_SHORT.search(text, max(0, m.start() - 5), m.start() + 1) or text[m.end() + 1 : m.end() + 2].islower()):
                k = BLANK
        if lo < pos <= hi:
            if at and at[-1] == pos:
                kind[-1] = max(kind[-1], k)
            else:
                at.append(pos)
                kind.append(k)
    return at, kind


@functools.cache
def _marks() -> np.ndarray:
    """Whether each code point is a combining mark or joiner."""
    return np.array([unicodedata.combining(c) > 0 or c in "\u200d\ufe0f" for c in map(chr, range(sys.maxunicode + 1))])


def marks(text: str, lo: int, hi: int) -> list[int]:
    """Positions before a combining mark or joiner, where a cut would split a character."""
    if text.isascii():
        return []
    codes = np.frombuffer(text[lo + 1 : hi + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
    far = np.flatnonzero(codes >= 0x300)
    return (far[_marks()[codes[far]]] + lo + 1).tolist()


class Cuts:
    """Where the pieces of a range end. Positions count from the range's begin; stop is the item's end if it is in sight."""

    def __init__(self, at: np.ndarray, kind: np.ndarray, hard: np.ndarray, most: int, overlap: int, stop: int | None):
        self.most, self.overlap, self.stop = most, max(0, min(overlap, most - 1)), stop
        self.kinds = [at[kind == k].tolist() for k in (PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK)]
        self.hard = set(hard.tolist())

    def _best(self, low: int, high: int) -> int | None:
        for places in self.kinds:
            i = bisect_right(places, high)
            if i and places[i - 1] > low:
                return places[i - 1]
        return None

    def end(self, s: int) -> int:
        limit, least, half = s + self.most, s + self.overlap, s + self.most // 2
        if self.stop is not None and limit >= self.stop:
            return self.stop
        end = self._best(max(least, half), limit) or self._best(least, min(half, limit))
        if end:
            return end
        end = limit
        while end in self.hard and end > least + 1:
            end -= 1
        return limit if end in self.hard else end

    def chain(self, s: int, size: int) -> Iterator[tuple[int, int]]:
        """Pieces that begin at s or later and before size."""
        while s < size:
            end = self.end(s)
            yield s, end
            if end == self.stop:
                return
            s = end - self.overlap

    def exits(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place where the range's first piece can begin: where the first one after the range begins (-1: none), and the pieces until then."""
        memo: dict[int, tuple[int, int]] = {}
        window = min(self.most - self.overlap, size)
        for e in range(window):
            path, s = [], e
            while 0 <= s < size and s not in memo:
                path.append(s)
                end = self.end(s)
                s = -1 if end == self.stop else end - self.overlap
            out, n = memo.get(s, (s, 0))
            for p in reversed(path):
                n += 1
                memo[p] = out, n
        return np.array([memo[e][0] for e in range(window)], np.int32), np.array([memo[e][1] for e in range(window)], np.int32)


#: Rows of pieces (piece set), and of ranges still to be cut (rng set): size and boundaries, stop, exits, pieces by entry.
MADE = "space int, id string, piece long, char_start long, char_end long, rng long, size long, max_chars int, overlap int, stop long, at binary, kind binary, hard binary, exits binary, counts binary"
_NAMES = [c.split()[0] for c in MADE.split(", ")]
_TYPES = [pa.int32(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
PIECES = "space int, id string, piece long, char_start long, char_end long"


def _cuts(text: str, lo: int, hi: int, begin: int, most: int, overlap: int, whole: bool) -> tuple[Cuts, tuple[np.ndarray, ...]]:
    """The cuts of text[lo:hi]; begin is in step, whole says that the item ends with text."""
    end = min(len(text), hi + most)
    at, kind = spots(text, lo, end, begin)
    at, kind, hard = np.array(at, np.int32) - lo, np.array(kind, np.int8), np.array(marks(text, lo, end), np.int32) - lo
    return Cuts(at, kind, hard, most, overlap, len(text) - lo if whole else None), (at, kind, hard)


def _range_row(space: int, id_: str, rng: int, size: int, most: int, overlap: int, cuts: Cuts, table: tuple[np.ndarray, ...]) -> tuple:
    exits, counts = cuts.exits(size)
    return (space, id_, None, None, None, rng, size, most, overlap, cuts.stop, *(x.tobytes() for x in table), exits.tobytes(), counts.tobytes())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _text_ranges(size: int):
    """(space, id, text, max_chars, overlap) -> the pieces of items of one range, the ranges of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * 10
        for batch in batches:
            rows: list[tuple] = []
            for space, id_, text, most, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(text)
                if n <= size:
                    cuts, _ = _cuts(text, 0, n, 0, most, overlap, True)
                    rows += [(space, id_, k, a, b, *none) for k, (a, b) in enumerate(cuts.chain(0, n))]
                    continue
                for k, a in enumerate(range(0, n, size)):
                    b = min(a + size, n)
                    rows.append(_range_row(space, id_, k, b - a, most, overlap, *_cuts(text, a, b, in_step(text, a), most, overlap, True)))
            if rows:
                yield _batch(rows)

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges' exits, sorted by item and range -> (space, id, rng, entry, piece, base) of the ranges in which a piece begins."""
    item, entry, piece, base = None, 0, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for space, id_, rng, size, exits, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (space, id_) != item:
                item, entry, piece, base = (space, id_), 0, 0, 0
            if 0 <= entry < size:
                out.append((space, id_, rng, entry, piece, base))
                piece += int(np.frombuffer(counts, np.int32)[entry])
                entry = int(np.frombuffer(exits, np.int32)[entry])
            if entry >= 0:
                entry -= size
            base += size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.string(), *[pa.int64()] * 4])], names=["space", "id", "rng", "entry", "piece", "base"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with their entries -> pieces."""
    for batch in batches:
        out: list[tuple] = []
        for space, id_, size, most, overlap, stop, at, kind, hard, entry, piece, base in zip(*(c.to_pylist() for c in batch.columns)):
            cuts = Cuts(np.frombuffer(at, np.int32), np.frombuffer(kind, np.int8), np.frombuffer(hard, np.int32), most, overlap, stop)
            out += [(space, id_, piece + k, base + a, base + b) for k, (a, b) in enumerate(cuts.chain(entry, size))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.string(), *[pa.int64()] * 3])], names=[c.split()[0] for c in PIECES.split(", ")])


def _settled(made: DataFrame) -> DataFrame:
    """Pieces from rows as MADE says."""
    made = materialise(made, "ranges")
    done = made.where("piece is not null").select("space", "id", "piece", "char_start", "char_end")
    ranges = made.where("rng is not null")
    n = ranges.count()
    if not n:
        return done
    spark = made.sparkSession
    heads = ranges.select("space", "id", "rng", "size", "exits", "counts").repartition("space", "id").sortWithinPartitions("space", "id", "rng")
    entries = materialise(heads.mapInArrow(_stitch, "space int, id string, rng long, entry long, piece long, base long"), "entries")
    first = ranges.drop("piece").join(entries, ["space", "id", "rng"]).select("space", "id", "size", "max_chars", "overlap", "stop", "at", "kind", "hard", "entry", "piece", "base")
    cut = first.repartition(min(n, parts_for(spark, 2 * written_bytes(made)))).mapInArrow(_emit, PIECES)
    return done.unionByName(cut)


def pieces(items: DataFrame, range_chars: int = 16_384) -> DataFrame:
    """(space, id, piece, char_start, char_end) of items (space, id, text, max_chars, overlap)."""
    known = items.where("id is not null and text <> '' and max_chars > 0").select(
        F.col("space").cast("int"), F.col("id").cast("string"), "text", F.col("max_chars").cast("int"), F.coalesce("overlap", F.lit(0)).cast("int")
    )
    return _settled(known.mapInArrow(_text_ranges(range_chars), MADE))


def oversized(items: DataFrame) -> DataFrame:
    """Items that can be above their limit: a text has at most as many code points as bytes."""
    return items.where(F.octet_length("text") > F.col("max_chars"))


def _read(f, size: int, a: int, b: int, most: int) -> tuple[str, int, int, int, bool]:
    """(text, begin of the core in it, its end, begin of the scan, whether the file ends with text) of the bytes a..b of an open file."""
    at = lambda x, y: (f.seek(x), f.read(y - x))[1]
    first = lambda raw: next((i for i, c in enumerate(raw) if c & 0xC0 != 0x80), len(raw))
    back = 256
    while True:
        x = max(0, a - back)
        raw = at(x, min(a + 4, size))
        edge = a - x + first(raw[a - x :])  # a character belongs to the range it begins in
        head = raw[first(raw) if x else 0 : edge].decode("utf-8", "replace")
        begin = in_step(head, len(head), CONTEXT if x else 0)
        if not x or begin > CONTEXT:
            break
        back *= 4
    core_from = x + edge
    more = 4 * most + 256
    while True:
        y = min(size, b + more)
        raw = at(core_from, y)
        hi = max(0, b - core_from)
        hi += first(raw[hi : hi + 4]) if b < size else len(raw) - hi
        core = raw[:hi].decode("utf-8", "replace")
        tail = raw[hi:] if y == size else raw[hi : len(raw) - _open_end(raw)]
        tail = tail.decode("utf-8", "replace")
        k = most
        while k < len(tail) and not tail[k].isalnum():
            k += 1
        if y == size or k + 4 < len(tail):
            return head + core + tail, len(head), len(head) + len(core), begin, y == size
        more *= 4


def _open_end(raw: bytes) -> int:
    """Bytes at the end of raw that begin a character but don't finish it."""
    for k in range(1, min(4, len(raw)) + 1):
        c = raw[-k]
        if c & 0xC0 != 0x80:
            need = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            return k if need > k else 0
    return 0


def _file_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, start, stop, max_chars, overlap): byte ranges of UTF-8 files -> ranges."""
    from pyarrow import fs

    for batch in batches:
        for path, size, a, b, most, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            with system.open_input_file(inner) as f:
                text, lo, hi, begin, whole = _read(f, size, a, b, most)
            yield _batch([_range_row(0, path, a, hi - lo, most, overlap, *_cuts(text, lo, hi, begin, most, overlap, whole))])


def file_pieces(spark: SparkSession, files: list[tuple[str, int]], max_chars: int, overlap: int, range_bytes: int = 8 << 20) -> DataFrame:
    """(path, piece, char_start, char_end) of UTF-8 files given as (path or address, bytes) that all workers can open."""
    ship(spark)
    df = spark.createDataFrame(files, "path string, size long").withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))
    ranges = df.where("size > 0").select("path", "size", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"), F.lit(max_chars).alias("m"), F.lit(overlap).alias("o"))
    n = max(1, sum(-(-s // range_bytes) for _, s in files))
    return _settled(ranges.repartition(min(n, 200_000)).mapInArrow(_file_ranges, MADE)).drop("space").withColumnRenamed("id", "path")


def files_below(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(address, bytes) of the data files in a folder of any file system that the session reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))

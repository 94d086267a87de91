"""Records that say almost the same (problem 3).

Method: a multi-index Hamming join. The signature of a text has 30 lanes of
minimum hashes over its word shingles; two signatures are near if they differ in
at most ``FAR`` = 19 lanes. The lanes are cut into 10 chunks of 3. By the
pigeonhole principle two signatures that differ in at most 10 * 2 - 1 = 19 lanes
have a chunk with at most one differing lane; all ways to leave out one lane of a
chunk are enumerated (30 keys a text), so every pair under the threshold meets
under some key: none is left to chance. Pairs that meet are compared by a code of
4 bits a lane, which never calls a near pair far, and survivors by their exact
shingle sets.

Lanes differ with probability 1 - s at similarity s. The chance that a pair is
beyond the threshold of the signatures is 0.3 % at s = 0.6, 0.04 % at 0.65 and below 0.01 % from 0.7.

A key that more than ``hot`` classes share isn't searched pair by pair: its classes
are joined by the prefixes of their shingle sets, rarest shingles first, which
misses none of their pairs; only texts that share a rare shingle, have the sizes
and enough shingles left to be similar are met, and their codes compared.

Texts with the same words are one class: keys are emitted once a class and
batch, so a text copied a million times costs no more than one copy. Keys and
signatures travel in packed blocks, a row for each batch and key range.

A shingle is a run of ``size`` consecutive words, a word a maximal run of
letters or digits of the lower-cased text; a text with fewer words is one
shingle. Defined cases: null, empty and wordless texts are in no pair; rows
with a null id are ignored; of repeated deliveries the latest counts; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components
from tessera.runtime import broadcast_below, materialise, parts_for, written_bytes

WORD = re.compile(r"[^\W_]+")
LANES, CHUNKS, SPAN = 30, 10, 3
#: Lanes in which near signatures differ at most: one less than two in every chunk.
FAR = 2 * CHUNKS - 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # public finalizer constants


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_rng = np.random.default_rng(20240607)
_LANE = _rng.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(1, 2**63, LANES, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingle_hashes(texts: list[str | None], size: int, known: _WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, end of each text in them, hash of each text's words)."""
    flat: list[int] = []
    words = np.zeros(len(texts), np.int64)
    get = known.__getitem__
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            words[i] = len(w)
            flat.extend(map(get, w))
    w = np.array(flat, dtype=np.uint64)
    begin = np.concatenate([[0], np.cumsum(words)])
    n = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + begin[doc]
    h = np.zeros(len(at), np.uint64)
    stop = begin[doc + 1] if len(doc) else at
    for k in range(size):
        inside = at + k < stop
        part = np.where(inside, w[np.minimum(at + k, max(len(w) - 1, 0))] if len(w) else 0, np.uint64(0))
        h += mixed(part + np.uint64(k + 1)) * _PLACE[k]
    h = mixed(h)
    order = np.arange(len(w), dtype=np.uint64) - np.repeat(begin[:-1], words).astype(np.uint64)
    cls = np.zeros(len(texts), np.uint64)
    if len(w):
        full = words > 0
        cls[full] = mixed(np.add.reduceat(mixed(w + order * _PLACE[40]), begin[:-1][full]) + words[full].astype(np.uint64))
    return h, ends, cls


def lanes_of(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(LANES, texts) of 32-bit minima; texts without shingles must be left out before."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty((LANES, len(ends)), np.uint64)
    for i in range(LANES):
        out[i] = np.minimum.reduceat(((h ^ _FLIP[i]) * _LANE[i]) >> np.uint64(32), starts)
    return out


def keys_of(lanes: np.ndarray) -> np.ndarray:
    """(CHUNKS * SPAN, texts): the keys of each chunk with one of its lanes left out."""
    keys = []
    for c in range(CHUNKS):
        chunk = lanes[c * SPAN : (c + 1) * SPAN]
        for out in range(SPAN):
            k = np.full(lanes.shape[1], c * SPAN + out + 1, np.uint64)
            for j in range(SPAN):
                if j != out:
                    k = mixed(k * _PLACE[j] + chunk[j])
            keys.append(k)
    return np.stack(keys)


def packed(lanes: np.ndarray) -> list[np.ndarray]:
    """4 bits of each lane, in two words of 64 bits."""
    low = mixed(lanes) & np.uint64(15)
    zero = np.zeros(lanes.shape[1], np.uint64)
    return [sum((low[i] << np.uint64(4 * k) for k, i in enumerate(range(h, min(h + 16, LANES)))), zero) for h in range(0, LANES, 16)]


#: A key with its class, the class's code and how many shingles it has, in sixteenths of a doubling.
_ROW = np.dtype([("k", "<u4"), ("c", "<u8"), ("s0", "<u8"), ("s1", "<u8"), ("n", "u1")])
DOUBLING = 16


def _classes_of(batch: pa.RecordBatch, size: int, known: _WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with words, their shingle hashes and ends, spaces, classes); texts without words have no shingles."""
    h, ends, cls = shingle_hashes(batch.column(2).to_pylist(), size, known)
    some = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
    spaces = batch.column(0).to_numpy().astype(np.uint64)[some]
    return some, h, ends[some], spaces, mixed(cls[some] + spaces * _PLACE[41])


def _distinct(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of distinct shingles of each text."""
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    order = np.lexsort((h, text))
    t, x = text[order], h[order]
    return np.bincount(t[np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])], minlength=len(ends))


def _members(size: int):
    """(space, id, text) -> (space, id, cls) of the texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            some, _, _, _, cls = _classes_of(batch, size, known)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(cls.view(np.int64))], names=["space", "id", "cls"])

    return run


def _signatures(size: int, ranges: int):
    """(space, id, text) -> packed key blocks (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            some, h, ends, spaces, cls = _classes_of(batch, size, known)
            if not len(some):
                continue
            lanes = lanes_of(h, ends)
            _, one = np.unique(cls, return_index=True)
            lanes, c, spaces = lanes[:, one], cls[one], spaces[one]
            keys = mixed(keys_of(lanes) + spaces * _PLACE[42]).ravel()
            sig = packed(lanes)
            rows = np.zeros(len(keys), dtype=_ROW)
            part = ((keys >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
            rows["k"] = keys.astype(np.uint32)
            tile = CHUNKS * SPAN
            rows["c"] = np.tile(c, tile)
            rows["n"] = np.tile(np.minimum(np.rint(DOUBLING * np.log2(_distinct(h, ends)[one])), 255).astype(np.uint8), tile)
            for name, x in zip(("s0", "s1"), sig):
                rows[name] = np.tile(x, tile)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["part", "block"])

    return run


_NIBBLE = np.uint64(0x1111111111111111)


def _differing(x: np.ndarray) -> np.ndarray:
    y = x | (x >> x.dtype.type(1))
    y = (y | (y >> x.dtype.type(2))) & x.dtype.type(int(_NIBBLE) & np.iinfo(x.dtype).max)
    return np.bitwise_count(y)


def _meet(rows: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Class pairs of rows (sorted, distinct) under one key whose codes differ in no more than FAR lanes, and of sizes that allow the threshold."""
    k, c, *codes = (rows[x].copy() for x in ("k", "c", "s0", "s1"))
    n = rows["n"].astype(np.int16)
    apart = int(DOUBLING * np.log2(1 / threshold)) + 1  # both are rounded by half a step
    at = np.arange(len(k) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(k)]
        at = at[k[at] == k[at + step]]
        if not len(at):
            return
        ok = at[np.abs(n[at] - n[at + step]) <= apart]
        ok = ok[sum(_differing(s[ok] ^ s[ok + step]) for s in codes) <= FAR]
        if len(ok):
            yield np.stack([c[ok], c[ok + step]], axis=1)
        step += 1


MET = "a long, b long"
#: Pairs; or a class of a crowded key (b null) with its code.
FIRST = MET + ", s0 long, s1 long"


def _pair_batches(got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if got:
        ab = np.unique(np.sort(np.concatenate(got), axis=1), axis=0)
        for i in range(0, len(ab), 100_000):
            p = ab[i : i + 100_000].copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])


def _pairs(hot: int, threshold: float):
    """Rows sorted by part -> class pairs (a, b); the classes of keys that more than ``hot`` share are passed on instead (b null), with their codes."""

    def flush(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(blocks), dtype=_ROW)
        rows = rows[np.lexsort((rows["c"], rows["k"]))]
        k, c = rows["k"], rows["c"]
        rows = rows[np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])]
        _, inverse, n = np.unique(rows["k"], return_inverse=True, return_counts=True)
        crowded = n[inverse] > hot
        for pairs in _pair_batches(list(_meet(rows[~crowded], threshold))):
            none = pa.nulls(pairs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*pairs.columns, none, none], names=["a", "b", "s0", "s1"])
        big = rows[crowded]
        big = big[np.unique(big["c"], return_index=True)[1]]
        for i in range(0, len(big), 100_000):
            r = big[i : i + 100_000]
            codes = [pa.array(r[x].astype(np.uint64).view(np.int64)) for x in ("s0", "s1")]
            yield pa.RecordBatch.from_arrays([pa.array(r["c"].copy().view(np.int64)), pa.nulls(len(r), pa.int64()), *codes], names=["a", "b", "s0", "s1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and blocks:
                    yield from flush(blocks)
                    blocks = []
                part = p
                blocks.append(b)
        if blocks:
            yield from flush(blocks)

    return run


def _blocks_meet(threshold: float):
    """Rows (token, lo, hi, side, cls, n, at) sorted by the first three and n -> class pairs that can be similar.

    n is the size of a class's set, at the token's place in it. A pair can only be similar if the smaller set is
    large enough, and what follows the token too. Rows with lo = hi meet among themselves, others the other side.
    """
    share = threshold / (1 + threshold)

    def near(n: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 1 + np.minimum(n[x] - at[x], n[y] - at[y]) >= share * (n[x] + n[y]) - 1e-9

    def meet(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, lo, hi, side, c, n, at = cols
        got, held = [], 0
        x = np.arange(len(token) - 1)
        step = 1
        while len(x):
            x = x[x + step < len(token)]
            y = x + step
            x = x[(token[x] == token[y]) & (lo[x] == lo[y]) & (hi[x] == hi[y]) & (n[x] >= threshold * n[y] - 1e-9)]
            y = x + step
            ok = near(n, at, x, y) & ((lo[x] == hi[x]) | (side[x] != side[y]))
            if ok.any():
                got.append(np.stack([c[x[ok]], c[y[ok]]], axis=1).view(np.uint64))
                held += int(ok.sum())
                if held > 1_000_000:
                    yield from _pair_batches(got)
                    got, held = [], 0
            step += 1
        yield from _pair_batches(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(7)]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            new = np.flatnonzero(np.any([np.diff(x) != 0 for x in cols[:3]], axis=0))
            cut = new[-1] + 1 if len(new) else 0  # the last group may go on
            if cut:
                yield from meet([x[:cut] for x in cols])
            rest = [x[cut:].copy() for x in cols]
        if rest is not None and len(rest[0]):
            yield from meet(rest)

    return run


#: Bytes of a shingle's hash where sets are compared: a set of a thousand shingles meets a wrong one once in a million pairs.
BYTES = 5


def tight(h: np.ndarray) -> bytes:
    """The distinct hashes, sorted, ``BYTES`` each."""
    x = np.unique(h >> np.uint64(64 - 8 * BYTES)).astype("<u8")
    return x.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def loose(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(x, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view("<u8")


#: Buckets by which shingles are counted where prefixes are ordered: a bound of what is brought to the driver and the tasks.
BUCKETS = 1 << 21


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(8 * BYTES - 21)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingles packed) -> (bucket, n), summed by task."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        packed_sets = batch.column(0).to_pylist()
        if packed_sets:
            n += np.bincount(_bucket(loose(b"".join(packed_sets))), minlength=BUCKETS)
    some = np.flatnonzero(n)
    for i in range(0, len(some), 100_000):
        k = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], names=["bucket", "n"])


def _prefixes(threshold: float, counts):
    """(cls, shingles packed) -> (token, cls, n, at): the first shingles of each set, rarest first, that another set can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = counts.value
        for batch in batches:
            out = []
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = loose(x)
                df = many[_bucket(t)]
                order = np.lexsort((t, df))[: len(t) - int(np.ceil(len(t) * threshold - 1e-9)) + 1]
                at = np.flatnonzero(df[order] > 1)
                out.append((t[order[at]], np.full(len(at), c), np.full(len(at), len(t)), at + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*out), (np.int64, np.int64, np.int32, np.int32))], names=["token", "cls", "n", "at"])

    return run


def crowded_pairs(sets: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(a, b): pairs of classes (cls, shingles packed) that can reach the threshold; none that does is missing.

    Each set is put in order of how rare its shingles are (counted by bucket: any order that is the same for all
    sets is right); two sets of that similarity share one of their first n - ceil(threshold * n) + 1. A shingle
    that more than ``hot`` classes have there is cut into blocks that meet two by two in tasks of their own.
    """
    spark = sets.sparkSession
    n = np.zeros(BUCKETS, np.int64)
    got = sets.select("shingles").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    n[got["bucket"].to_numpy()] = got["n"].to_numpy()
    counts = spark.sparkContext.broadcast(np.minimum(n, 2**31 - 1).astype(np.int32))
    prefix = materialise(sets.mapInArrow(_prefixes(threshold, counts), "token long, cls long, n int, at int"), "prefixes")
    often = materialise(prefix.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("token", F.ceil(F.col("k") / hot).cast("int").alias("cut")), "often")
    side, _ = broadcast_below(often)
    r = prefix.join(side, "token", "left").withColumn("cut", F.coalesce("cut", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("cut")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    r = r.select("token", lo.alias("lo"), hi.alias("hi"), F.when(F.col("own") == lo, 0).otherwise(1).alias("side"), "cls", "n", "at")
    parts = parts_for(spark, 2 * written_bytes(prefix))
    return r.repartition(parts, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n").mapInArrow(_blocks_meet(threshold), MET)


def _sets(size: int):
    """(cls, text) -> (cls, distinct shingle hashes, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            h, ends, _ = shingle_hashes(batch.column(1).to_pylist(), size, known)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tight(h[a:b]) for a, b in zip(starts, ends)], pa.binary())], names=["cls", "shingles"])

    return run


def _verify(threshold: float):
    """(a, b, sa, sb) -> (a, b, similarity) at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = loose(x), loose(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                s = both / (len(x) + len(y) - both)
                if s >= threshold:
                    keep.append(i)
                    sims.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_codes(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose codes (cls, s0, s1) differ in no more than FAR lanes."""
    side, _ = broadcast_below(codes)
    one = lambda k: side.select(F.col("cls").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in ("s0", "s1")))

    def differing(x: str) -> Column:
        y = F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 1))
        return F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(int(_NIBBLE))))

    met = pairs.join(one("a"), "a").join(one("b"), "b")
    return met.where(differing("s0") + differing("s1") <= FAR).select("a", "b")


def near_classes(items: DataFrame, size: int, threshold: float, key_rows: int = 2_000_000, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(members, links) of items (space int, id string, text string).

    members: (space, id, cls), one row per item with words. links: (a, b,
    similarity), one row per pair of different classes at or above the threshold.
    """
    spark = items.sparkSession
    items = items.where("id is not null and space is not null").select(F.col("space").cast("int"), F.col("id").cast("string"), "text")
    members = materialise(items.mapInArrow(_members(size), "space int, id string, cls long"), "members")
    ranges = parts_for(spark, members.count() * CHUNKS * SPAN * _ROW.itemsize, key_rows * _ROW.itemsize)
    # the blocks, larger than the texts, are shuffled once and not written before
    blocks = items.mapInArrow(_signatures(size, ranges), "part int, block binary")
    first = materialise(blocks.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(_pairs(hot, threshold), FIRST), "first")

    def sets_of(classes: DataFrame) -> DataFrame:
        """(cls, shingles) of each class, from one of its members."""
        reps = materialise(members.join(classes, "cls").groupBy("cls").agg(F.min(F.struct("space", "id")).alias("r")).select("cls", "r.space", "r.id"), "reps")
        side, _ = broadcast_below(reps)
        return materialise(items.join(side, ["space", "id"]).select("cls", "text").mapInArrow(_sets(size), "cls long, shingles binary"), "sets")

    met = first.where("b is not null").select("a", "b")
    crowded = materialise(first.where("b is null").select(F.col("a").alias("cls"), "s0", "s1").dropDuplicates(["cls"]), "crowded")
    if crowded.limit(1).count():
        met = met.unionByName(near_codes(crowded_pairs(sets_of(crowded.select("cls")), threshold, hot), crowded))
    met = materialise(met.distinct(), "met")
    sets = sets_of(met.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    joined = (
        met.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    links = materialise(joined.mapInArrow(_verify(threshold), "a long, b long, similarity double"), "links")
    return members, links


def near_pairs(items: DataFrame, size: int = 3, threshold: float = 0.6, hot: int = 4096) -> DataFrame:
    """(space, id_a, id_b), id_a < id_b: every pair of different ids at or above the threshold."""
    members, links = near_classes(items, size, threshold, hot=hot)
    m = members.distinct()
    ma = m.select("space", F.col("id").alias("x"), F.col("cls").alias("a"))
    mb = m.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = links.join(ma, "a").join(mb, "b").select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    inside = ma.join(mb, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("space", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(inside)


def near_groups(items: DataFrame, size: int = 3, threshold: float = 0.6) -> DataFrame:
    """(space, id, class_id, group_id, n_links): one row per item with words.

    class_id marks equal texts, group_id connected classes; n_links counts the
    item's links to other texts.
    """
    members, links = near_classes(items, size, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))
    return (
        members.distinct().join(components(links).withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
        .select("space", "id", F.col("cls").alias("class_id"), F.coalesce("group", "cls").alias("group_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    )

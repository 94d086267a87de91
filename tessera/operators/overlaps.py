"""Overlaps of the token sets of one block, counted inside a task: no pair that is not asked for leaves it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most rows of either side in a block: a left row is sent to each block of its scope's right rows, and the reverse.
LEFT_ROWS, RIGHT_ROWS = 32_768, 16_384
#: Pairs are handed on in batches of about this many.
OUT_ROWS = 100_000
#: Rows of a task that are packed at once.
PACK_ROWS = 65_536
#: A token in at least one of so many right rows is a row of flags, a rarer one a list of rows.
SPARSE = 128
LEFT, RIGHT, NAMED = 0, 1, 2


def ragged(codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The codes of the given rows, one after the other; row r ends at ends[r]."""
    n = sizes[rows]
    return codes[np.repeat(ends[rows] - np.cumsum(n), n) + np.arange(n.sum())]


def one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def pack(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, pack): the rows of each key as one compressed Arrow stream, in which tokens are codes of its own words.

    A row of a pack takes a fraction of what its words take, and is sent to
    several blocks as it is. keys may not be null.
    """

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        codes = np.zeros(len(t), np.int64)
        for k in keys:
            code = one(t[k]).dictionary_encode()
            codes = np.unique(codes * len(code.dictionary) + code.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        t, starts = t.take(pa.array(order)).combine_chunks(), np.flatnonzero(np.diff(codes[order], prepend=-1))
        streams = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(t)]):
            own = t.drop_columns(keys).slice(lo, hi - lo)
            sets = one(own["set"])
            ends = np.cumsum(pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), sets.flatten().dictionary_encode())
            own = own.set_column(own.schema.get_field_index("set"), "set", sets)
            with pa.ipc.new_stream(out := pa.BufferOutputStream(), own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(own)
            streams.append(out.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([*[one(t[k].take(pa.array(starts))) for k in keys], pa.array(streams, pa.binary())], names=[*keys, "pack"])

    held, n = [], 0
    for x in batches:
        held, n = [*held, x], n + len(x)
        if n >= PACK_ROWS:
            yield packs(held)
            held, n = [], 0
    if n:
        yield packs(held)


def unpacked(packs: pa.Array) -> list[pa.Table]:
    return [pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs]


class Sets:
    """Token sets of the rows of packs, one after the other, as codes."""

    def __init__(self, packs: list[pa.Table]):
        columns = [c for t in packs for c in t["set"].chunks]
        self.sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in columns]]).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        words = [c.flatten() for c in columns]
        known = pa.chunked_array([x.dictionary for x in words]).combine_chunks().dictionary_encode()
        code, first = known.indices.to_numpy(), np.cumsum([0, *[len(x.dictionary) for x in words]])
        self.codes = np.concatenate([np.zeros(0, np.int64), *[code[x.indices.to_numpy() + k] for x, k in zip(words, first)]]).astype(np.int64)
        self.n_codes = len(known.dictionary)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return ragged(self.codes, self.ends, self.sizes, rows)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens that row a[i] and row b[i] share, for each i."""
        at = lambda rows: np.repeat(np.arange(len(rows)), self.sizes[rows]) * self.n_codes + self.of(rows)
        both = np.intersect1d(at(a), at(b))
        return np.bincount(both // max(1, self.n_codes), minlength=len(a))


def near(sets: Sets, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, shared tokens) of the pairs of non-empty sets with Jaccard >= threshold, in batches.

    Lossless: a left set adds up, over its tokens, the flags of the right sets
    that hold them. Right sets are ordered by size, so those too small or too
    large for the threshold are left out of the sum; equal left sets are
    counted once.
    """
    left, right = left[sets.sizes[left] > 0], right[sets.sizes[right] > 0]
    if not len(left) or not len(right):
        return
    right = right[np.argsort(sets.sizes[right], kind="stable")]
    rn, m = sets.sizes[right], len(right)
    lc, rc = sets.of(left), sets.of(right)
    common = (np.bincount(lc, minlength=sets.n_codes) > 0) & ((df := np.bincount(rc, minlength=sets.n_codes)) > 0)
    often = common & (df * SPARSE >= m)
    slot = np.full(sets.n_codes, -1, np.int64)
    slot[often] = np.arange(often.sum())
    row = np.repeat(np.arange(m), rn)
    kind = np.uint8 if min(sets.sizes[left].max(), rn[-1]) < 256 else np.uint16 if rn[-1] < 65_536 else np.uint32
    flags = np.zeros((int(often.sum()), m), kind)
    flags[slot[rc[often[rc]]], row[often[rc]]] = 1
    rare = (common & ~often)[rc]
    order = np.argsort(rc[rare], kind="stable")
    holders, first = row[rare][order], np.concatenate(([0], np.cumsum(np.where(often, 0, np.where(common, df, 0)))))

    equal: dict[tuple[int, bytes], list[int]] = {}
    for r, n, end in zip(left.tolist(), sets.sizes[left].tolist(), sets.ends[left].tolist()):
        own = sets.codes[end - n : end]
        equal.setdefault((n, np.sort(own[common[own]]).tobytes()), []).append(r)  # what no right set holds counts by number only
    share, bounds = threshold / (1 + threshold), {}
    out, held = [], 0
    for (n, key), rows in equal.items():
        if n not in bounds:
            lo, hi = np.searchsorted(rn, threshold * n - 1e-6), np.searchsorted(rn, n / threshold + 1e-6, "right")
            bounds[n] = int(lo), np.ceil(share * (n + rn[lo:hi]) - 1e-6)
        lo, need = bounds[n]
        own = np.frombuffer(key, np.int64)
        hi = lo + int(np.searchsorted(need, len(own), "right"))  # larger ones ask for more tokens than this set has in any right set
        if hi <= lo:
            continue
        count = np.zeros(hi - lo, kind)
        for c, s in zip(own.tolist(), slot[own].tolist()):
            if s >= 0:
                np.add(count, flags[s, lo:hi], out=count)
            else:
                at = holders[first[c] : first[c + 1]]
                count[at[(at >= lo) & (at < hi)] - lo] += 1
        hit = np.flatnonzero(count >= need[: hi - lo].astype(kind))
        if len(hit):
            both = count[hit].astype(np.int64)
            ok = both / (n + rn[lo + hit] - both) >= threshold
            b, both = right[lo + hit[ok]], both[ok]
            for r in rows:
                out.append((np.full(len(b), r), b, both))
                held += len(b)
                if held >= OUT_ROWS:
                    yield tuple(np.concatenate(x) for x in zip(*out))
                    out, held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*out))


def block(batches: Iterator[pa.RecordBatch], threshold: float, of_a: list[str], of_b: list[str]) -> Iterator[pa.RecordBatch]:
    """(of_a columns of the left row, of_b columns of the right row, jaccard, named) of the near and the named pairs of one block.

    Columns side (LEFT, RIGHT or NAMED), pack, a, b. Packs hold the columns set
    and of_a or of_b; named rows hold the a and the b of a pair that is wanted
    whatever it shares.
    """
    t = pa.Table.from_batches(list(batches))
    sides = [t.filter(pc.equal(t["side"], x)) for x in (LEFT, RIGHT, NAMED)]
    packs_a, packs_b = (unpacked(x["pack"]) for x in sides[:2])
    if not packs_a or not packs_b:
        return
    sets = Sets([*packs_a, *packs_b])
    rows_a, rows_b = (pa.concat_tables([x.drop_columns("set") for x in packs]).combine_chunks() for packs in (packs_a, packs_b))
    na, n = len(rows_a), len(rows_a) + len(rows_b)

    def rows_of(a: np.ndarray, b: np.ndarray, both: np.ndarray, is_named: bool) -> pa.RecordBatch:
        union = sets.sizes[a] + sets.sizes[b] - both
        jaccard = np.divide(both, union, out=np.zeros(len(both)), where=union > 0)
        columns = [one(rows_a[c]).take(pa.array(a)) for c in of_a] + [one(rows_b[c]).take(pa.array(b - na)) for c in of_b]
        return pa.RecordBatch.from_arrays([*columns, pa.array(jaccard), pa.array(np.full(len(both), is_named))], names=[*of_a, *of_b, "jaccard", "named"])

    known = np.zeros(0, np.int64)
    if len(sides[NAMED]):
        at = lambda c, rows: pc.fill_null(pc.index_in(one(sides[NAMED][c]), value_set=one(rows[c])), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        i, j = at("a", rows_a), at("b", rows_b)
        here = (i >= 0) & (j >= 0)
        known = np.unique(i[here] * n + na + j[here])
        x, y = known // n, known % n
        yield rows_of(x, y, sets.shared(x, y), True)
    for x, y, both in near(sets, np.arange(na), np.arange(na, n), threshold):
        new = ~np.isin(x * n + y, known)
        yield rows_of(x[new], y[new], both[new], False)

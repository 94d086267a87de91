"""Token ids of a whole corpus through its distinct words (problem 8).

Method: every scan batch is cut into pre-tokens and coded against a dictionary
of its own (positions are kept as index lists, so a pre-token that occurs a
million times in a batch travels once). The batch dictionaries are exploded,
the distinct words of the whole corpus are encoded once each, the ids are
joined back to (batch, index), and each document is reassembled by position.
Decoding joins the ids with the table of token bytes, which is bounded by the
vocabulary and held by every task: a batch's ids are looked up in it at once.

Defined cases: a null text and an empty text both give the empty list; text
that looks like a special token is ordinary text; repeated rows each give a
row; an empty table gives an empty result; other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise, parts_for, written_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The public pre-token pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _splitters():
    """The pattern for the regex library, and a quicker one for texts without odd characters.

    Python's own re agrees with the pattern except on some characters (numbers
    that are no decimal digits, the separators U+001C..U+001F, characters that
    only one of the two knows). Texts that hold one of these take the exact
    pattern; the characters are found by comparing the classes once a process.
    """
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    odd = sorted(
        {
            ord(c)
            for mine, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))
            for c in set(re.findall(mine, every)) ^ set(regex.findall(theirs, every))
        }
    )
    runs, start = [], odd[0]
    for a, b in zip(odd, odd[1:] + [-1]):
        if b != a + 1:
            runs.append(f"\\U{start:08x}-\\U{a:08x}")
            start = b
    quick = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    return regex.compile(PATTERN), quick, re.compile("[" + "".join(runs) + "]")


def pre_tokens(text: str) -> list[str]:
    exact, quick, odd = _splitters()
    return exact.findall(text) if odd.search(text) else quick.findall(text)


@functools.cache
def encoding(vocabulary: str):
    import tiktoken

    ranks = token_bytes(vocabulary)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in ranks}, special_tokens={})


def token_bytes(vocabulary: str) -> list[tuple[int, bytes]]:
    with open(vocabulary, "rb") as f:
        return [(int(i), base64.b64decode(b)) for b, i in map(bytes.split, f)]


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _lists(values: np.ndarray, ends: list[int] | np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.asarray(ends, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(values, dtype=np.int32)))


def _code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> rows of documents coded by their batch, and one row with the batch's words."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for n, batch in enumerate(batches):
        block = (part << 24) + n
        codes, flat, ends = _Codes(), [], []
        code = codes.__getitem__
        for text in batch.column(1).to_pylist():
            if text:
                flat.extend(map(code, pre_tokens(text)))
            ends.append(len(flat))
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * rows, pa.int64()), batch.column(0), _lists(np.array(flat, dtype=np.int32), ends), pa.nulls(rows, pa.list_(pa.string()))],
            names=["block", "key", "codes", "words"],
        )
        if codes:
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.list_(pa.int32())), pa.array([list(codes)], pa.list_(pa.string()))],
                names=["block", "key", "codes", "words"],
            )


def _encode_words(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            words = batch.column(0)
            flat, ends = [], []
            for w in words.to_pylist():
                flat.extend(enc.encode_ordinary(w))
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays([words, _lists(np.array(flat, dtype=np.int32), ends)], names=["word", "ids"])

    return run


def _reassemble(counts: bool):
    """Rows sorted by block, dictionary rows (kind 0, by index) before documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sizes, ids, ready = None, [], [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, sizes, ids, ready = blocks[a], [], [], None
                col = part.column(4)
                off = col.offsets.to_numpy().astype(np.int64)
                val = col.values.to_numpy()[off[0] : off[-1]] if len(col) else np.zeros(0, np.int32)
                off = off - off[0]
                if kinds[a] == 0:
                    sizes.append(np.diff(off))
                    ids.append(val)
                    continue
                if ready is None:
                    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                    ready = size, np.concatenate([[0], np.cumsum(size)]), np.concatenate(ids) if ids else np.zeros(0, np.int32)
                size, begin, flat = ready
                each = size[val] if len(val) else np.zeros(0, np.int64)
                upto = np.concatenate([[0], np.cumsum(each)])
                ends = upto[off[1:]]
                key = part.column(3)
                if counts:
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(np.concatenate([[0], ends])).astype(np.int64))], names=["key", "n"])
                    continue
                at = np.repeat(begin[val] - upto[:-1], each) + np.arange(upto[-1]) if len(val) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([key, _lists(flat[at], ends)], names=["key", "ids"])

    return run


def _run(df: DataFrame, key: str, text: str, vocabulary: str, counts: bool) -> DataFrame:
    kt = df.schema[key].dataType.simpleString()
    coded = materialise(
        df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
            _code_batches, f"block long, key {kt}, codes array<int>, words array<string>"
        ),
        "coded",
    )
    words = coded.where("words is not null").select("block", F.posexplode("words").alias("at", "word"))
    known = words.select("word").distinct().mapInArrow(_encode_words(vocabulary), "word string, ids array<int>")
    entries = words.join(known, "word").select(
        "block", F.lit(0).alias("kind"), "at", F.lit(None).cast(kt).alias("key"), F.col("ids").alias("list")
    )
    docs = coded.where("words is null").select("block", F.lit(1).alias("kind"), F.lit(0).alias("at"), "key", F.col("codes").alias("list"))
    parts = parts_for(df.sparkSession, 4 * written_bytes(coded))  # packed files hold about a quarter
    both = entries.unionByName(docs).repartition(parts, "block").sortWithinPartitions("block", "kind", "at")
    out = f"key {kt}, n long" if counts else f"key {kt}, ids array<int>"
    return both.mapInArrow(_reassemble(counts), out).withColumnRenamed("key", key)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row of df."""
    return _run(df, key, text, vocabulary, False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n): the number of tokens of every row of df, by the same plan without the ids."""
    return _run(df, key, text, vocabulary, True)


@functools.cache
def byte_table(vocabulary: str) -> pa.Array:
    """The bytes of each token by its id; ids that the vocabulary leaves out have none."""
    ranks = token_bytes(vocabulary)
    out = [b""] * (max(i for i, _ in ranks) + 1)
    for i, b in ranks:
        out[i] = b
    return pa.array(out, pa.binary())


def _join_bytes(vocabulary: str):
    """(key, ids) -> (key, text): a batch's ids joined with the byte table, and the bytes of each row put together."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(vocabulary)
        for batch in batches:
            ids = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type)) if batch.column(1).null_count else batch.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < len(table))
            parts = table.take(pa.array(np.where(known, flat, 0).astype(np.int64)))
            if not known.all():
                parts = pc.if_else(pa.array(known), parts, pa.scalar(b"", pa.binary()))
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int32)), parts)
            joined = pc.binary_join(rows, pa.scalar(b"", pa.binary()))
            try:
                text = joined.cast(pa.string())
            except pa.ArrowInvalid:  # some row is no UTF-8
                text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["key", "text"])

    return run


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids): each id joined with the token-byte table, in place.

    The join moves no row and keeps the order. An empty or null list decodes to the
    empty text; a null id or one outside the vocabulary adds nothing; bytes that are
    no UTF-8 become U+FFFD.
    """
    kt = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.filter(F.col(ids), lambda x: x.isNotNull()).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_join_bytes(vocabulary), f"key {kt}, text string").withColumnRenamed("key", key)

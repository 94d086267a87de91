"""Rate limits with windows that open at the first request after expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_windows(events: DataFrame, client: str, ts: str, order: str, window_s: int, most: int) -> DataFrame:
    """(order, window_start, n, blocked) of every event, in batch.

    A client's window opens at its first request, lasts ``window_s`` seconds and
    the next opens at the first request later than its end; a request is blocked
    if it is above ``most`` in its window. Rows are sorted by client and time and
    walked in a stream with one number of state, so a client with any number of
    requests needs no memory. Ties in time go by ``order``.
    """
    kinds = dict(events.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, start, n = None, 0, 0
        span = window_s * 1_000_000
        for b in batches:
            starts, counts, blocked = [], [], []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != who or t - start > span:
                    who, start, n = c, t, 0
                n += 1
                starts.append(start)
                counts.append(n)
                blocked.append(n > most)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(starts, pa.int64()), pa.array(counts, pa.int32()), pa.array(blocked, pa.bool_())], names=["k", "s", "n", "blocked"])

    rows = events.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(F.col(client).alias("c"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("k"))
    out = rows.repartition("c").sortWithinPartitions("c", "t", "k").mapInArrow(walk, f"k {kinds[order]}, s long, n int, blocked boolean")
    return out.select(F.col("k").alias(order), F.timestamp_micros("s").alias("window_start"), "n", "blocked")


def global_windows(events: DataFrame, ts: str, order: str, window_s: int, most: int) -> DataFrame:
    """(order, n, blocked) of every event under one limiter for all, to the second.

    Requests are counted by second first, so the one walk that can't be split
    sees a row a second, however many requests there are; each second then knows
    its window, and requests are numbered within their window.
    """
    rows = events.where(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("k"))
    rows = rows.withColumn("sec", F.floor(F.col("t") / 1_000_000))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = None
        for b in batches:
            starts = []
            for s in b.column(0).to_pylist():
                if start is None or s - start > window_s:
                    start = s
                starts.append(start)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64())], names=["sec", "start"])

    seconds = rows.select("sec").distinct().repartition(1).sortWithinPartitions("sec").mapInArrow(walk, "sec long, start long")
    n = F.row_number().over(Window.partitionBy("start").orderBy("t", "k"))
    return rows.join(seconds, "sec").withColumn("n", n).select(F.col("k").alias(order), "n", (F.col("n") > most).alias("blocked"))


def limiter(events: DataFrame, client: str, ts: str, window_s: int, most: int) -> DataFrame:
    """(client, ts, blocked) of a stream of events, with the window of each client as its state.

    Events may come late by one window. The state of a client is dropped once the
    watermark has passed its window's end by another window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("t")
        blocked = []
        for t in rows["t"]:
            if start is None or t - start > window_s * 1_000_000:
                start, n = int(t), 0
            n += 1
            blocked.append(n > most)
        state.update((int(start), n))
        state.setTimeoutTimestamp(max(start // 1000 + 2000 * window_s, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": [key[0]] * len(rows), "ts": rows["t"].to_list(), "blocked": blocked})

    kind = dict(events.dtypes)[client]
    timed = events.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(F.col(client).alias("client"), F.col(ts).cast("timestamp").alias("at"))
    rows = timed.withWatermark("at", f"{window_s} seconds").select("client", "at", F.unix_micros("at").alias("t"))
    out = rows.groupBy("client").applyInPandasWithState(step, f"client {kind}, ts long, blocked boolean", "start long, n int", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("client", F.timestamp_micros("ts").alias("ts"), "blocked")

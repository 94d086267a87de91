"""The audit log as a stream: redacted append, rolling error rates, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as fx


def redacted(log: DataFrame) -> DataFrame:
    """Rows of the log with personal data in details replaced; batch or stream."""
    return log.withColumn("details", fx.redact(F.col("details")))


def append(stream: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append the redacted stream to a parquet table, each row once (file sink with checkpoint)."""
    return redacted(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by key in event-time windows; rows later than ``late`` are dropped by the watermark."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
    )


def error_rate(events: DataFrame, ts: str, failed, hours: int = 24) -> DataFrame:
    """(day, n, rate): requests and share of failures of each day's preceding ``hours``, by sliding windows."""
    g = events.groupBy(F.window(ts, f"{hours} hours", "24 hours")).agg(F.count("*").alias("n"), F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("rate"))
    return g.select(F.col("window.end").alias("until"), "n", "rate")


def retained(log: DataFrame, as_of, days: int = 365) -> DataFrame:
    return log.where(F.col("created_at") >= F.lit(as_of) - F.expr(f"interval {days} days"))

"""Uploaded files as a source: reading, checks, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = ("txt", "md", "html", "json", "pdf", "doc", "docx")
#: Content that no text upload starts with.
SUSPICIOUS = r"(?i)<script|javascript:|<iframe|<\?php"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of every file below path, up to the size limit by a pushed-down filter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def decoded(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def checked(files: DataFrame) -> DataFrame:
    """files (path, name, content) with their size and what the checks say."""
    head = decoded(F.col("content"))
    return files.select(
        "*", F.octet_length("content").alias("bytes"), (F.octet_length("content") <= MAX_BYTES).alias("size_ok"),
        (~F.contains("path", F.lit(".."))).alias("path_ok"), (~F.rlike(F.substring(head, 1, 1024), F.lit(SUSPICIOUS))).alias("content_ok"),
        F.lower(F.substring_index("name", ".", -1)).isin(*EXTENSIONS).alias("extension_ok"),
    )

"""Queries of the core operators with the SQL that must give the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, lists: tuple[str, ...] = (), times: tuple[str, ...] = ()):
    """Register a query under its function's name, with its SQL if it has one.

    Columns named in ``lists`` come out as JSON text and those in ``times`` as
    microseconds, from both, so that any client compares them alike.
    """

    def add(f):
        run, text = f, sql
        if lists or times:

            @functools.wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                df = f(spark, d)
                return df.withColumns({**{c: F.to_json(c, {"ignoreNullFields": "false"}) for c in lists}, **{c: F.unix_micros(F.col(c).cast("timestamp")) for c in times}})

            if sql:
                new = [f"cast(to_json({c}) as varchar) as {c}" for c in lists] + [f"epoch_us({c}) as {c}" for c in times]
                text = f"select * replace ({', '.join(new)}) from ({sql})"
        QUERIES[f.__name__] = run
        if text:
            SQL[f.__name__] = text
        return f

    return add


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references by field, period and kind."""
    return QUERIES["p5_report"](spark, d)


from tessera.catalog import claims, references, relational, scoring, similarity, streams, text, topics  # noqa: E402,F401

"""Repository operators: filters, lookups, paging, nested collects, statistics, updates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def all_of(predicates: Iterable[Column | None]) -> Column:
    """The conjunction of the predicates that are present."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def evidence_filter(
    *, min_quality: float | None = None, max_quality: float | None = None, source_ids: Sequence[str] | None = None,
    topics: Sequence[str] | None = None, exact_topics: bool = False, after=None, before=None, search: str | None = None,
) -> Column:
    """Optional filters of evidence; what is not given (a minimum of 0 included) filters nothing."""
    return all_of([
        F.col("quality_score") >= min_quality if min_quality else None,
        F.col("quality_score") <= max_quality if max_quality is not None else None,
        F.col("source_id").isin(list(source_ids)) if source_ids else None,
        (has_topic(topics) if exact_topics else topic_text(topics)) if topics else None,
        F.col("created_at") >= F.lit(after) if after is not None else None,
        F.col("created_at") <= F.lit(before) if before is not None else None,
        keyword_search(search, ["snippet"]) if search and search.strip() else None,
    ])


def topic_text(topics: Sequence[str], column: str = "topics") -> Column:
    """Any topic as a substring of the JSON text."""
    return reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(t)) for t in topics])


def topic_list(column: str = "topics") -> Column:
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def has_topic(topics: Sequence[str], column: str = "topics") -> Column:
    """Any topic as an element of the JSON array."""
    return F.arrays_overlap(topic_list(column), F.array(*[F.lit(t) for t in topics]))


def keyword_search(term: str, columns: Sequence[str]) -> Column:
    """Any word of the term in any column, without case, as a literal substring; a blank term matches all."""
    words = term.lower().split()
    tests = [F.contains(F.lower(F.col(c)), F.lit(w)) for c in columns for w in words]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def phrase_search(term: str, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in columns])


def page(df: DataFrame, number: int, limit: int, order: Sequence[Column]) -> DataFrame:
    """A page of df with the totals in each row. ``order`` must be total for a stable page.

    The total is one count, joined as a single row; the page is a top-k of
    number * limit rows, so the table is never sorted as a whole.
    """
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(number * limit).offset((number - 1) * limit)
    pages = F.ceil(F.col("total") / limit).cast("long")
    return rows.crossJoin(F.broadcast(total)).select(  # one row of totals
        *df.columns, "total", F.lit(number).alias("page"), pages.alias("total_pages"),
        (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"),
    )


def envelope(paged: DataFrame) -> DataFrame:
    """Adds the numbers of the next and the previous page, null where there is none."""
    return paged.select(
        "*", F.when(F.col("has_next"), F.col("page") + 1).alias("next_page"), F.when(F.col("has_prev"), F.col("page") - 1).alias("prev_page")
    )


def top_per_parent(df: DataFrame, parent: str, n: int, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= n)


def child_counts(parents: DataFrame, key: str, children: DataFrame, fk: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 where there are none."""
    n = children.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def nested(parents: DataFrame, key: str, children: DataFrame, fk: str, columns: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """parents with their children as an array of structs, sorted by ``order``; childless ones get an empty array."""
    got = children.groupBy(F.col(fk).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("__l"))
    slim = F.transform("__l", lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    kinds = {c: t for c, t in children.dtypes}
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in columns) + ">>")
    return parents.join(got, key, "left").withColumn(name, F.coalesce(slim, empty)).drop("__l")


def update(df: DataFrame, key: str, updates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the non-null values of updates (key, columns) in place of its own."""
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def delete_cascade(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str]], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """tables without the rows of root in gone (id) and all that hangs on them.

    links: (child, foreign key, parent) in order from the root down.
    """
    lost = {root: gone.select("id")}
    left = dict(tables)
    left[root] = tables[root].join(lost[root], "id", "left_anti")
    for child, fk, parent in links:
        dead = tables[child].join(lost[parent].withColumnRenamed("id", fk), fk, "left_semi")
        lost[child] = dead.select("id")
        left[child] = tables[child].join(lost[parent].withColumnRenamed("id", fk), fk, "left_anti")
    return left


def orphan_counts(checks: Sequence[tuple[str, DataFrame, str, DataFrame]]) -> DataFrame:
    """(relation, orphans): rows of each child without parent, by anti-join."""
    parts = [
        child.where(F.col(fk).isNotNull()).join(parent.select(F.col("id").alias(fk)), fk, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
        for name, child, fk, parent in checks
    ]
    return reduce(DataFrame.unionByName, parts)


def buckets(value: Column, high: float, medium: float, unscored: bool = False, null_as_zero: bool = False) -> dict[str, Column]:
    """Counts of high, medium and low values; nulls are skipped, counted apart or taken as 0."""
    v = F.coalesce(value, F.lit(0.0)) if null_as_zero else value
    out = {
        "high": F.count_if(v >= high), "medium": F.count_if((v >= medium) & (v < high)), "low": F.count_if(v < medium),
    }
    if unscored:
        out["unscored"] = F.count_if(value.isNull())
    return out

"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import boilerplate, mixing, neardup, personal, pieces, repeats, tokens, truncation
from tessera.llm import sentences as op_sentences
from tessera.runtime import latest, materialise, shared_root, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@query("select doc_id, coalesce(text, '') as text from documents")
def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text out of its ids again."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


SPACES = ["evidence_units", "sources"]


def texts_for_neardup(spark: SparkSession, d: str) -> DataFrame:
    u = latest(table(spark, d, "evidence_units"), "id", "loaded_at").select(F.lit(0).alias("space"), "id", F.col("snippet").alias("text"))
    s = latest(table(spark, d, "sources"), "id", "updated_at").select(F.lit(1).alias("space"), "id", F.col("text_norm").alias("text"))
    return u.unionByName(s)


def space_name(c: str = "space"):
    return F.when(F.col(c) == 0, SPACES[0]).otherwise(SPACES[1])


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(texts_for_neardup(spark, d)).select(space_name().alias("item_table"), "id_a", "id_b")


@query()
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(texts_for_neardup(spark, d)).select(space_name().alias("item_table"), "id", "class_id", "group_id", "n_links")


SITE = r"""nullif(regexp_replace(regexp_replace(lower(trim(coalesce(nullif(trim(domain), ''),
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)))), '^www\.', ''), '\.$', ''), '')"""
P2 = rf"""
with pages as (
  select id, {SITE} as site, text_raw from (select *, row_number() over (partition by id order by updated_at desc) as rn from sources where id is not null) where rn = 1
), raw as (
  select site, id, unnest(string_split(text_raw, chr(10))) as line, generate_subscripts(string_split(text_raw, chr(10)), 1) - 1 as line_no
  from pages where site is not null and text_raw <> ''
), lines as (
  select site, id, cast(line_no as int) as line_no, trim(regexp_replace(lower(line), '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) as t from raw
), often as (
  select site, t from lines where t <> '' group by 1, 2 having count(distinct id) >= 5
)
"""


@query(P2 + "select id as source_id, line_no from lines join often using (site, t)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lines, _ = repeats.prefix_span(table(spark, d, "sources"))
    return lines.select(F.col("id").alias("source_id"), "line_no")


@query(P2 + """, l as (select *, row_number() over (partition by id order by line_no) as seq from lines join often using (site, t)),
  g as (select distinct a.site, a.id, a.t as t1, b.t as t2 from l a join l b on a.id = b.id and b.seq > a.seq),
  h as (select distinct a.site, a.id, a.t as t1, b.t as t2, c.t as t3 from l a join l b on a.id = b.id and b.seq > a.seq join l c on a.id = c.id and c.seq > b.seq)
  select site, 1 as length, count(*) as n_sequences, cast(sum(n) as bigint) as n_pages from (select site, t, count(distinct id) as n from l group by 1, 2) group by 1
  union all select site, 2, count(*), cast(sum(n) as bigint) from (select site, t1, t2, count(*) as n from g group by 1, 2, 3 having count(*) >= 5) group by 1
  union all select site, 3, count(*), cast(sum(n) as bigint) from (select site, t1, t2, t3, count(*) as n from h group by 1, 2, 3, 4 having count(*) >= 5) group by 1""")
def p2_sequences(spark: SparkSession, d: str) -> DataFrame:
    """How many frequent sequences of each length up to three each site has, gaps allowed, and their supports in all."""
    _, seqs = repeats.prefix_span(table(spark, d, "sources"))
    return seqs.groupBy("site", "length").agg(F.count("*").alias("n_sequences"), F.sum("support").alias("n_pages"))


@query(P2 + """, gone as (select distinct id, line_no from lines join often using (site, t)),
  every as (select id, unnest(string_split(text_raw, chr(10))) as line, generate_subscripts(string_split(text_raw, chr(10)), 1) - 1 as line_no from pages where text_raw is not null),
  kept as (select e.id, string_agg(e.line, chr(10) order by e.line_no) as text from every e left join gone g on g.id = e.id and g.line_no = e.line_no where g.id is null group by 1)
  select p.id as source_id, case when p.text_raw is not null then coalesce(k.text, '') end as text from pages p left join kept k using (id)""")
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every page without its site's repeated lines."""
    src = table(spark, d, "sources")
    lines, _ = repeats.prefix_span(src)
    return repeats.without(src, lines)


def texts_with_limits(spark: SparkSession, d: str) -> DataFrame:
    """(space, id, text, max_chars, overlap) of the columns that split_limits names."""
    limits = table(spark, d, "split_limits")
    out = None
    for space, (name, column, stamp) in enumerate((("evidence_units", "snippet", "loaded_at"), ("sources", "text_raw", "updated_at"))):
        limit = F.broadcast(limits.where((F.col("item_table") == name) & (F.col("item_column") == column)).groupBy().agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap")))
        texts = latest(table(spark, d, name), "id", stamp).select(F.lit(space).alias("space"), "id", F.col(column).alias("text"))
        part = texts.crossJoin(limit)  # one row of limits
        out = part if out is None else out.unionByName(part)
    return out


@query("""select distinct 'evidence_units' as item_table, id as item_id from evidence_units, split_limits where item_table = 'evidence_units' and length(snippet) > max_chars
  union all select distinct 'sources', id from sources, split_limits where item_table = 'sources' and length(text_raw) > max_chars""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.pieces(pieces.oversized(texts_with_limits(spark, d)))
    return cut.where("piece = 1").select(space_name().alias("item_table"), F.col("id").alias("item_id"))


@query()
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.pieces(texts_with_limits(spark, d))
    return cut.select(space_name().alias("item_table"), F.col("id").alias("item_id"), "piece", "char_start", "char_end")


@query()
def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all sources as a few large files, cut by byte ranges."""
    most, overlap = table(spark, d, "split_limits").where("item_table = 'sources'").agg(F.max("max_chars"), F.max("overlap_chars")).first()  # one row
    folder = f"{shared_root(spark)}/texts-{uuid.uuid4().hex[:12]}"
    texts = latest(table(spark, d, "sources"), "id", "updated_at").where("text_raw <> ''").repartition(4, "id").sortWithinPartitions("id")
    texts.select("text_raw").write.text(folder)
    cut = pieces.file_pieces(spark, pieces.files_below(spark, folder), most, overlap, range_bytes=1 << 20)
    return cut.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("file"), "piece", "char_start", "char_end")


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fields = latest(table(spark, d, "claim_fields"), "id", "updated_at")
    return op_sentences.sentences(fields).withColumnRenamed("id", "claim_field_id")


def unit_site():
    return repeats.site(F.col("source_domain"), F.lit("")).alias("site")


def inspected_units(spark: SparkSession, d: str) -> DataFrame:
    units = latest(table(spark, d, "evidence_units"), "id", "loaded_at").select("id", "source_id", unit_site(), F.col("snippet").alias("t"), F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    sources = latest(table(spark, d, "sources"), "id", "updated_at").select("id", F.col("text_raw").alias("text"))
    return truncation.inspect(units, sources)


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return inspected_units(spark, d).where("cut").select(F.col("id").alias("evidence_unit_id"))


@query()
def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(inspected_units(spark, d))


@query()
def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Storage limits that the lengths of the snippets show, of each site and of all (site null)."""
    units = latest(table(spark, d, "evidence_units"), "id", "loaded_at").select(F.col("snippet").alias("t"), unit_site()).where("t is not null and trim(t) <> ''")
    return truncation.storage_limits(materialise(truncation.length_counts(truncation.with_lengths(units)), "counts"))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(table(spark, d, "documents"))


@query()
def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.mask(table(spark, d, "documents"), b"a secret that the caller keeps")


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.article_lines(table(spark, d, "sources"))


@query()
def p4_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """The wrapper of each site."""
    return boilerplate.wrappers(table(spark, d, "sources"))

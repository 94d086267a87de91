"""References to records that do not exist (problem 5).

Method: the distinct parent keys are cut into ranges at sampled quantiles of
their sort order. The parents of a range form sorted arrays (key, first time,
flags); batches of references to the range are probed against them by vectorised
binary search. A range that draws many references is split over several tasks,
each with the same sorted arrays, so no hot parent holds up one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise, parts_for, written_bytes

#: What the probe knows of a parent key.
PARENT = "kind string, id string, first long, present boolean, deleted boolean, logged boolean"


def parents(units: DataFrame, fields: DataFrame, audit: DataFrame) -> DataFrame:
    """(kind, id, first, present, deleted, logged): one row per key that exists or whose deletion was logged.

    kind is the referring column. ``first`` is in microseconds; for a unit its
    first loaded_at, for a claim field its first created_at. ``deleted`` says
    that a row has deleted_at, ``logged`` that the log has a DELETE of the key;
    it counts for units and fields by the log's entity, letters only.
    """
    entity = F.lower(F.regexp_replace("entity", "[^A-Za-z]", ""))
    kind = F.when(entity.isin("evidenceunit", "evidenceunits"), "evidence_ids").when(entity.isin("claimfield", "claimfields"), "claim_field_id")
    no, yes = F.lit(False), F.lit(True)
    rows = (
        units.select(F.lit("evidence_ids").alias("kind"), F.trim("id").alias("id"), F.unix_micros("loaded_at").alias("first"), yes.alias("present"), F.col("deleted_at").isNotNull().alias("deleted"), no.alias("logged"))
        .unionByName(
            fields.select(F.lit("claim_field_id").alias("kind"), F.trim("id").alias("id"), F.unix_micros("created_at").alias("first"), yes.alias("present"), no.alias("deleted"), no.alias("logged"))
        )
        .unionByName(
            audit.where(F.upper(F.trim("action")) == "DELETE")
            .select(kind.alias("kind"), F.trim("entity_id").alias("id"), F.lit(None).cast("long").alias("first"), no.alias("present"), no.alias("deleted"), yes.alias("logged"))
        )
    )
    return rows.where("kind is not null and id is not null").groupBy("kind", "id").agg(
        F.min("first").alias("first"), *(F.max(c).alias(c) for c in ("present", "deleted", "logged"))
    )


def citation_references(citations: DataFrame) -> DataFrame:
    """(kind, id, citation_id, period, used): one row per distinct reference of a citation.

    Deliveries of a citation count once, ``used`` is the first loaded_at. Null
    and blank elements refer to nothing, as do arrays that can't be parsed.
    """
    c = citations.where("id is not null").groupBy(F.col("id").alias("citation_id"), F.trim("claim_field_id").alias("field"), "evidence_ids").agg(
        F.min("created_at").alias("created_at"), F.min("loaded_at").alias("loaded_at")
    )
    ids = F.from_json("evidence_ids", "array<string>")
    one = c.select(
        "citation_id", F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM").alias("period"), F.unix_micros("loaded_at").alias("used"),
        F.explode(F.concat(
            F.array(F.struct(F.lit("claim_field_id").alias("kind"), F.col("field").alias("id"))),
            F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.struct(F.lit("evidence_ids").alias("kind"), F.trim(x).alias("id"))),
        )).alias("r"),
    )
    return (
        one.select("r.kind", "r.id", "citation_id", "period", "used").where("id is not null and id <> ''")
        .groupBy("kind", "id", "citation_id", "period").agg(F.min("used").alias("used"))
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, side): the parents of a part in key order, then its references."""
    part, keys, first, flags, ready = None, [], [], [], None
    names = ["ref_field", "citation_id", "ref_id", "kind", "period"]
    for batch in batches:
        parts = batch.column("part").to_numpy()
        sides = batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(sides) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            rows = batch.slice(a, b - a)
            if parts[a] != part:
                part, keys, first, flags, ready = parts[a], [], [], [], None
            key = rows.column("key").to_numpy(zero_copy_only=False)
            when = rows.column("at").fill_null(-(2**62)).to_numpy()
            if sides[a] == 0:
                keys.append(key)
                first.append(when)
                flags.append(rows.column("flags").to_numpy())
                continue
            if ready is None:
                ready = (np.concatenate(keys), np.concatenate(first), np.concatenate(flags)) if keys else (np.array([], object), np.array([], np.int64), np.array([], np.int32))
            k, f, g = ready
            at = np.searchsorted(k, key) if len(k) else np.zeros(len(key), np.int64)
            hit = np.zeros(len(key), bool)
            inside = at < len(k)
            hit[inside] = k[at[inside]] == key[inside]
            flag = np.zeros(len(key), np.int32)
            flag[hit] = g[at[hit]]
            late = np.zeros(len(key), bool)
            late[hit] = (f[at[hit]] > when[hit]) & (when[hit] > -(2**62))
            absent = flag & 1 == 0
            gone = (flag & 2 != 0) | absent & (flag & 4 != 0)
            kind = np.where(gone, "deleted", np.where(absent, "missing", np.where(late, "late", "")))
            bad = np.flatnonzero(kind != "")
            if len(bad):
                take = rows.take(pa.array(bad))
                yield pa.RecordBatch.from_arrays(
                    [take.column("kind"), take.column("citation_id"), take.column("id"), pa.array(kind[bad].tolist(), pa.string()), take.column("period")], names=names
                )


def orphans(refs: DataFrame, parent: DataFrame, range_rows: int = 200_000, task_refs: int = 400_000) -> DataFrame:
    """(ref_field, citation_id, ref_id, kind, period) of every reference without a valid target.

    kind is 'deleted' if the key's row is marked as deleted, or if it has no row
    and the log has its deletion; else 'missing' if it has no row; else 'late' if
    it came after the reference was used. A logged deletion of a key that has a
    row again says nothing. Parents with a null
    time are never late. Empty tables give an empty result or only 'missing'.
    """
    refs = materialise(refs, "refs")
    parent = materialise(parent, "parents")
    key = F.concat_ws(":", "kind", "id")
    n = parent.count()
    cuts: list[str] = []
    if n > range_rows:
        ranges = min(-(-n // range_rows), 20_000)
        share = min(1.0, 20 * ranges / n)  # about twenty sampled keys a range place the cuts, 400,000 in all at most
        got = sorted(r.k for r in parent.sample(share, 7).select(key.alias("k")).collect())
        cuts = sorted({got[i * len(got) // ranges] for i in range(1, ranges)}) if got else []

    def bucket(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, dtype=object)
        for b in it:
            at = np.searchsorted(edges, b.column("key").to_numpy(zero_copy_only=False), side="right") if len(edges) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "bucket"])

    wide = "key string, kind string, id string, at long, flags int, citation_id string, period string"
    p = parent.select(
        key.alias("key"), "kind", "id", F.col("first").alias("at"),
        (F.col("present").cast("int") + F.col("deleted").cast("int") * 2 + F.col("logged").cast("int") * 4).alias("flags"),
        F.lit(None).cast("string").alias("citation_id"), F.lit(None).cast("string").alias("period"),
    ).mapInArrow(bucket, wide + ", bucket int")
    r = materialise(
        refs.select(key.alias("key"), "kind", "id", F.col("used").alias("at"), F.lit(0).alias("flags"), "citation_id", "period").mapInArrow(bucket, wide + ", bucket int"),
        "bucketed",
    )
    load = r.groupBy("bucket").agg(F.ceil(F.count("*") / task_refs).cast("int").alias("split"))  # a row per range
    load = F.broadcast(load)
    p = p.join(load, "bucket").select(*p.columns, F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("salt"))
    r = r.join(load, "bucket").select(*r.columns, F.lit(1).alias("side"), F.pmod(F.xxhash64("citation_id"), F.col("split")).cast("int").alias("salt"))
    both = p.unionByName(r).withColumn("part", F.col("bucket").cast("long") * 1_000_000 + F.col("salt"))
    parts = parts_for(refs.sparkSession, 8 * (written_bytes(r) + written_bytes(parent)))  # packed files hold about an eighth
    return both.repartition(parts, "part").sortWithinPartitions("part", "side", "key").mapInArrow(
        _probe, "ref_field string, citation_id string, ref_id string, kind string, period string"
    )


def report(found: DataFrame) -> DataFrame:
    """Orphan references by field, period and kind."""
    return found.groupBy("ref_field", "period", "kind").agg(F.count("*").alias("n_refs"), F.count_distinct("citation_id").alias("n_citations"))

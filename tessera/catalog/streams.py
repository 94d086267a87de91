"""Queries of limits, usage and the audit log (STM, AGG11, AGG25, AGG29)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as fx
from tessera.plans import views as v
from tessera.plans.views import with_views as w
from tessera.runtime import shared_root, table
from tessera.streaming import audit as au
from tessera.streaming import limits as li

C = F.col


@query("""with recursive o as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null and ts is not null),
  r as (select event_id, user_id, t, k, t as s, 1 as n from o where k = 1
    union all select o.event_id, o.user_id, o.t, o.k, case when o.t - r.s > 86400000000 then o.t else r.s end, case when o.t - r.s > 86400000000 then 1 else r.n + 1 end from r join o on o.user_id = r.user_id and o.k = r.k + 1)
  select event_id, n::int as n, n > 2 as blocked from r""")
def stm1_client_limit(spark: SparkSession, d: str) -> DataFrame:
    return li.fixed_windows(table(spark, d, "events"), "user_id", "ts", "event_id", 86_400, 2).select("event_id", "n", "blocked")


@query()
def stm1_client_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The limiter over the events as a stream, drained; the verdicts are read back from its sink."""
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    import uuid

    out = f"{shared_root(spark)}/limits-{uuid.uuid4().hex[:12]}"
    q = li.limiter(stream, "user_id", "ts", 86_400, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("client long, ts timestamp, blocked boolean").parquet(out)


@query("""with recursive o as (select sec, row_number() over (order by sec) as k from (select distinct cast(floor(epoch(ts)) as bigint) as sec from events where ts is not null)),
  r as (select sec, k, sec as s from o where k = 1 union all select o.sec, o.k, case when o.sec - r.s > 60 then o.sec else r.s end from r join o on o.k = r.k + 1)
  select event_id, n::int as n, n > 5 as blocked from (select event_id, row_number() over (partition by r.s order by ts, event_id) as n from events join r on r.sec = cast(floor(epoch(ts)) as bigint))""")
def stm2_global_limit(spark: SparkSession, d: str) -> DataFrame:
    return li.global_windows(table(spark, d, "events"), "ts", "event_id", 60, 5)


@query("""with recursive o as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null and ts is not null),
  r as (select event_id, user_id, t, k, t as s, false as hit from o where k = 1
    union all select o.event_id, o.user_id, o.t, o.k, case when o.t - r.s > 300000000 then o.t else r.s end, o.t - r.s <= 300000000 from r join o on o.user_id = r.user_id and o.k = r.k + 1)
  select event_id, hit from r""")
def stm3_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests that a cache answers which keeps an answer for 300 seconds from when it was made.

    A request is a hit unless it opens a window of its key. How many answers the
    cache can hold doesn't matter to a batch: it is a matter of memory.
    """
    return li.fixed_windows(table(spark, d, "events"), "user_id", "ts", "event_id", 300, 1).select("event_id", C("blocked").alias("hit"))


@query()
def stm3_first_requests_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream without those whose key was seen within the watermark: those that no cache answers."""
    import uuid

    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"{shared_root(spark)}/first-{uuid.uuid4().hex[:12]}"
    rows = stream.where("user_id is not null and ts is not null").withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", "300 seconds").dropDuplicatesWithinWatermark(["user_id"])
    rows.select("event_id", "user_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("select date_trunc('day', ts) + interval 1 day as until, count(*) as n, round(avg(case when value is null or value < 1 then 1.0 else 0.0 end), 6) as rate from events group by 1", times=("until",))
def stm4_error_rate(spark: SparkSession, d: str) -> DataFrame:
    r = au.error_rate(table(spark, d, "events"), "ts", C("value").isNull() | (C("value") < 1))
    return r.select("until", "n", F.round("rate", 6).alias("rate"))


@query(w("a", "select id, action from a where created_at >= timestamptz '2024-12-31 00:00:00+00' - interval 365 day"))
def stm5_retention(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    return au.retained(v.audit(spark, d), dt.datetime(2024, 12, 31, tzinfo=dt.timezone.utc)).select("id", "action")


@query(f"select id, details, count(*) as n from (select id, {fx.redact_sql('details')} as details from audit_logs) group by 1, 2")
def stm5_audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log streamed through redaction into an append-only table, then counted by id and redacted details."""
    import uuid

    log = table(spark, d, "audit_logs")
    stream = spark.readStream.schema(log.schema).option("pathGlobFilter", "audit_logs.parquet").parquet(d)
    out = f"{shared_root(spark)}/audit-{uuid.uuid4().hex[:12]}"
    au.append(stream, out, out + "-state").awaitTermination()
    return spark.read.schema(log.schema).parquet(out).groupBy("id", "details").agg(F.count("*").alias("n"))


CONF = "try_cast(case when json_valid(metadata) then metadata ->> '$.confidenceScore' end as double)"


@query(w("u", f"select count(*) filter (where k) as kept, count(*) filter (where not k) as rejected, round(avg(quality_score) filter (where k), 6) as avg_quality, round(avg({CONF}) filter (where k), 6) as avg_confidence, round(avg(length(snippet)) filter (where k), 6) as avg_size from (select *, coalesce({CONF} >= 0.3 and quality_score >= 0.4, false) as k from u)"))
def agg11_run_stats(spark: SparkSession, d: str) -> DataFrame:
    conf = F.get_json_object("metadata", "$.confidenceScore").try_cast("double")
    u = v.units(spark, d).withColumn("conf", conf).withColumn("k", F.coalesce((conf >= 0.3) & (C("quality_score") >= 0.4), F.lit(False)))
    avg = lambda c: F.round(F.avg(F.when(C("k"), c)), 6)
    return u.agg(F.count_if("k").alias("kept"), F.count_if(~C("k")).alias("rejected"), avg(C("quality_score")).alias("avg_quality"), avg(C("conf")).alias("avg_confidence"), avg(F.length("snippet")).alias("avg_size"))


@query("""select event_type, count(*) as n, round(sum(coalesce(value, 0)), 4) as tokens, round(avg(case when value = 0 or value is null then 1.0 else 0.0 end), 6) as error_rate
  from events where ts >= (select max(ts) from events) - interval 24 hour group by 1""")
def agg25_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    last = e.crossJoin(newest).where("ts >= newest - interval 24 hours")  # one row
    bad = F.when((C("value") == 0) | C("value").isNull(), 1.0).otherwise(0.0)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("tokens"), F.round(F.avg(bad), 6).alias("error_rate"))


@query("""select event_type, count(*) as n, round(sum(coalesce(value, 0)), 4) as tokens, round(avg(case when value = 0 or value is null then 1.0 else 0.0 end), 6) as error_rate
  from (select * from events where ts is not null order by ts desc, event_id desc limit 1000) group by 1""")
def agg25_last_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage over the ring of the last 1,000 requests."""
    last = table(spark, d, "events").where("ts is not null").orderBy(C("ts").desc(), C("event_id").desc()).limit(1000)
    bad = F.when((C("value") == 0) | C("value").isNull(), 1.0).otherwise(0.0)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("tokens"), F.round(F.avg(bad), 6).alias("error_rate"))


@query("select event_type, count(*) filter (where value > 0) as succeeded, count(*) filter (where not coalesce(value > 0, false)) as failed, round(sum(value), 4) as tokens, round(sum(value) * 0.002, 4) as cost from events group by 1")
def agg29_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(C("value") > 0, F.lit(False))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.sum("value") * 0.002, 4).alias("cost"))


@query("select case when bad * 2 >= n then 'unhealthy' when bad > 0 then 'degraded' else 'healthy' end as status, n, bad from (select count(*) as n, count(*) filter (where k = 0) as bad from (select event_type, count(*) filter (where value > 100) as k from events group by 1))")
def agg28_health(spark: SparkSession, d: str) -> DataFrame:
    """Unhealthy if at least half of the parts are, degraded if any is."""
    parts = table(spark, d, "events").groupBy("event_type").agg(F.count_if(C("value") > 100).alias("k"))
    g = parts.agg(F.count("*").alias("n"), F.count_if(C("k") == 0).alias("bad"))
    return g.select(F.when(C("bad") * 2 >= C("n"), "unhealthy").when(C("bad") > 0, "degraded").otherwise("healthy").alias("status"), "n", "bad")

"""Streaming queries: the events table read as a stream."""

from pyspark.sql import functions as F

from reapline.catalog import access as access_queries
from reapline.catalog import inputs, traces
from reapline.catalog.registry import query, table
from reapline.operators.traces import price_usage
from reapline.streaming import ledger, progress, sinks
from reapline.streaming.traces import stream_sessions, stream_trace_summary, stream_trace_windows


def events_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def timed_trace(spark, folder):
    return inputs.trace(spark, folder).withColumn("started_at", F.col("started_at").cast("timestamp"))


def _newest(df, keys):
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


@query("stream_trace_summary", traces.PRICED + " select * from summary")
def stream_summary(spark, folder):
    summary = lambda s: stream_trace_summary(price_usage(s, inputs.prices(spark)))
    return _newest(sinks.feed(timed_trace(spark, folder), F.unix_micros("started_at"), summary, "update"), ["thread_id"])


@query(
    "stream_trace_windows",
    f"""with {inputs.TRACE_SQL} select time_bucket(interval '6 hours', started_at) as window_start, event_type, count(*) as events,
      cast(sum(total_tokens) as bigint) as total_tokens, round(cast(sum(cast(duration_ms as decimal(18,6))) as double), 3) as duration_ms from trace group by 1, 2""",
)
def stream_windows(spark, folder):
    windows = lambda s: stream_trace_windows(s, "6 hours", "1 hour")
    return _newest(sinks.feed(timed_trace(spark, folder), F.unix_micros("started_at"), windows, "update"), ["window_start", "event_type"])


@query(
    "stream_access_ledger",
    f"""with {access_queries.LEDGER_SQL}
    select cast(d as varchar) as domain, seq, 'allowed' as reason, started as window_started, cast(waited as bigint) as waited_us from sched
    union all select cast(d as varchar), seq, 'domain_request_budget_exhausted', started, 0 from ranked where n > 2
    union all select cast(d as varchar), seq, 'domain_cooldown', null, 0 from c where not refused and coalesce(t < until, false)""",
)
def stream_ledger(spark, folder):
    ledger.use_rocksdb(spark)
    seen = access_queries.events_of(table(spark, folder, "events"))
    decided = sinks.feed(seen, F.col("t"), lambda s: ledger.stream_access_ledger(s, max_requests=2, window_seconds=86400))
    return decided.select("domain", "seq", "reason", "window_started", "waited_us")


@query(
    "stream_dedup",
    "select event_type || cast(user_id as varchar) as request_id, min(epoch_us(ts)) as first_seen from events group by 1",
)
def stream_dedup(spark, folder):
    ledger.use_rocksdb(spark)
    stream = events_stream(spark, folder).select(
        F.concat("event_type", F.col("user_id").cast("string")).alias("request_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    kept = sinks.drain(sinks.dedup_actions(stream, "ts", "60 days"))
    return kept.groupBy("request_id").agg(F.min(F.unix_micros("ts")).alias("first_seen"))


@query(
    "stream_sessions",
    f"""with {inputs.TRACE_SQL},
    marked as (select *, lag(started_at) over (partition by thread_id order by started_at, id) as before from trace),
    numbered as (select *, sum(case when before is null or epoch_us(started_at) - epoch_us(before) >= 7200000000 then 1 else 0 end)
      over (partition by thread_id order by started_at, id) as session_no from marked)
    select thread_id, min(started_at) as session_start, max(started_at) + interval '2 hours' as session_end, count(*) as events,
      cast(sum(total_tokens) as bigint) as total_tokens from numbered group by thread_id, session_no""",
)
def stream_session_runs(spark, folder):
    """Events arrive up to half an hour late; a last sign of life without a thread closes all sessions."""
    seen = timed_trace(spark, folder).select("id", "thread_id", "started_at", "total_tokens")
    late = F.pmod(F.xxhash64("id"), F.lit(1800)) * 1_000_000
    beat = seen.agg((F.max("started_at") + F.expr("interval 1 day")).alias("started_at")).where("started_at is not null")
    beat = seen.limit(0).unionByName(beat, allowMissingColumns=True)
    closed = sinks.feed(seen, F.unix_micros("started_at") + late, lambda s: stream_sessions(s, "2 hours", "1 hour"), last=beat)
    return closed.drop("batch")


@query(
    "stream_quarantine",
    """with e as (select event_type = 'error' as failed, cast(user_id as varchar) as cache_id, epoch_us(ts) as t, event_id as seq from events),
    u as (select *, max(t) filter (failed) over (partition by cache_id order by t, seq rows between unbounded preceding and 1 preceding) as last_failure from e)
    select cache_id, seq, coalesce(t >= last_failure + 21600000000, true) as allowed from u where not failed""",
)
def stream_quarantine(spark, folder):
    ledger.use_rocksdb(spark)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = table(spark, folder, "events").select(
        F.lit("dom").alias("cache_type"), F.lit("site").alias("domain_key"), F.col("user_id").cast("string").alias("cache_id"), t.alias("t"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failure").otherwise("hit").alias("kind"),
    )
    return sinks.feed(seen, F.col("t"), lambda s: ledger.stream_quarantine(s, 6 * 3600)).select("cache_id", "seq", "allowed")


@query(
    "stream_progress",
    """with e as (select cast(user_id as varchar) as thread_id, event_id as seq, event_id % 40 as item, event_id % 7 + 1 as page,
      case event_type when 'signup' then 'filter' when 'click' then 'scroll' else 'collect' end as kind from events),
    n as (select *, row_number() over (partition by thread_id, item order by seq) = 1 as is_new,
      max(case when kind = 'filter' then seq end) over (partition by thread_id) as filtered from e),
    c as (select *, sum(case when is_new then 1 else 0 end) over (partition by thread_id order by seq) as items from n),
    r as (select *, max(case when kind = 'scroll' and (is_new or items - case when is_new then 1 else 0 end = 0) then seq end) over (partition by thread_id) as grown from c),
    s as (select thread_id, max(seq) as seq, max(items) as item_count,
      count(distinct case when kind = 'collect' and seq > coalesce(filtered, -1) then page end) as completed_pages,
      count(case when kind = 'scroll' and seq > coalesce(grown, -1) then 1 end) as stagnant_rounds,
      coalesce(max(case when kind = 'scroll' then page end), 0) as scroll_round, bool_or(item = 17) as stop_condition_met from r group by thread_id)
    select thread_id, seq, cast(item_count as bigint) as item_count, completed_pages, stagnant_rounds, scroll_round, stop_condition_met,
      (item_count >= 30 and completed_pages >= 3 or stop_condition_met) and scroll_round >= 5 as is_done, 4 as state_version from s""",
)
def stream_run_progress(spark, folder):
    """Progress of every run after its last event, restored from what the stream stored."""
    ledger.use_rocksdb(spark)
    kind = F.when(F.col("event_type") == "signup", "filter").when(F.col("event_type") == "click", "scroll").otherwise("collect")
    item = (F.col("event_id") % 40).cast("string")
    steps = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"), kind.alias("kind"),
        (F.col("event_id") % 7 + 1).cast("int").alias("page_number"), item.alias("identity"),
        F.to_json(F.struct(F.concat(F.lit("Item "), item, F.lit(".")).alias("title"))).alias("record"), F.lit(30).alias("min_items"),
        F.lit(3).alias("target_pages"), F.lit(5).alias("scroll_rounds"), F.lit("item 17.").alias("until_text"),
    )
    states = sinks.feed(steps, F.col("seq"), progress.stream_progress, "update")
    return progress.restore_progress(_newest(states, ["thread_id"]))


@query(
    "manifest_latest",
    """select cast(o_custkey as varchar) as thread_id, min(o_orderdate) as created_at, max(o_orderdate) as updated_at,
      arg_max(case o_orderstatus when 'F' then 'completed' when 'O' then 'interrupted' else 'failed' end, (o_orderdate, o_orderkey)) as status,
      arg_max(o_orderkey, (o_orderdate, o_orderkey)) as item_count from orders group by 1""",
)
def manifest_latest(spark, folder):
    return manifests(spark, folder).select("thread_id", "created_at", F.col("updated_at.at").alias("updated_at"), "status", "item_count")


def manifests(spark, folder):
    """Every order as a saved state of its customer's run."""
    from reapline.sources.manifests import manifest_rows, upsert_manifest

    o = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    states = o.select(
        F.col("o_custkey").cast("string").alias("thread_id"), F.lit("task").alias("user_task"), (status == "F").alias("is_complete"),
        F.when(status == "P", "boom").otherwise("").alias("error"), F.when(status == "O", F.array(F.lit("Planner"))).otherwise(F.array().cast("array<string>")).alias("next_nodes"),
        F.lit("").alias("session"), F.lit("").alias("current_url"), F.col("o_orderkey").alias("item_count"), F.array(F.lit(1)).alias("completed_pages"),
        F.lit("").alias("last_verified_action_key"), F.col("o_orderdate"), F.col("o_orderkey"),
    )
    dated = manifest_rows(states, F.col("o_orderdate")).withColumn("updated_at", F.struct(F.col("created_at").alias("at"), F.col("item_count").alias("n")))
    return upsert_manifest(dated.where("item_count % 2 = 0"), dated.where("item_count % 2 = 1"))


@query(
    "recent_manifests",
    """select cast(o_custkey as varchar) as thread_id, max((o_orderdate, o_orderkey))[2] as item_count from orders group by 1
    order by max((o_orderdate, o_orderkey)) desc limit 20""",
)
def recent_manifests(spark, folder):
    from reapline.sources.manifests import recent_manifests as recent

    return recent(manifests(spark, folder), 20).select("thread_id", "item_count")


@query(
    "append_snapshot",
    """with s as (select user_id as session, count(*) as n from events where event_type = 'view' group by 1),
    a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as i, left(sha256(props), 16) as content_hash from events where event_type = 'click')
    select user_id as session, 'ss_' || lpad(cast(coalesce(n, 0) + i as varchar), 4, '0') as snapshot_id, content_hash from a left join s on session = user_id""",
)
def append_snapshot(spark, folder):
    from reapline.plans.blocked import Blocked, number_block
    from reapline.sources.writers import append_snapshot as append

    e = table(spark, folder, "events").withColumnRenamed("user_id", "session")
    by_id = Blocked(["session"], ["event_id"], number_block("event_id", 5000))
    stored = by_id.row_number(e.where("event_type = 'view'"), "seq").select("session", "seq")
    new = e.where("event_type = 'click'").select("session", F.col("event_id").alias("arrival"), F.col("props").alias("data"))
    return append(stored, new, F.lit("2024-01-01").cast("timestamp")).select("session", "snapshot_id", "content_hash")


@query(
    "latest_snapshot",
    "select user_id as session, count(*) as seq, 'ss_' || lpad(cast(count(*) as varchar), 4, '0') as snapshot_id from events where event_type = 'view' group by 1",
)
def latest_snapshot(spark, folder):
    from reapline.plans.blocked import Blocked, number_block
    from reapline.sources.manifests import latest_snapshot as latest

    e = table(spark, folder, "events").where("event_type = 'view'").withColumnRenamed("user_id", "session")
    by_id = Blocked(["session"], ["event_id"], number_block("event_id", 5000))
    numbered = by_id.row_number(e, "seq")
    return latest(numbered.withColumn("snapshot_id", F.concat(F.lit("ss_"), F.lpad(F.col("seq").cast("string"), 4, "0"))))


@query(
    "csv_union",
    "select doc_id, quality, toxic from labels",
)
def csv_union(spark, folder):
    from reapline.sources.writers import csv_union as union

    fields = F.map_filter(
        F.create_map(
            F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("quality"), F.col("quality").cast("string"),
            F.lit("toxic"), F.col("toxic").cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    records = table(spark, folder, "labels").select(F.col("doc_id").alias("pos"), fields.alias("fields"))
    return union(records).select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"), F.col("toxic").cast("int"))

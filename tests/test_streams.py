"""Streams over files against their batch twins."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reapline.operators import access
from reapline.streaming import ledger, progress, sinks, traces
from tests.test_plans import EVENTS, random_events


def stream_of(spark, df, path, parts=2, order="seq"):
    """Write the rows as a few files and read them one file per micro-batch."""
    rows = df.orderBy(order).collect()
    size = max(1, -(-len(rows) // parts))
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)


def test_stream_ledger_equals_batch(spark, tmp_path):
    rows = [(d, t, i, k, iv, c) for i, (d, t, _, k, iv, c) in enumerate(sorted(random_events(1), key=lambda e: e[1]))]
    df = spark.createDataFrame(rows, EVENTS)
    streamed = sinks.drain(ledger.stream_access_ledger(stream_of(spark, df, str(tmp_path / "in"), 3), 4, 60))
    columns = ["domain", "seq", "reason", "waited_us", "window_started"]
    batch = access.access_ledger(df, 4, 60)
    assert streamed.select(*columns).orderBy("seq").collect() == batch.select(*columns).orderBy("seq").collect()


def test_stream_quarantine(spark, tmp_path):
    rows = [("code", "d", "c1", 0, 1, "hit"), ("code", "d", "c1", 10, 2, "failure"), ("code", "d", "c1", 20, 3, "hit"), ("code", "d", "c1", 70_000_000, 4, "hit")]
    df = spark.createDataFrame(rows, "cache_type string, domain_key string, cache_id string, t long, seq long, kind string")
    out = sinks.drain(ledger.stream_quarantine(stream_of(spark, df, str(tmp_path / "in"), 2), 60))
    assert {r.seq: r.allowed for r in out.collect()} == {1: True, 3: False, 4: True}


def test_quarantine_state_ends_with_its_expiry(spark, tmp_path):
    ledger.use_rocksdb(spark)
    schema = "cache_type string, domain_key string, cache_id string, t long, seq long, kind string"
    minute = 60_000_000
    parts = [
        [("dom", "d", c, i * minute, i, "failure") for i, c in enumerate("abca")], [("dom", "d", "a", 4 * minute, 9, "hit")],
        [("dom", "d", "other", 600 * minute, 10, "hit")],
    ]
    place, sizes = str(tmp_path / "q"), []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{place}/in")
        stream = spark.readStream.schema(schema).json(f"{place}/in")
        query = sinks.run_available(ledger.stream_quarantine(stream, 3600), place)
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sizes[0] > 0 and sizes[-1] == 0
    assert {r.seq: r.allowed for r in spark.read.parquet(f"{place}/out").collect()} == {9: False, 10: True}


def test_feed_arrives_in_parts_and_survives_restarts(spark):
    rows = spark.range(1000).select(
        F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("thread_id"), F.timestamp_seconds(F.col("id") * 20 + F.floor(F.col("id") / 100) * 9000).alias("started_at"),
        F.col("id").alias("total_tokens"),
    )
    beat = spark.sql("select cast(null as string) as thread_id, timestamp_seconds(1000000) as started_at, 0L as total_tokens")
    late = F.unix_seconds("started_at") + F.pmod(F.xxhash64("total_tokens"), F.lit(1500))
    out = sinks.feed(rows, late, lambda s: traces.stream_sessions(s, "1 hour", "1 hour"), last=beat, least=4)
    assert out.select("batch").distinct().count() >= 2
    got = sorted((r.thread_id, r.session_start, r.events, r.total_tokens) for r in out.collect())
    block = F.floor(F.col("total_tokens") / 100)
    want = rows.groupBy("thread_id", block).agg(F.min("started_at").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("k"))
    assert got == sorted((r.thread_id, r.s, r.n, r.k) for r in want.collect())


def test_feed_of_ties_and_nothing(spark):
    rows = spark.sql("select * from values (1, 5.0), (2, 5.0), (3, null) as t(v, at)")
    keep = lambda s: s.select("v")
    assert sorted(r.v for r in sinks.feed(rows, F.col("at"), keep).collect()) == [1, 2, 3]
    assert sinks.feed(rows.limit(0), F.col("at"), keep).count() == 0


STEPS = (
    "thread_id string, seq long, pos int, kind string, page_number int, identity string, record string, min_items int, target_pages int, scroll_rounds int, until_text string"
)


def test_stream_progress(spark, tmp_path):
    def row(seq, pos, kind, page, identity, record, until=""):
        return ("t", seq, pos, kind, page, identity, json.dumps(record) if record else None, 3, 2, 0, until)

    rows = [
        row(1, 0, "collect", 1, "a", {"title": "A"}), row(1, 1, "collect", 1, "b", {"title": "B"}), row(2, 0, "scroll", 1, "b", {"title": " ", "x": 1}),
        row(3, 0, "collect", 2, "c", {"title": "C"}),
    ]
    out = sinks.drain(progress.stream_progress(stream_of(spark, spark.createDataFrame(rows, STEPS), str(tmp_path / "in"), 2)), "update")
    last = out.orderBy(F.desc("seq")).first()
    assert (last.item_count, last.completed_pages, last.is_done) == (3, 2, True)
    assert out.where("seq = 2").count() + out.where("seq = 1").count() >= 1


def test_newer_progress_is_refused(spark):
    states = spark.createDataFrame([("t", 4), ("u", 5)], "thread_id string, state_version int")
    assert progress.restore_progress(states.where("state_version = 4")).count() == 1
    with pytest.raises(Exception, match="unsupported progress version 5"):
        progress.restore_progress(states).collect()


def test_replayed_requests_and_trace_windows(spark, tmp_path):
    df = spark.sql(
        "select * from values ('a', 1L, timestamp '2026-01-01 00:00:00'), ('a', 2L, timestamp '2026-01-01 00:00:05'), ('b', 3L, timestamp '2026-01-01 00:01:00') as t(request_id, seq, ts)"
    )
    out = sinks.drain(sinks.dedup_actions(stream_of(spark, df, str(tmp_path / "in"), 3), "ts", "1 hour"))
    assert sorted(r.seq for r in out.collect()) == [1, 3]
    events = df.select(
        F.col("ts").alias("started_at"), F.col("request_id").alias("thread_id"), F.lit("llm").alias("event_type"), F.col("seq").alias("total_tokens"), F.lit(1.0).alias("duration_ms"), "seq"
    )
    windows = sinks.drain(traces.stream_trace_windows(stream_of(spark, events, str(tmp_path / "tr"), 1), "1 minute", "1 hour"), "update")
    assert {r.window_start.minute: r.total_tokens for r in windows.collect()} == {0: 3, 1: 3}


def test_batch_sinks_can_repeat(spark, tmp_path):
    state = spark.sql(
        "select 't' as thread_id, 'task' as user_task, true as is_complete, '' as error, cast(array() as array<string>) as next_nodes, '' as session, 'u' as current_url, 3 as item_count, "
        "array(1) as completed_pages, '' as last_verified_action_key"
    )
    path = str(tmp_path / "m")
    write = sinks.manifest_sink(path, F.lit("2026-01-01").cast("timestamp"))
    write(state, 0)
    write(state, 0)
    later = sinks.manifest_sink(path, F.lit("2026-01-02").cast("timestamp"))
    later(state.withColumn("is_complete", F.lit(False)), 1)
    row = sinks.current_manifests(spark, path).first()
    assert (row.status, str(row.created_at)[:10], str(row.updated_at)[:10]) == ("running", "2026-01-01", "2026-01-02")
    docs = spark.createDataFrame([(1, {"text": "long enough text", "n": "1"}), (2, {"text": "short"})], "doc_id int, fields map<string,string>")
    ingest = sinks.ingest_sink(str(tmp_path / "kb"), F.lit("s"), F.lit("now"))
    ingest(docs, 0)
    ingest(docs, 0)
    assert spark.read.parquet(str(tmp_path / "kb")).count() == 1


class _Counted:
    """Stands in for value and map state, and counts what is asked and written."""

    def __init__(self):
        self.held, self.reads, self.writes = {}, 0, 0

    def _read(self, key):
        self.reads += 1
        return self.held.get(key)

    def _write(self, key, value):
        self.writes += 1
        self.held[key] = value

    def get(self):
        return self._read("value")

    def update(self, value):
        self._write("value", value)

    getValue, updateValue = _read, _write

    def containsKey(self, key):
        return self._read(key) is not None

    def clear(self):
        self.held = {}


class _Handle:
    def getMapState(self, *_):
        return _Counted()

    getValueState = getMapState


def test_progress_reads_and_writes_a_record_once_a_batch():
    names = Row(*[f.split(" ")[0] for f in STEPS.split(", ")])
    steps = [names("t", i, 0, "collect", i % 4, str(i % 3), json.dumps({"title": i % 3}), 3, 2, 0, "") for i in range(300)]
    p = progress.ProgressProcessor()
    p.init(_Handle())
    (first,) = p.handleInputRows(("t",), iter(steps), None)
    assert (first.seq, first.item_count, first.completed_pages, p.records.reads, p.records.writes) == (299, 3, 3, 3, 3)
    (again,) = p.handleInputRows(("t",), iter(steps), None)
    assert (again.item_count, p.records.reads, p.records.writes, p.totals.writes) == (3, 6, 3, 1)


def test_unchanged_ledger_is_not_written():
    names = Row("domain", "t", "seq", "kind", "interval_us", "cooldown_us")
    p = ledger.LedgerProcessor(1, 10**9)
    p.init(_Handle())
    assert [r.reason for r in p.handleInputRows(("d",), iter([names("d", 5, 2, "request", 0, None), names("d", 1, 1, "request", 0, None)]), None)] == ["allowed", "domain_request_budget_exhausted"]
    assert [r.seq for r in p.handleInputRows(("d",), iter([names("d", 7, 3, "request", 0, None)]), None)] == [3]
    assert (p.state.reads, p.state.writes) == (2, 1)


def test_first_copy_of_a_batch_is_the_earliest(spark, tmp_path):
    df = spark.sql("select concat('k', id % 5) as request_id, id as seq, timestamp_seconds(100000 - id) as ts from range(1000)")
    first = {r.request_id: r.seq for r in sinks.drain(sinks.dedup_actions(stream_of(spark, df, str(tmp_path / "in"), 1), "ts", "1 hour")).collect()}
    assert first == {f"k{i}": 995 + i for i in range(5)}

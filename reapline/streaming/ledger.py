"""Per-site access decisions and quarantine as keyed streaming state.

A key keeps a handful of numbers; the rows of a key inside one micro-batch are bounded by
the trigger's file or byte limit.  The batch twin for whole tables, which spreads a site
over many tasks, is ``operators.access.access_ledger``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000

LEDGER_OUT = (
    "domain string, t bigint, seq bigint, reason string, allowed boolean, window_started bigint, scheduled bigint, waited_us bigint"
)

QUARANTINE_OUT = "cache_type string, domain_key string, cache_id string, t bigint, seq bigint, allowed boolean"


def use_rocksdb(spark) -> None:
    """Keyed state with many keys needs a store that spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def columns_of(schema: str) -> list[str]:
    return [field.split(" ")[0] for field in schema.split(", ")]


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.t, r.seq is None, r.seq))


class LedgerProcessor(StatefulProcessor):
    """Cooldown, anchored budget window and pacing of one site."""

    def __init__(self, max_requests: int, window_us: int):
        self.max_requests, self.window_us = max_requests, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "started bigint, used bigint, last_start bigint, cooldown bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get()
        started, used, last, cooldown = before or (None, 0, None, None)
        out = Row(*columns_of(LEDGER_OUT))
        for row in _in_order(rows):
            t = row.t
            if row.kind == "response":
                if row.cooldown_us is not None:
                    started = t if started is None else started
                    until = t + row.cooldown_us
                    cooldown = until if cooldown is None else max(cooldown, until)
                continue
            if cooldown is not None and t < cooldown:
                yield out(key[0], t, row.seq, "domain_cooldown", False, None, None, 0)
                continue
            if started is None or t - started >= self.window_us:
                started, used = t, 0
            if 0 < self.max_requests <= used:
                yield out(key[0], t, row.seq, "domain_request_budget_exhausted", False, started, None, 0)
                continue
            start = t if last is None else max(t, last + row.interval_us)
            yield out(key[0], t, row.seq, "allowed", True, started, start, start - t)
            used, last = used + 1, start
        after = (started, used, last, cooldown)
        if started is not None and after != before:
            self.state.update(after)

    def close(self) -> None:
        pass


def stream_access_ledger(events: DataFrame, max_requests: int = 240, window_seconds: int = 3600) -> DataFrame:
    """Decisions for a stream of requests and refusals, in arrival order of micro-batches.

    ``events``: domain, t, seq, kind, interval_us, cooldown_us (see the batch twin); 429
    responses travel in the same stream, so one state serves requests and cooldowns.
    """
    slim = events.select(F.col("domain").cast("string").alias("domain"), "t", "seq", "kind", "interval_us", "cooldown_us")
    return slim.groupBy("domain").transformWithState(
        statefulProcessor=LedgerProcessor(max_requests, max(1, window_seconds) * SECOND), outputStructType=LEDGER_OUT,
        outputMode="Append", timeMode="None",
    )


class QuarantineProcessor(StatefulProcessor):
    """Expiry of one cached entry; a timer at that event time ends the state."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = until = (self.expiry.get() or (None,))[0]
        out = Row(*columns_of(QUARANTINE_OUT))
        for row in _in_order(rows):
            if row.kind == "failure":
                until = max(until or 0, row.t + self.ttl_us)
                continue
            yield out(*key, row.t, row.seq, until is None or row.t >= until)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            self.expiry.update((until,))
            self.handle.registerTimer(_millis(until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.expiry.clear()
        return iter(())

    def close(self) -> None:
        pass


# A watermark starts at the epoch, where Spark takes rows for late; times run a day ahead of it.
AHEAD = 86_400 * SECOND


def _millis(us: int) -> int:
    """First whole millisecond not before a time in microseconds, as the watermark counts."""
    return -(-(us + AHEAD) // 1000)


def stream_quarantine(events: DataFrame, ttl_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """Hits marked allowed or not, given the failures seen before them.

    ``events``: cache_type, domain_key, cache_id (text), t (microseconds since
    1970), seq, kind (failure or hit).  Rows may come late by ``watermark``; what is known of an entry goes
    when the watermark passes its last expiry, also if nothing more is heard of it.
    """
    timed = events.select("cache_type", "domain_key", "cache_id", "t", "seq", "kind", F.timestamp_micros(F.col("t") + AHEAD).alias("at"))
    return timed.withWatermark("at", watermark).groupBy("cache_type", "domain_key", "cache_id").transformWithState(
        statefulProcessor=QuarantineProcessor(max(60, ttl_seconds) * SECOND), outputStructType=QUARANTINE_OUT, outputMode="Append",
        timeMode="EventTime",
    )

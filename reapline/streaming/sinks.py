"""Micro-batch sinks: every batch writes its own folder, so a repeated batch changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reapline.operators.documents import build_docs, doc_metadata, percent_consistency
from reapline.session import CHECKPOINT_KEY
from reapline.sources.manifests import manifest_rows, upsert_manifest


def folder_sink(path: str, prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that writes ``path/batch=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch, batch_id) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def manifest_sink(path: str, now: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Manifest rows of a stream of run states, appended to the history."""
    return folder_sink(path, lambda batch, _: manifest_rows(batch, now if now is not None else F.current_timestamp()))


def current_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per thread over the whole history."""
    history = spark.read.parquet(path).drop("batch")
    return upsert_manifest(history, history.limit(0))


def ingest_sink(path: str, source: Column, crawled_at: Column) -> Callable[[DataFrame, int], None]:
    """Document ingestion; number formats are settled inside each micro-batch."""

    def prepare(batch: DataFrame, batch_id: int) -> DataFrame:
        docs = doc_metadata(build_docs(batch.withColumn("batch_id", F.lit(batch_id))), source, crawled_at)
        return percent_consistency(docs, "batch_id", "doc_id").drop("fields", "batch_id")

    return folder_sink(path, prepare)


class FirstCopyProcessor(StatefulProcessor):
    """Earliest row of one id; a timer ends the state when the watermark may let no copy of it pass."""

    def __init__(self, event_time: str, keep_ms: int):
        self.event_time, self.keep_ms = event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        time = self.event_time
        first = min(rows, key=lambda r: (r[time] is None, r[time]))
        if self.until.get() is None:
            if first[time] is not None:
                until = int(first[time].timestamp() * 1000) + 1 + self.keep_ms
                self.until.update((until,))
                self.handle.registerTimer(until)
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_actions(actions: DataFrame, event_time: str, watermark: str) -> DataFrame:
    """First copy of every request id inside the watermark: replays have no effect.

    Of the copies that arrive in one micro-batch the earliest counts, however they lie in it.
    """
    keep = actions.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval '{watermark}')")).first()[0]
    timed = actions.withWatermark(event_time, watermark)
    return timed.groupBy("request_id").transformWithState(
        statefulProcessor=FirstCopyProcessor(event_time, keep), outputStructType=actions.schema, outputMode="Append", timeMode="EventTime"
    )


def stream_folder(spark: SparkSession) -> str:
    """A new place for one stream in the shared checkpoint folder of the session."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/streams/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, place: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything available, from the progress stored under ``place``."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(folder_sink(f"{place}/out"))
        .option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote, batch by batch.

    Output and progress live in the shared checkpoint folder of the session.
    """
    spark = stream.sparkSession
    place = stream_folder(spark)
    run_available(stream, place, mode)
    return spark.read.parquet(f"{place}/out")


def feed(
    rows: DataFrame, arrival: Column, build: Callable[[DataFrame], DataFrame], mode: str = "append", last: DataFrame | None = None,
    least: int = 3, rows_per_part: int = 2_000_000,
) -> DataFrame:
    """What a stream writes while ``rows`` arrive in parts, in the order of the number ``arrival``.

    Every part is a micro-batch of a query started anew from the stored progress of the one
    before, so state passes through the checkpoint each time.  There are at least ``least``
    parts, and more as the input grows, so that a micro-batch has about ``rows_per_part``
    rows (ties of ``arrival`` stay together; rows without it come first).  ``last`` holds
    rows that arrive after all others, such as one that moves a watermark on.
    """
    spark = rows.sparkSession
    place = stream_folder(spark)
    dealt = rows.withColumn("_arrival", arrival.cast("double"))
    parts = max(least, -(-dealt.count() // rows_per_part))
    cuts = dealt.agg(F.percentile_approx("_arrival", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    number = sum((F.coalesce(F.col("_arrival") > F.lit(c), F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    dealt.withColumn("_part", number).drop("_arrival").write.partitionBy("_part").parquet(f"{place}/parts")
    staged = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{place}/parts")
    for i in range(len(set(cuts)) + 1):
        staged.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{place}/in")
        run_available(build(spark.readStream.schema(rows.schema).parquet(f"{place}/in")), place, mode)
    if last is not None:
        last.write.mode("append").parquet(f"{place}/in")
        run_available(build(spark.readStream.schema(rows.schema).parquet(f"{place}/in")), place, mode)
    return spark.read.parquet(f"{place}/out")

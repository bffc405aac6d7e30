"""Trace usage kept up to date while runs go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.operators.traces import summary_columns, trace_tumbling


def stream_trace_summary(trace: DataFrame) -> DataFrame:
    """Usage per thread; each micro-batch emits the threads it changed."""
    return trace.groupBy("thread_id").agg(*summary_columns())


def stream_trace_windows(trace: DataFrame, width: str, watermark: str) -> DataFrame:
    """Usage per time window; late events beyond the watermark are dropped by Spark."""
    return trace_tumbling(trace, width, watermark)


def stream_sessions(trace: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Runs without explicit end, closed by inactivity."""
    return (
        trace.withWatermark("started_at", watermark).groupBy(F.session_window("started_at", gap), "thread_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("total_tokens").alias("total_tokens"))
        .select("thread_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events", "total_tokens")
    )

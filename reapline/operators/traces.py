"""Run traces: token usage, cost and latency per thread, case and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.text import token_estimate
from reapline.plans.blocked import Blocked, micros, time_block
from reapline.plans.ranking import last_per_key

MONEY = "decimal(20,8)"
EXACT = "decimal(18,6)"


def _positive(usage: str, *names: str) -> Column:
    """First filled count among ``names`` of a usage map; 0 counts as missing."""
    return F.coalesce(*[F.nullif(F.col(usage)[n], F.lit(0).cast("long")) for n in names])


def trace_events(raw: DataFrame) -> DataFrame:
    """Add input/output/total tokens and the estimated flag.

    ``usage`` and ``token_usage`` are maps as model providers report them; where both
    are silent the token counts are estimated from ``input_text`` and ``output_text``.
    """
    given_in = F.coalesce(
        _positive("usage", "input_tokens", "prompt_tokens"), _positive("token_usage", "input_tokens", "prompt_tokens"), F.lit(0)
    )
    given_out = F.coalesce(_positive("usage", "output_tokens", "completion_tokens"), F.lit(0))
    given_total = F.coalesce(_positive("usage", "total_tokens"), _positive("token_usage", "total_tokens"), F.lit(0))
    df = raw.withColumns({"_in": given_in, "_out": F.coalesce(F.nullif(given_out, F.lit(0)),
        _positive("token_usage", "output_tokens", "completion_tokens"), F.lit(0)), "_total": given_total})
    silent = (F.col("_in") == 0) & (F.col("_out") == 0) & (F.col("_total") == 0)
    guess_in, guess_out = token_estimate("input_text"), token_estimate("output_text")
    return df.withColumns(
        {
            "input_tokens": F.when(silent, guess_in).otherwise(F.col("_in")),
            "output_tokens": F.when(silent, guess_out).otherwise(F.col("_out")),
            "total_tokens": F.when(silent, guess_in + guess_out)
            .when(F.col("_total") > 0, F.col("_total"))
            .otherwise(F.col("_in") + F.col("_out")),
            "estimated_tokens": silent,
        }
    ).drop("_in", "_out", "_total")


def price_usage(
    trace: DataFrame, pricing: DataFrame, keys: tuple[str, ...] = ("model",), cost: str = "cost_usd"
) -> DataFrame:
    """Add the cost of every event; a model without price costs nothing.

    ``pricing`` (model, input_per_million, output_per_million) is joined by equality;
    its size decides the join strategy at run time.
    """
    tokens = "decimal(14,0)"
    amount = (
        F.col("input_tokens").cast(tokens) * F.coalesce(F.col("input_per_million"), F.lit(0)).cast("decimal(10,4)")
        + F.col("output_tokens").cast(tokens) * F.coalesce(F.col("output_per_million"), F.lit(0)).cast("decimal(10,4)")
    ) * F.lit("0.000001").cast("decimal(7,6)")
    return (
        trace.join(pricing, list(keys), "left")
        .withColumn(cost, F.round(amount, 8).cast(MONEY))
        .drop("input_per_million", "output_per_million")
    )


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def _milliseconds(kind: str | None = None) -> Column:
    value = F.col("duration_ms").cast(EXACT)
    value = F.when(F.col("event_type") == kind, value) if kind else value
    return F.round(F.coalesce(F.sum(value), F.lit(0)).cast("double"), 3)


def summary_columns() -> list[Column]:
    is_llm = F.col("event_type") == "llm"
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(is_llm).alias("llm_call_count"),
        F.count_if(F.col("event_type") == "browser_action").alias("browser_action_count"),
        _total("input_tokens").alias("input_tokens"),
        _total("output_tokens").alias("output_tokens"),
        _total("total_tokens").alias("total_tokens"),
        F.count_if(F.col("estimated_tokens")).alias("estimated_call_count"),
        F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), F.lit(0)).cast("double").alias("cost_usd"),
        _milliseconds().alias("total_duration_ms"),
        _milliseconds("llm").alias("llm_duration_ms"),
        _milliseconds("browser_action").alias("browser_duration_ms"),
    ]


def trace_summary(trace: DataFrame) -> DataFrame:
    """Usage per thread: one partial and one final aggregation."""
    return trace.groupBy("thread_id").agg(*summary_columns())


def trace_totals(summary: DataFrame) -> DataFrame:
    """Usage over all threads, and how exact its token counts are."""
    counts = (
        "event_count llm_call_count browser_action_count input_tokens output_tokens total_tokens estimated_call_count"
    ).split()
    exact = {"cost_usd": (MONEY, 8), "total_duration_ms": (EXACT, 3), "llm_duration_ms": (EXACT, 3), "browser_duration_ms": (EXACT, 3)}
    totals = summary.agg(
        *[_total(c).alias(c) for c in counts],
        *[F.round(F.coalesce(F.sum(F.col(c).cast(t)), F.lit(0)).cast("double"), n).alias(c) for c, (t, n) in exact.items()],
    )
    calls, guessed = F.col("llm_call_count"), F.col("estimated_call_count")
    return totals.withColumn(
        "token_precision",
        F.when(calls == 0, "no_llm_calls")
        .when(guessed == 0, "provider_reported")
        .when(guessed == calls, "estimated")
        .otherwise("mixed"),
    )


def thread_events(trace: DataFrame, thread_id: str) -> DataFrame:
    """Events of one thread in the order they were written."""
    return trace.where(F.col("thread_id") == thread_id).orderBy("id")


def usage_by_case(runs: DataFrame, trace: DataFrame) -> DataFrame:
    """Usage of the latest run of each case that has trace events.

    ``runs``: case_key, pos and thread_ids.  The trace shrinks to one row per thread
    before the join.
    """
    is_llm = F.col("event_type") == "llm"
    threads = trace.groupBy("thread_id").agg(
        F.max("id").alias("last_id"),
        F.count_if(is_llm).alias("llm_calls"),
        _total("total_tokens").alias("tokens"),
        F.count_if(is_llm & F.col("estimated_tokens")).alias("estimated_calls"),
        F.count_if(F.col("event_type") == "browser_action").alias("browser_actions"),
    )
    per_run = (
        runs.select("case_key", "pos", F.explode("thread_ids").alias("thread_id"))
        .join(threads, "thread_id")
        .groupBy("case_key", "pos")
        .agg(
            F.max("last_id").alias("last_id"),
            *[F.sum(c).alias(c) for c in ("llm_calls", "tokens", "estimated_calls", "browser_actions")],
        )
    )
    return last_per_key(per_run.where(F.col("case_key") != ""), ["case_key"], ["pos"]).drop("pos")


def trace_tumbling(trace: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Usage per fixed time window and event type; works on tables and streams."""
    source = trace.withWatermark("started_at", watermark) if watermark else trace
    return (
        source.groupBy(F.window("started_at", width), "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            _total("total_tokens").alias("total_tokens"),
            F.round(F.sum(F.col("duration_ms").cast(EXACT)).cast("double"), 3).alias("duration_ms"),
        )
        .select(F.col("window.start").alias("window_start"), "event_type", "events", "total_tokens", "duration_ms")
    )


def session_runs(trace: DataFrame, gap_seconds: int, block_seconds: int = 6 * 3600) -> DataFrame:
    """Events of a thread grouped by inactivity, for threads without an explicit end.

    A busy thread is scanned in time blocks, not as one group.
    """
    by_time = Blocked(["thread_id"], ["started_at", "id"], time_block("started_at", block_seconds))
    df = by_time.lag(trace, {"_before": "started_at"})
    gap = micros("started_at") - micros("_before")
    opens = F.col("_before").isNull() | (gap > gap_seconds * 1_000_000)
    df = by_time.running(df, {"session_no": ("sum", opens.cast("long"))})
    return df.groupBy("thread_id", "session_no").agg(
        F.min("started_at").alias("session_start"),
        F.max("started_at").alias("session_end"),
        F.count(F.lit(1)).alias("events"),
        _total("total_tokens").alias("total_tokens"),
    )

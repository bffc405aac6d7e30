"""Trace queries."""

from pyspark.sql import functions as F

from reapline.catalog import inputs
from reapline.catalog.inputs import PRICES_SQL, TRACE_SQL
from reapline.catalog.registry import query, table
from reapline.operators import traces

PRICED = f"""
with {TRACE_SQL}, {PRICES_SQL},
priced as (
  select t.*, round((input_tokens * cast(coalesce(pin, 0) as decimal(10,4)) + output_tokens * cast(coalesce(pout, 0) as decimal(10,4))) * cast(0.000001 as decimal(7,6)), 8) as cost_usd
  from trace t left join prices p on p.model = t.model
),
summary as (
  select thread_id, count(*) as event_count,
    count(*) filter (event_type = 'llm') as llm_call_count,
    count(*) filter (event_type = 'browser_action') as browser_action_count,
    cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
    cast(sum(total_tokens) as bigint) as total_tokens,
    count(*) filter (estimated_tokens) as estimated_call_count,
    cast(sum(cast(cost_usd as decimal(20,8))) as double) as cost_usd,
    round(cast(sum(cast(duration_ms as decimal(18,6))) as double), 3) as total_duration_ms,
    round(cast(coalesce(sum(cast(duration_ms as decimal(18,6))) filter (event_type = 'llm'), 0) as double), 3) as llm_duration_ms,
    round(cast(coalesce(sum(cast(duration_ms as decimal(18,6))) filter (event_type = 'browser_action'), 0) as double), 3) as browser_duration_ms
  from priced group by thread_id
)"""


def priced(spark, folder):
    return traces.price_usage(inputs.trace(spark, folder), inputs.prices(spark))


@query("trace_summary", PRICED + " select * from summary")
def trace_summary(spark, folder):
    return traces.trace_summary(priced(spark, folder))


@query(
    "trace_totals",
    PRICED
    + """ select t.*, case when llm_call_count = 0 then 'no_llm_calls' when estimated_call_count = 0 then 'provider_reported'
      when estimated_call_count = llm_call_count then 'estimated' else 'mixed' end as token_precision
    from (select cast(sum(event_count) as bigint) as event_count, cast(sum(llm_call_count) as bigint) as llm_call_count,
      cast(sum(browser_action_count) as bigint) as browser_action_count, cast(sum(input_tokens) as bigint) as input_tokens,
      cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(total_tokens) as bigint) as total_tokens,
      cast(sum(estimated_call_count) as bigint) as estimated_call_count,
      round(cast(sum(cast(cost_usd as decimal(20,8))) as double), 8) as cost_usd,
      round(cast(sum(cast(total_duration_ms as decimal(18,6))) as double), 3) as total_duration_ms,
      round(cast(sum(cast(llm_duration_ms as decimal(18,6))) as double), 3) as llm_duration_ms,
      round(cast(sum(cast(browser_duration_ms as decimal(18,6))) as double), 3) as browser_duration_ms
    from summary) t""",
)
def trace_totals(spark, folder):
    return traces.trace_totals(traces.trace_summary(priced(spark, folder)))


@query(
    "trace_cost",
    PRICED
    + """ select model, count(*) as calls, cast(sum(total_tokens) as bigint) as total_tokens,
      cast(sum(cast(cost_usd as decimal(20,8))) as double) as cost_usd
    from priced where event_type = 'llm' group by model""",
)
def trace_cost(spark, folder):
    return (
        priced(spark, folder).where("event_type = 'llm'").groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum(F.col("cost_usd").cast("decimal(20,8)")).cast("double").alias("cost_usd"),
        )
    )


@query(
    "trace_tumbling",
    f"""with {TRACE_SQL} select time_bucket(interval '1 hour', started_at) as window_start, event_type, count(*) as events,
      cast(sum(total_tokens) as bigint) as total_tokens,
      round(cast(sum(cast(duration_ms as decimal(18,6))) as double), 3) as duration_ms
    from trace group by 1, 2""",
)
def trace_tumbling(spark, folder):
    return traces.trace_tumbling(inputs.trace(spark, folder), "1 hour")


@query(
    "run_sessions",
    f"""with {TRACE_SQL},
    marked as (select *, lag(started_at) over (partition by thread_id order by started_at, id) as before from trace),
    numbered as (select *, sum(case when before is null or epoch_us(started_at) - epoch_us(before) > 7200000000 then 1 else 0 end)
      over (partition by thread_id order by started_at, id) as session_no from marked)
    select thread_id, cast(session_no as bigint) as session_no, min(started_at) as session_start, max(started_at) as session_end,
      count(*) as events, cast(sum(total_tokens) as bigint) as total_tokens
    from numbered group by thread_id, session_no""",
)
def run_sessions(spark, folder):
    return traces.session_runs(inputs.trace(spark, folder), 7200)


@query(
    "thread_events",
    f"with {TRACE_SQL} select id, event_type, model, total_tokens, started_at from trace where thread_id = '7'",
)
def thread_events(spark, folder):
    return traces.thread_events(inputs.trace(spark, folder), "7").select("id", "event_type", "model", "total_tokens", "started_at")


@query(
    "usage_by_case",
    f"""with {TRACE_SQL},
    threads as (select thread_id, max(id) as last_id, count(*) filter (event_type = 'llm') as llm_calls, sum(total_tokens) as tokens,
      count(*) filter (event_type = 'llm' and estimated_tokens) as estimated_calls, count(*) filter (event_type = 'browser_action') as browser_actions
      from trace group by thread_id),
    runs as (select 'case-' || cast(c_custkey % 40 as varchar) as case_key, c_custkey as pos,
      unnest([cast(c_custkey % 170 as varchar), cast(c_custkey % 170 + 1 as varchar)]) as thread_id from customer),
    per_run as (select case_key, pos, max(last_id) as last_id, sum(llm_calls) as llm_calls, sum(tokens) as tokens,
      sum(estimated_calls) as estimated_calls, sum(browser_actions) as browser_actions from runs join threads using (thread_id) group by case_key, pos)
    select case_key, last_id, cast(llm_calls as bigint) as llm_calls, cast(tokens as bigint) as tokens,
      cast(estimated_calls as bigint) as estimated_calls, cast(browser_actions as bigint) as browser_actions
    from per_run qualify row_number() over (partition by case_key order by pos desc) = 1""",
)
def usage_by_case(spark, folder):
    key = F.col("c_custkey")
    runs = table(spark, folder, "customer").select(
        F.concat(F.lit("case-"), (key % 40).cast("string")).alias("case_key"),
        key.alias("pos"),
        F.array((key % 170).cast("string"), (key % 170 + 1).cast("string")).alias("thread_ids"),
    )
    return traces.usage_by_case(runs, inputs.trace(spark, folder))


@query(
    "usage_normalised",
    """with raw as (select conv_id, turn, text, conv_id % 3 as way, length(text) as n from conversations where role = 'assistant')
    select conv_id, turn, case way when 0 then n // 2 else n end as output_tokens,
      case way when 0 then 0 else n // 3 end as input_tokens,
      case way when 0 then n // 2 when 1 then n + n // 3 else n + n // 3 + 1 end as total_tokens,
      way = 0 as estimated_tokens from raw""",
)
def usage_normalised(spark, folder):
    n, way = F.length("text").cast("long"), F.col("conv_id") % 3
    raw = table(spark, folder, "conversations").where("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.when(way == 1, F.create_map(F.lit("prompt_tokens"), F.floor(n / 3), F.lit("completion_tokens"), n)).alias("usage"),
        F.when(
            way == 2,
            F.create_map(
                F.lit("input_tokens"), F.floor(n / 3), F.lit("output_tokens"), n, F.lit("total_tokens"), n + F.floor(n / 3) + 1
            ),
        ).alias("token_usage"),
        F.lit("").alias("input_text"),
        F.col("text").alias("output_text"),
    )
    return traces.trace_events(raw).select(
        "conv_id", "turn", "input_tokens", "output_tokens", "total_tokens", "estimated_tokens"
    )

"""The supplied tables seen as crawl data, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reapline.catalog.registry import table

# Events as trace: a user is a thread, k are the input tokens.
TRACE_SQL = """
trace as (
  select event_id as id, cast(user_id as varchar) as thread_id, ts as started_at,
    case event_type when 'signup' then 'llm' when 'view' then 'llm' when 'error' then 'llm_error' else 'browser_action' end as event_type,
    'model-' || cast(k % 5 as varchar) as model, value as duration_ms,
    k as input_tokens, k // 4 as output_tokens, k + k // 4 as total_tokens, k % 3 = 0 as estimated_tokens
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)
)"""

PRICES = (("model-0", 1.0, 2.0), ("model-1", 6.5, 27.0), ("model-2", 4.0, 21.0))
PRICES_SQL = "prices(model, pin, pout) as (values ('model-0', 1.0, 2.0), ('model-1', 6.5, 27.0), ('model-2', 4.0, 21.0))"


def trace(spark: SparkSession, folder: str) -> DataFrame:
    return trace_of(table(spark, folder, "events"))


def trace_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (
        F.when(F.col("event_type").isin("signup", "view"), "llm")
        .when(F.col("event_type") == "error", "llm_error")
        .otherwise("browser_action")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("thread_id"),
        F.col("ts").alias("started_at"),
        kind.alias("event_type"),
        F.concat(F.lit("model-"), (k % 5).cast("string")).alias("model"),
        F.col("value").alias("duration_ms"),
        k.alias("input_tokens"),
        F.floor(k / 4).alias("output_tokens"),
        (k + F.floor(k / 4)).alias("total_tokens"),
        (k % 3 == 0).alias("estimated_tokens"),
    )


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, input_per_million double, output_per_million double")


# Orders as benchmark runs, their lines as the results of a run.
RUNS_SQL = """
results as (
  select l_orderkey as run_id, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey as pos,
    l_returnflag <> 'R' as ok,
    case l_linenumber when 1 then 'open' when 2 then 'click' when 3 then 'scroll' when 4 then 'list-items' when 5 then 'batch-detail-extract' else 'extract' end as action,
    case when l_returnflag = 'R' then case when l_linestatus = 'O' then 'ref_not_found' else 'timeout' end end as error_code,
    case when l_returnflag = 'R' then 'supplier ' || cast(l_suppkey % 3 as varchar) end as error_message,
    l_partkey, l_quantity, l_discount, l_extendedprice
  from lineitem
),
per_run as (
  select run_id, bool_or(ok) as opened, count(distinct l_partkey) as items, count(*) as n_results,
    sum(case when l_discount > 0.02 then 1 else 0 end) as filled,
    cast(sum(l_quantity) as bigint) as input_tokens, bool_or(action = 'batch-detail-extract') as detail_batch_ran,
    count(*) filter (action in ('open', 'click', 'scroll')) as browser_actions
  from results group by run_id
),
base as (
  select o_orderkey as run_id, o_custkey % 25 as case_no, 'case-' || cast(o_custkey % 25 as varchar) as case_key, o_orderpriority as model,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'stopped' else 'exception' end as status,
    case when o_orderstatus = 'P' and o_custkey % 2 = 0 then 'browser closed' end as exception,
    o_totalprice / 1000 as elapsed_seconds, o_custkey % 4 <> 3 as session_closed,
    coalesce(opened, false) as c1, coalesce(items, 0) >= 2 as c2,
    coalesce(filled >= 0.8 * n_results, false) as c3, o_orderstatus = 'F' as c4,
    coalesce(items, 0) as unique_item_count, coalesce(input_tokens, 0) as input_tokens,
    coalesce(input_tokens, 0) // 4 as output_tokens, coalesce(n_results, 0) as llm_call_count,
    coalesce(browser_actions, 0) as browser_action_count, coalesce(detail_batch_ran, false) as detail_batch_ran
  from orders left join per_run on run_id = o_orderkey
),
runs as (
  select *, (cast(c1 as int) + cast(c2 as int) + cast(c3 as int) + cast(c4 as int)) as passed_checks,
    25.0 * (cast(c1 as int) + cast(c2 as int) + cast(c3 as int) + cast(c4 as int)) as accuracy_score,
    c1 and c2 and c3 and c4 as task_pass,
    status = 'completed' and exception is null and c1 and c2 and c3 and c4 and session_closed as strict
  from base
)"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    line, failed = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    action = (
        F.when(line == 1, "open").when(line == 2, "click").when(line == 3, "scroll").when(line == 4, "list-items")
        .when(line == 5, "batch-detail-extract").otherwise("extract")
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        (line.cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("pos"),
        (~failed).alias("ok"),
        action.alias("action"),
        F.when(failed, F.when(F.col("l_linestatus") == "O", "ref_not_found").otherwise("timeout")).alias("error_code"),
        F.when(failed, F.concat(F.lit("supplier "), (F.col("l_suppkey") % 3).cast("string"))).alias("error_message"),
        "l_partkey", "l_quantity", "l_discount", "l_extendedprice",
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    per_run = results(spark, folder).groupBy("run_id").agg(
        F.bool_or("ok").alias("opened"),
        F.count_distinct("l_partkey").alias("items"),
        F.count(F.lit(1)).alias("n_results"),
        F.sum((F.col("l_discount") > 0.02).cast("int")).alias("filled"),
        F.sum("l_quantity").cast("long").alias("tokens"),
        F.bool_or(F.col("action") == "batch-detail-extract").alias("detail"),
        F.count_if(F.col("action").isin("open", "click", "scroll")).alias("browser"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "stopped").otherwise("exception")
    zero = F.lit(0).cast("long")
    df = table(spark, folder, "orders").join(per_run, F.col("o_orderkey") == F.col("run_id"), "left")
    items, tokens = F.coalesce("items", zero), F.coalesce("tokens", zero)
    checks = F.create_map(
        F.lit("target_opened"), F.coalesce("opened", F.lit(False)),
        F.lit("minimum_unique_items"), items >= 2,
        F.lit("required_field_coverage_80pct"), F.coalesce(F.col("filled") >= 0.8 * F.col("n_results"), F.lit(False)),
        F.lit("autonomous_completion"), F.col("o_orderstatus") == "F",
    )
    df = df.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("case-"), (F.col("o_custkey") % 25).cast("string")).alias("case_key"),
        F.col("o_orderpriority").alias("model"),
        status.alias("status"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), "browser closed").alias("exception"),
        (F.col("o_totalprice") / 1000).alias("elapsed_seconds"),
        (F.col("o_custkey") % 4 != 3).alias("session_closed"),
        checks.alias("checks"),
        items.alias("unique_item_count"),
        F.lit(2).alias("expected_min_items"),
        F.lit(5).alias("expected_max_items"),
        tokens.alias("input_tokens"),
        F.floor(tokens / 4).alias("output_tokens"),
        (tokens + F.floor(tokens / 4)).alias("total_tokens"),
        F.coalesce("n_results", zero).alias("llm_call_count"),
        F.coalesce("browser", zero).alias("browser_action_count"),
        F.coalesce("detail", F.lit(False)).alias("detail_batch_ran"),
        F.col("o_orderkey").alias("pos"),
        F.lit("orders").alias("source_file"),
    )
    passed = F.size(F.filter(F.map_values("checks"), lambda x: x))
    return df.withColumn("accuracy_score", passed * 25.0)

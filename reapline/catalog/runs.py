"""Run queries: orders as runs, order lines as results."""

from pyspark.sql import functions as F

from reapline.catalog import inputs
from reapline.catalog.inputs import RUNS_SQL
from reapline.catalog.registry import query, table
from reapline.operators import runs as ops

WITH = f"with {RUNS_SQL}"


def costed(spark, folder):
    return inputs.runs(spark, folder).withColumns(
        {
            "cost_usd": (F.col("total_tokens").cast("decimal(12,0)") * F.lit("0.000002").cast("decimal(7,6)")).cast("decimal(20,8)"),
            "llm_duration_ms": F.col("llm_call_count") * 1250,
            "estimated_call_count": F.col("llm_call_count") % 3,
        }
    )


MATRIX_SQL = """
matrix as (
  select model, count(*) as run_count, count(*) filter (task_pass) as passed,
    round(count(*) filter (task_pass) * 100.0::double / count(*), 1) as success_rate,
    round(cast(sum(cast(accuracy_score as decimal(24,6))) as double) / count(*), 1) as average_accuracy,
    round(cast(sum(cast(elapsed_seconds as decimal(24,6))) as double) / count(*), 3) as average_elapsed_seconds,
    cast(sum(input_tokens + output_tokens) as bigint) as total_tokens,
    round(cast(sum(input_tokens + output_tokens) as double) / count(*), 1) as average_tokens,
    cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
    cast(sum(llm_call_count) as bigint) as llm_call_count, cast(sum(browser_action_count) as bigint) as browser_action_count,
    round(cast(sum(browser_action_count) as double) / count(*), 1) as average_browser_actions,
    cast(sum(cast((input_tokens + output_tokens) * cast(0.000002 as decimal(7,6)) as decimal(20,8))) as double) as total_cost_usd,
    round(cast(sum(cast((input_tokens + output_tokens) * cast(0.000002 as decimal(7,6)) as decimal(20,8))) as double) / count(*), 8) as average_cost_usd,
    round(cast(sum(llm_call_count * 1250) as double) / 1000, 3) as llm_duration_seconds,
    cast(sum(llm_call_count % 3) as bigint) as estimated_call_count
  from runs group by model
)"""


@query("model_matrix", f"{WITH}, {MATRIX_SQL} select * from matrix")
def model_matrix(spark, folder):
    return ops.model_matrix(costed(spark, folder))


@query(
    "model_ranking",
    f"""{WITH}, {MATRIX_SQL} select model, success_rate, average_accuracy, average_elapsed_seconds, average_tokens,
    row_number() over (order by success_rate desc, average_accuracy desc, average_elapsed_seconds, average_tokens, model) as rank from matrix""",
)
def model_ranking(spark, folder):
    return ops.model_ranking(ops.model_matrix(costed(spark, folder))).select(
        "model", "success_rate", "average_accuracy", "average_elapsed_seconds", "average_tokens", "rank"
    )


@query(
    "site_matrix",
    f"""{WITH} select case_key, count(*) as run_count,
    round(cast(sum(cast(accuracy_score as decimal(24,6))) as double) / count(*), 1) as mean_score,
    cast(min(accuracy_score) as double) as min_score, cast(max(accuracy_score) as double) as max_score,
    count(*) filter (c1) as opened, count(*) filter (c2) as count_pass, count(*) filter (c3) as field_pass,
    count(*) filter (c4) as autonomous, count(*) filter (task_pass) as passed,
    round(cast(sum(cast(elapsed_seconds as decimal(24,6))) as double) / count(*), 1) as mean_seconds
    from runs group by case_key""",
)
def site_matrix(spark, folder):
    return ops.site_matrix(inputs.runs(spark, folder))


@query("site_item_counts", f"{WITH} select case_key, unique_item_count, count(*) as runs from runs group by all")
def site_item_counts(spark, folder):
    return ops.site_item_counts(inputs.runs(spark, folder))


@query(
    "run_overview",
    f"""{WITH} select count(*) as run_count, count(*) filter (task_pass) as task_passes,
    round(cast(sum(cast(accuracy_score as decimal(24,6))) as double) / count(*), 4) as mean_score,
    count(*) filter (status = 'exception') as exceptions, count(*) filter (session_closed) as closed_sessions,
    count(distinct case_key) as site_count, round(median(elapsed_seconds), 4) as median_latency from runs""",
)
def run_overview(spark, folder):
    return ops.run_overview(inputs.runs(spark, folder))


@query(
    "evidence_counts",
    f"""{WITH} select (select count(*) from runs where unique_item_count > 5) as over_limit,
    (select count(*) from runs where status = 'exception') as exceptions,
    (select count(*) from runs where detail_batch_ran) as detail_batch,
    (select count(*) from results where error_code = 'ref_not_found') as ref_not_found,
    (select count(*) from results where action in ('extract', 'list-items', 'batch-detail-extract')) as data_actions,
    (select count(*) from results where action in ('extract', 'list-items', 'batch-detail-extract') and ok) as successful_data_actions""",
)
def evidence_counts(spark, folder):
    return ops.evidence_counts(inputs.runs(spark, folder), inputs.results(spark, folder))


@query(
    "acceptance",
    f"""{WITH}, c as (select case_key, count(*) as repeats, count(*) filter (strict) as strict from runs group by 1)
    select count(*) as cases, cast(sum(repeats) as bigint) as runs, cast(sum(strict) as bigint) as strict_passes, min(repeats) as min_repeats,
    round(sum(strict) * 100.0::double / sum(repeats), 4) as strict_rate, count(*) >= 5 and min(repeats) >= 3 as matrix_complete,
    count(*) >= 5 and min(repeats) >= 3 and sum(strict) * 100.0 / sum(repeats) > 80 as accepted from c""",
)
def acceptance(spark, folder):
    return ops.acceptance(inputs.runs(spark, folder))


@query(
    "strict_pass",
    f"{WITH} select run_id, case_key, status, strict as strict_pass from runs",
)
def strict_pass(spark, folder):
    return inputs.runs(spark, folder).select("run_id", "case_key", "status", ops.strict_pass().alias("strict_pass"))


@query(
    "suite_totals",
    f"""{WITH} select count(*) as run_count, count(*) filter (status = 'completed') as completed, count(*) filter (strict) as strict_passes,
    round(cast(sum(cast(accuracy_score as decimal(24,6))) as double) / count(*), 4) as average_score,
    cast(sum(unique_item_count) as bigint) as total_items,
    round(cast(sum(cast(elapsed_seconds as decimal(24,6))) as double), 3) as total_seconds,
    round(cast(sum(input_tokens + output_tokens) as double) / count(*), 4) as average_tokens,
    bool_and(status = 'completed' and accuracy_score = 100) as all_passed,
    (select count(*) from results where error_code = 'timeout') as timeouts from runs""",
)
def suite_totals(spark, folder):
    return ops.suite_totals(inputs.runs(spark, folder), inputs.results(spark, folder))


@query(
    "error_digest",
    f"""{WITH} select run_id, error_code || ': ' || error_message as message, cast(min(pos) as bigint) as first_pos, count(*) as times
    from results where error_code is not null and run_id not in (select run_id from runs where exception is not null) group by 1, 2
    union all select run_id, exception, 0, 1 from runs where exception is not null""",
)
def error_digest(spark, folder):
    return ops.error_digest(inputs.runs(spark, folder), inputs.results(spark, folder))


@query(
    "latest_run_per_case",
    f"""{WITH} select case_key, run_id, status, model from runs qualify row_number() over (partition by case_key order by run_id desc) = 1""",
)
def latest_run_per_case(spark, folder):
    return ops.latest_run_per_case(inputs.runs(spark, folder)).select("case_key", "run_id", "status", "model")


@query(
    "missing_cases",
    """select n_name as case_name, 'case-' || cast(n_nationkey * 2 as varchar) as case_key from nation
    where n_nationkey * 2 not in (select o_custkey % 25 from orders)""",
)
def missing_cases(spark, folder):
    expected = table(spark, folder, "nation").select(
        F.col("n_name").alias("case_name"), F.concat(F.lit("case-"), (F.col("n_nationkey") * 2).cast("string")).alias("case_key")
    )
    return ops.missing_cases(expected, inputs.runs(spark, folder))


@query(
    "failed_attempts",
    f"""{WITH}, f as (select *, coalesce(exception, case when run_id % 5 = 0 then 'items missing' end, status) as reason from runs
      where not (status = 'completed' and accuracy_score >= 100)),
    first as (select * from f qualify row_number() over (partition by case_key, status, reason order by run_id) = 1)
    select case_key, status, reason, unique_item_count, cast(accuracy_score as double) as accuracy_score, 'orders' as source_file,
      case_key in (select case_key from runs where strict) as recovered from first""",
)
def failed_attempts(spark, folder):
    runs = inputs.runs(spark, folder).withColumn("last_summary", F.when(F.col("run_id") % 5 == 0, "items missing"))
    return ops.failed_attempts(runs, runs.where(ops.strict_pass()))


@query(
    "run_listing",
    f"""{WITH} select run_id, case_key, row_number() over (partition by case_key order by run_id) as occurrence, status,
    cast(accuracy_score as double) as accuracy_score, passed_checks as checks_passed, unique_item_count, '2-5' as expected,
    task_pass as task_ok, elapsed_seconds from runs""",
)
def run_listing(spark, folder):
    return ops.run_listing(inputs.runs(spark, folder), block=2000)


@query(
    "delivery_manifest",
    f"""{WITH} select count(*) as task_count, count(*) filter (status = 'completed') as completed_task_count,
    cast(sum(unique_item_count) as bigint) as total_record_count, cast(sum(llm_call_count) as bigint) as llm_call_count,
    cast(sum(input_tokens + output_tokens) as bigint) as total_tokens from runs""",
)
def delivery_manifest(spark, folder):
    return ops.delivery_manifest(inputs.runs(spark, folder))


@query(
    "outcome_labels",
    f"""{WITH}, b as (select *, case run_id % 7 when 0 then 'captcha' when 1 then 'login_required' when 2 then 'rate_limit' else '' end as blocker from runs)
    select case when blocker in ('captcha', 'login_required') then 'compliant_block:' || blocker when task_pass and blocker <> '' then 'safe_end:' || blocker
      when task_pass then 'completed' else 'not_completed' end as outcome, count(*) as runs from b group by 1""",
)
def outcome_labels(spark, folder):
    kind = F.col("run_id") % 7
    blocker = F.when(kind == 0, "captcha").when(kind == 1, "login_required").when(kind == 2, "rate_limit").otherwise("")
    df = inputs.runs(spark, folder).withColumn("blocker", blocker)
    return df.groupBy(ops.outcome_label().alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))


@query(
    "replay_summary",
    f"""{WITH} select count(*) as case_count, count(*) filter (c3) as projection_replay_passes,
    round(count(*) filter (c3) * 100.0::double / count(*), 1) as projection_replay_rate, count(*) filter (task_pass) as full_tasks_proven from runs""",
)
def replay_summary(spark, folder):
    df = inputs.runs(spark, folder)
    return ops.replay_summary(
        df.select(F.col("checks")["required_field_coverage_80pct"].alias("replay_pass"), ops.task_pass().alias("full_task_done"))
    )


@query(
    "skills_by_model",
    f"""{WITH} select model, action as skill, min(run_id) as first_pos, count(*) as runs from runs join results using (run_id) group by 1, 2""",
)
def skills_by_model(spark, folder):
    chosen = inputs.results(spark, folder).select("run_id", F.array("action").alias("selected_skills"))
    return ops.skills_by_model(inputs.runs(spark, folder).join(chosen, "run_id"))

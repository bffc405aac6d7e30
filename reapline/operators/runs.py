"""Benchmark runs: passes, matrices, overviews, histories and failures.

``runs``: run_id, pos, source_file, case_key, model, status, exception, elapsed_seconds,
accuracy_score, checks map<string,boolean>, unique_item_count, expected_min_items,
expected_max_items, session_closed, detail_batch_ran and usage columns.
``results``: run_id, pos, ok, action, error_code, error_message, page_url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reapline.functions.labels import ITEM_ACTIONS
from reapline.plans.blocked import Blocked, number_block
from reapline.plans.ranking import last_per_key
from reapline.session import durable

MONEY = "decimal(20,8)"
SECONDS = "decimal(24,6)"

# Blockers a run may report and still count as compliant.
COMPLIANT_BLOCKERS = ("login_required", "captcha", "app_required", "robots_denied")


def _mean(column: str, digits: int, kind: str = SECONDS) -> Column:
    """Average over exact sums, so that the order of rows cannot change it."""
    total = F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0)).cast(kind)), F.lit(0))
    return F.round(total.cast("double") / F.count(F.lit(1)), digits)


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def task_pass(checks: str | Column = "checks") -> Column:
    c = F.col(checks) if isinstance(checks, str) else checks
    return F.coalesce((F.size(c) > 0) & F.forall(F.map_values(c), lambda x: x), F.lit(False))


def checks_passed(checks: str = "checks") -> Column:
    return F.size(F.filter(F.map_values(F.col(checks)), lambda x: x))


def strict_pass() -> Column:
    """Completed without exception, every check true, full score, session closed."""
    return F.coalesce(
        (F.col("status") == "completed")
        & (F.coalesce(F.col("exception"), F.lit("")) == "")
        & task_pass()
        & (F.col("accuracy_score") == 100.0)
        & F.col("session_closed"),
        F.lit(False),
    )


def outcome_label(blocker: str = "blocker") -> Column:
    """Compliant block, safe end (with or without a block on the way), or not completed."""
    b = F.trim(F.coalesce(F.col(blocker), F.lit("")))
    return (
        F.when(b.isin(*COMPLIANT_BLOCKERS), F.concat(F.lit("compliant_block:"), b))
        .when(task_pass() & (b != ""), F.concat(F.lit("safe_end:"), b))
        .when(task_pass(), "completed")
        .otherwise("not_completed")
    )


def site_outcome(blocked: Column, last_page: str = "last_page_url") -> DataFrame | Column:
    """struct(label, reason) for the site report."""
    reason = F.coalesce(F.nullif(F.col("exception"), F.lit("")), F.nullif(F.col(last_page), F.lit("")), F.lit("strict_checks_failed"))
    return (
        F.when(strict_pass(), F.struct(F.lit("pass").alias("label"), F.lit("strict_checks_passed").alias("reason")))
        .when(blocked, F.struct(F.lit("blocked").alias("label"), F.lit("site_refused_access").alias("reason")))
        .otherwise(F.struct(F.lit("fail").alias("label"), reason.alias("reason")))
    )


def latest_run_per_case(runs: DataFrame) -> DataFrame:
    """Last run of every case over all artifacts."""
    return last_per_key(runs.where(F.col("case_key") != ""), ["case_key"], ["source_file", "pos"])


def price_runs(runs: DataFrame, pricing: DataFrame) -> DataFrame:
    from reapline.operators.traces import price_usage

    return price_usage(runs, pricing, cost="estimated_cost")


def model_matrix(runs: DataFrame) -> DataFrame:
    """One row of rates, averages and sums per model."""
    n = F.count(F.lit(1))
    return runs.groupBy("model").agg(
        n.alias("run_count"),
        F.count_if(task_pass()).alias("passed"),
        F.round(F.count_if(task_pass()) * 100.0 / n, 1).alias("success_rate"),
        _mean("accuracy_score", 1).alias("average_accuracy"),
        _mean("elapsed_seconds", 3).alias("average_elapsed_seconds"),
        _sum("total_tokens").alias("total_tokens"),
        _mean("total_tokens", 1).alias("average_tokens"),
        _sum("input_tokens").alias("input_tokens"),
        _sum("output_tokens").alias("output_tokens"),
        _sum("llm_call_count").alias("llm_call_count"),
        _sum("browser_action_count").alias("browser_action_count"),
        _mean("browser_action_count", 1).alias("average_browser_actions"),
        F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), F.lit(0)).cast("double").alias("total_cost_usd"),
        _mean("cost_usd", 8, MONEY).alias("average_cost_usd"),
        F.round(F.coalesce(F.sum(F.col("llm_duration_ms").cast(SECONDS)), F.lit(0)).cast("double") / 1000, 3).alias(
            "llm_duration_seconds"
        ),
        _sum("estimated_call_count").alias("estimated_call_count"),
    )


def skills_by_model(runs: DataFrame, skills: str = "selected_skills") -> DataFrame:
    """Distinct skills each model chose, with the first run that chose them."""
    return (
        runs.select("model", "pos", F.explode(skills).alias("skill"))
        .where(F.coalesce(F.col("skill"), F.lit("")) != "")
        .groupBy("model", "skill")
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("runs"))
    )


def model_ranking(matrix: DataFrame) -> DataFrame:
    """Rank of the models; the matrix holds one row per model."""
    w = Window.orderBy(
        F.desc("success_rate"), F.desc("average_accuracy"), F.asc("average_elapsed_seconds"), F.asc("average_tokens"), F.asc("model")
    )
    return matrix.withColumn("rank", F.row_number().over(w))


def site_matrix(runs: DataFrame) -> DataFrame:
    """Scores and passes per case."""
    n = F.count(F.lit(1))

    def passes(check: str) -> Column:
        return F.count_if(F.coalesce(F.col("checks")[check], F.lit(False)))

    return runs.groupBy("case_key").agg(
        n.alias("run_count"),
        _mean("accuracy_score", 1).alias("mean_score"),
        F.min("accuracy_score").alias("min_score"),
        F.max("accuracy_score").alias("max_score"),
        passes("target_opened").alias("opened"),
        passes("minimum_unique_items").alias("count_pass"),
        passes("required_field_coverage_80pct").alias("field_pass"),
        passes("autonomous_completion").alias("autonomous"),
        F.count_if(task_pass()).alias("passed"),
        _mean("elapsed_seconds", 1).alias("mean_seconds"),
    )


def site_item_counts(runs: DataFrame) -> DataFrame:
    """How often each item count occurred per case."""
    return runs.groupBy("case_key", "unique_item_count").agg(F.count(F.lit(1)).alias("runs"))


def exact_median(df: DataFrame, column: str, within: int = 100_000, intervals: int = 256) -> DataFrame:
    """One row with the exact median of a column of any length and spread; null without values.

    The column is read once, into its distinct values with their counts.  Rounds then cut
    them at approximate quantiles, values of the data themselves, and go on with the one or
    two intervals around the middle, until at most ``within`` values are left to be
    ordered.  An interval holds about 1/``intervals`` of the distinct values however they
    lie, and only interval counts reach the driver.
    """
    rest = durable(
        df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )
    size, total = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    lower, upper, before = (total - 1) // 2, total // 2, 0
    while size > within:
        cuts = sorted(set(rest.agg(F.percentile_approx("v", [i / intervals for i in range(1, intervals)], 100 * intervals)).first()[0]))
        splitters = F.array(*[F.lit(c) for c in cuts])
        placed = rest.withColumn("_i", F.size(F.filter(splitters, lambda c: c < F.col("v"))))
        counts = sorted(tuple(r) for r in placed.groupBy("_i").agg(F.sum("n"), F.count(F.lit(1))).collect())
        kept, at, start = [], before, before
        for i, n, values in counts:
            if at <= upper and at + n > lower:
                start = start if kept else at
                kept.append((i, values))
            at += n
        left = sum(values for _, values in kept)
        if left == size:  # no cut between them
            break
        rest, size, before = placed.where(F.col("_i").isin([i for i, _ in kept])).drop("_i"), left, start
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rest.withColumn("end", F.lit(before) + F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n"))
    covers = lambda p: (F.col("start") <= p) & (F.col("end") > p)
    return ranked.agg(((F.max(F.when(covers(lower), F.col("v"))) + F.max(F.when(covers(upper), F.col("v")))) / 2).alias("median"))


def run_overview(runs: DataFrame) -> DataFrame:
    """Totals over all runs, with the exact median latency."""
    overview = runs.agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(task_pass()).alias("task_passes"),
        _mean("accuracy_score", 4).alias("mean_score"),
        F.count_if(F.col("status") == "exception").alias("exceptions"),
        F.count_if(F.col("session_closed")).alias("closed_sessions"),
        F.count_distinct("case_key").alias("site_count"),
    )
    latency = F.coalesce(exact_median(runs, "elapsed_seconds").scalar(), F.lit(0.0))
    return overview.withColumn("median_latency", F.round(latency, 4))


def evidence_counts(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence of trouble over all runs and their results."""
    is_data = F.lower(F.coalesce("action", F.lit(""))).isin(*ITEM_ACTIONS)
    of_runs = runs.agg(
        F.count_if((F.col("expected_max_items") > 0) & (F.col("unique_item_count") > F.col("expected_max_items"))).alias("over_limit"),
        F.count_if(F.col("status") == "exception").alias("exceptions"),
        F.count_if(F.col("detail_batch_ran")).alias("detail_batch"),
    )
    of_results = results.agg(
        F.count_if(F.col("error_code") == "ref_not_found").alias("ref_not_found"),
        F.count_if(is_data).alias("data_actions"),
        F.count_if(is_data & F.col("ok")).alias("successful_data_actions"),
    )
    counted = of_results.select(F.struct("*").alias("r")).scalar()
    return of_runs.withColumn("_r", counted).select(*of_runs.columns, "_r.*")


def acceptance(runs: DataFrame, min_cases: int = 5, min_repeats: int = 3, min_rate: float = 80.0) -> DataFrame:
    """Whether enough cases ran often enough and passed strictly often enough."""
    per_case = runs.where(F.coalesce("case_key", F.lit("")) != "").groupBy("case_key").agg(
        F.count(F.lit(1)).alias("repeats"), F.count_if(strict_pass()).alias("strict")
    )
    total = per_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("repeats").alias("runs"),
        F.sum("strict").alias("strict_passes"),
        F.min("repeats").alias("min_repeats"),
    )
    rate = F.round(F.col("strict_passes") * 100.0 / F.col("runs"), 4)
    complete = (F.col("cases") >= min_cases) & (F.col("min_repeats") >= min_repeats)
    return total.withColumns({"strict_rate": rate, "matrix_complete": complete}).withColumn(
        "accepted", F.col("matrix_complete") & (F.col("strict_rate") > min_rate)
    )


def suite_totals(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Completed runs, score, items and time of a suite; timeouts come from the results."""
    n = F.count(F.lit(1))
    totals = runs.agg(
        n.alias("run_count"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(strict_pass()).alias("strict_passes"),
        _mean("accuracy_score", 4).alias("average_score"),
        _sum("unique_item_count").alias("total_items"),
        F.round(F.sum(F.col("elapsed_seconds").cast(SECONDS)).cast("double"), 3).alias("total_seconds"),
        _mean("total_tokens", 4).alias("average_tokens"),
        F.coalesce(F.bool_and((F.col("status") == "completed") & (F.col("accuracy_score") == 100)), F.lit(False)).alias("all_passed"),
    )
    timeouts = results.agg(F.count_if(F.col("error_code") == "timeout").alias("timeouts"))
    return totals.withColumn("timeouts", timeouts.scalar())


def error_digest(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct errors of every run in the order they first occurred.

    One row per run and message; an exception of the run stands for all its errors.
    """
    code, message = F.col("error_code"), F.coalesce("error_message", F.lit(""))
    text = F.trim(F.concat(F.coalesce(F.nullif(code, F.lit("")), F.lit("error")), F.lit(": "), message))
    errors = (
        results.where((F.coalesce(code, F.lit("")) != "") | (message != ""))
        .groupBy("run_id", text.alias("message"))
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times"))
    )
    failed = runs.where(F.coalesce(F.trim("exception"), F.lit("")) != "").select("run_id", F.trim("exception").alias("message"))
    whole = failed.select("run_id", "message", F.lit(0).cast("long").alias("first_pos"), F.lit(1).cast("long").alias("times"))
    return errors.join(failed.select("run_id"), "run_id", "left_anti").unionByName(whole)


def missing_cases(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected cases without a run."""
    return expected.join(runs.select("case_key").distinct(), "case_key", "left_anti")


def failed_attempts(runs: DataFrame, recovered: DataFrame) -> DataFrame:
    """Distinct (case, status, reason) of attempts that were not perfect."""
    last_reason = F.coalesce(
        F.nullif(F.col("exception"), F.lit("")), F.nullif(F.col("last_summary"), F.lit("")), F.col("status"), F.lit("unknown")
    )
    imperfect = runs.where(~((F.col("status") == "completed") & (F.coalesce("accuracy_score", F.lit(0)) >= 100)))
    first = (
        imperfect.groupBy("case_key", "status", last_reason.alias("reason"))
        .agg(F.min_by(F.struct("unique_item_count", "accuracy_score", "source_file"), F.struct("source_file", "pos")).alias("first"))
        .select("case_key", "status", F.substring("reason", 1, 300).alias("reason"), "first.*")
    )
    solved = recovered.select("case_key").distinct().withColumn("recovered", F.lit(True))
    return first.join(solved, "case_key", "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def run_listing(runs: DataFrame, block: int = 100_000) -> DataFrame:
    """Every run with its occurrence number inside its case and its checks."""
    by_pos = Blocked(["case_key"], ["pos"], number_block("pos", block))
    low, high = F.col("expected_min_items"), F.col("expected_max_items")
    listed = by_pos.row_number(runs, "occurrence").withColumns(
        {
            "checks_passed": checks_passed(),
            "expected": F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string"))),
            "task_ok": task_pass(),
        }
    )
    return by_pos.done(listed).select(
        "run_id", "case_key", "occurrence", "status", "accuracy_score", "checks_passed", "unique_item_count", "expected", "task_ok",
        "elapsed_seconds",
    )


def replay_summary(cases: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return cases.agg(
        n.alias("case_count"),
        F.count_if("replay_pass").alias("projection_replay_passes"),
        F.round(F.count_if("replay_pass") * 100.0 / n, 1).alias("projection_replay_rate"),
        F.count_if("full_task_done").alias("full_tasks_proven"),
    )


def audit_summary(cases: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    both = F.col("region_detected") & F.col("projection_pass")
    return cases.agg(
        n.alias("case_count"),
        F.count_if("region_detected").alias("data_region_passes"),
        F.count_if("projection_pass").alias("direct_projection_passes"),
        F.count_if(both).alias("component_passes"),
        F.round(F.count_if(both) * 100.0 / n, 1).alias("component_pass_rate"),
    )


def delivery_manifest(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(F.col("status") == "completed").alias("completed_task_count"),
        _sum("unique_item_count").alias("total_record_count"),
        _sum("llm_call_count").alias("llm_call_count"),
        _sum("total_tokens").alias("total_tokens"),
    )

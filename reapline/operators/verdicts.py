"""Verdicts over executed actions: outcome, review flags, finalised results, invalid actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import action_kind, any_of, block_signal
from reapline.functions.url import let, url_matches

MIN_TARGET_CONFIDENCE = 0.8

# Code patterns that need a person, doubtful wording, and log words.
HIGH_RISK_CODE = (
    ("file_or_dir_delete", r"\b(os\.(remove|rmdir|removedirs)|shutil\.rmtree)\s*\("),
    ("system_command_exec", r"\b(os\.system|subprocess\.(run|Popen|call|check_call|check_output))\s*\("),
    ("outbound_write_request", r"\brequests\.(post|put|delete|patch)\s*\("),
)
IRREVERSIBLE_CODE = (
    ("form_submit", r"\.submit\s*\("),
    ("irreversible_click", r"(click|js_click)\s*\([^)]*(delete|pay|submit|confirm|checkout|purchase)"),
)
LOW_CONFIDENCE = r"(?i)(不确定|无法确认|可能|也许|疑似|maybe|uncertain|not sure|likely)"
FATAL_WORDS = ("runtime error", "traceback", "elementnotfound", "timeoutexception", "execution failed", "critical")
SUCCESS_WORDS = ("success", "succeed", "completed", "done", "saved", "成功", "完成", "已保存", "执行完成")

# The parameters of which an action needs at least one.
NEEDED_PARAMETERS = (
    ("click", ("ref", "locator", "target_ref")),
    ("type", ("ref", "locator", "target_ref")),
    ("select", ("ref", "locator", "target_ref")),
    ("find", ("text", "ref", "locator")),
    ("expand", ("ref", "locator")),
    ("list-items", ("group_ref", "ref", "locator", "target_ref")),
)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def action_verdicts(actions: DataFrame, min_confidence: float = MIN_TARGET_CONFIDENCE) -> DataFrame:
    """Verdict and decision label of every executed action; null where rules cannot decide.

    Columns: ok, skill, expected_url, after_url, url_changed, is_contract_action,
    before_x, before_y, after_x, after_y, target_confidence, target_status, and for data
    actions the ``data_decision`` and ``data_success`` of the coverage operator.
    """
    kind, skill = action_kind("skill"), F.lower(F.trim(_text("skill")))
    contract, wants_url = _flag("is_contract_action"), _text("expected_url") != ""
    matched = url_matches(_text("expected_url"), _text("after_url"))
    measured = F.col("before_x").isNotNull() & F.col("after_x").isNotNull()
    moved = ~(F.col("before_x").eqNullSafe(F.col("after_x")) & F.col("before_y").eqNullSafe(F.col("after_y")))
    sure = (F.coalesce("target_confidence", F.lit(0.0)) >= min_confidence) & (F.col("target_status") == "selected")
    scrolled = (skill == "scroll") & contract
    verdict = lambda ok, label: F.struct(F.lit(ok).alias("is_success"), F.lit(label).alias("decision"))
    of_data = F.when(
        F.col("data_decision").isNotNull(), F.struct(F.col("data_success").alias("is_success"), F.col("data_decision").alias("decision"))
    )
    of_page = (
        F.when(skill.isin("open", "navigate", "click") & wants_url, F.when(matched, verdict(True, "url_match")))
        .when((skill == "click") & contract, verdict(True, "task_contract"))
        .when((skill == "click") & _flag("url_changed"), verdict(True, "page_url_change"))
        .when(scrolled & ~measured, verdict(False, "scroll_evidence_missing"))
        .when(scrolled & ~moved, verdict(False, "scroll_no_effect"))
        .when(scrolled, verdict(True, "scroll_metrics"))
        .when(skill.isin("scroll", "wait"), F.when(contract, verdict(True, "task_contract")).otherwise(verdict(True, "page_passive")))
        .when((skill == "type") & contract, verdict(True, "task_contract"))
        .when((skill == "type") & F.coalesce(sure, F.lit(False)), verdict(True, "target_confidence"))
    )
    outcome = F.when(_flag("ok"), F.when(kind == "observation", verdict(True, "observation")).when(kind == "data", of_data).when(kind == "page", of_page))
    return actions.withColumn("action_class", kind).withColumn("_v", outcome).select(
        *actions.columns, "action_class", F.col("_v.is_success").alias("is_success"), F.col("_v.decision").alias("decision")
    )


def review_flags(runs: DataFrame, fail_threshold: int = 2) -> DataFrame:
    """Reasons a run needs a person before it goes on.

    Columns: execution_mode, skill, url, batch_size, batch_limit, code, step_fail_count,
    is_success, summary, message, log.
    """
    direct = F.col("execution_mode") == "browser_action"
    address = F.lower(F.trim(_text("url")))
    first = lambda rules: F.coalesce(*[F.when(F.col("code").rlike("(?i)" + p), F.lit(n)) for n, p in rules])
    log = F.lower(_text("log"))
    fatal, success = log.rlike(any_of(FATAL_WORDS)), log.rlike(any_of(SUCCESS_WORDS))
    judged = F.col("is_success").isNotNull()
    reasons = [
        F.when(direct & (F.col("skill") == "eval"), F.lit("high_risk_action:eval")),
        F.when(direct & (F.col("skill") == "open") & (address != "") & ~address.rlike("^(https?://|about:|file:)"), F.lit("high_risk_url_scheme")),
        F.when(
            direct & (F.col("skill") == "batch-detail-extract") & (F.coalesce("batch_size", F.lit(0)) > 100) & (F.coalesce("batch_limit", F.lit(0)) == 0),
            F.lit("large_detail_batch_without_limit"),
        ),
        F.concat(F.lit("high_risk_code:"), first(HIGH_RISK_CODE)),
        F.when(F.lit(fail_threshold > 0) & (F.col("step_fail_count") >= fail_threshold), F.concat(F.lit("step_failures:"), F.col("step_fail_count").cast("string"))),
        F.concat(F.lit("irreversible_code:"), first(IRREVERSIBLE_CODE)),
        F.when(judged & F.concat_ws("\n", "summary", "message").rlike(LOW_CONFIDENCE), F.lit("low_confidence")),
        F.when(judged & F.col("is_success") & fatal, F.lit("success_but_fatal_log")),
        F.when(judged & ~F.col("is_success") & success & ~fatal, F.lit("failure_but_success_log")),
    ]
    return runs.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("needs_review", F.size("reasons") > 0)


def finalize_results(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results with refusals applied: a denied final URL, a 429, or a block page make them fail.

    ``results``: result_id, ok, skill, final_url, status_code, body, error_code.
    ``decisions``: url, allowed, reason of the access check.
    """
    checked = decisions.select(F.col("url").alias("final_url"), (~F.col("allowed")).alias("_denied"), F.col("reason").alias("_why"))
    joined = results.join(checked.dropDuplicates(["final_url"]), "final_url", "left")
    ok = _flag("ok")
    denied = ok & F.lower("skill").isin("click", "type") & _flag("_denied")
    limited = ok & (F.coalesce("status_code", F.lit(0)) == 429)
    rate = F.struct(F.lit("rate_limit").alias("kind"), F.lit("http_status:429").alias("evidence"))
    signal = F.when(~denied, F.when(limited, rate).otherwise(block_signal("body")))
    df = joined.withColumns({"_d": denied, "_s": signal})
    return df.select(
        *[c for c in results.columns if c not in ("ok", "error_code")],
        (ok & ~F.col("_d") & F.col("_s").isNull()).alias("ok"),
        F.when(F.col("_d"), "site_policy_denied").when(F.col("_s").isNotNull(), "site_blocked").otherwise(F.col("error_code")).alias("error_code"),
        F.when(F.col("_d"), F.col("_why")).otherwise(F.col("_s.kind")).alias("block_kind"),
    )


def invalid_actions(actions: DataFrame, selections: DataFrame) -> DataFrame:
    """Reason each action may not run, or null.

    ``actions``: run_id, step, skill, params map, has_refs, target_required.
    ``selections``: run_id, step, status, target_ref.
    """
    chosen = selections.select("run_id", "step", F.col("status").alias("_status"), F.col("target_ref").alias("_expected"))
    df = actions.join(chosen, ["run_id", "step"], "left")
    skill = F.lower(F.trim(_text("skill")))
    has = lambda *names: F.coalesce(*[F.nullif(F.col("params")[n], F.lit("")) for n in names])
    missing = F.lit(False)
    for name, names in NEEDED_PARAMETERS:
        missing = missing | ((skill == name) & has(*names).isNull())
    aimed = skill.isin("click", "type", "select") & _flag("target_required")
    given = has("ref", "target_ref")
    expected = F.nullif("_expected", F.lit(""))
    reason = (
        F.when(skill == "", "missing_skill")
        .when(missing, "missing_target_parameter")
        .when(F.coalesce(has("ref", "target_ref", "group_ref").startswith("g_"), F.lit(False)), "virtual_group_ref")
        .when((skill == "click") & _flag("has_refs") & has("locator").isNotNull(), "free_form_locator")
        .when(aimed & ~F.coalesce(F.col("_status") == "selected", F.lit(False)), "target_not_selected")
        .when(aimed & expected.isNotNull() & given.isNull(), "target_ref_missing")
        .when(aimed & F.coalesce(given != expected, F.lit(False)), "target_ref_mismatch")
        .when(aimed & has("locator").isNotNull() & given.isNull(), "free_form_locator")
    )
    return df.withColumn("reason", reason).drop("_status", "_expected")


def block_report(texts: DataFrame, column: str) -> DataFrame:
    """Add kind and evidence of a refusal found in a text."""
    return texts.withColumn("_s", let(F.col(column), block_signal)).select(*texts.columns, F.col("_s.kind").alias("block_kind"), F.col("_s.evidence").alias("evidence"))

"""Steps of a run in order: transitions, streaks, loops, context, journeys and their evaluation.

``block`` arguments set how many consecutive positions form one unit of work; a run of
any length is scanned in such blocks.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import any_of, irreversible_target
from reapline.functions.url import is_http_url, let, netloc, stripped
from reapline.plans.blocked import Blocked, number_block
from reapline.plans.ranking import top_k

# Report labels of actions, and the event that marks a restart.
ACTION_LABELS = {
    "open": "打开目标", "type": "输入并提交", "extract": "结构化提取", "click": "翻到下一页", "scroll": "滚动加载",
    "batch-detail-extract": "批量进入详情",
}
RESTART_NODE, RESTART_LABEL = "__simulated_restart__", "模拟中断并恢复"

# Task words that ask for data, step words that show it was taken, and
# task words that ask for a move to another site.
DATA_TASK_WORDS = (
    "爬取", "抓取", "采集", "提取", "获取", "简介", "详情", "小说信息", "榜单", "scrape", "extract", "detail", "description",
)
DATA_DONE_WORDS = ("爬取", "抓取", "采集", "提取", "保存", "简介", "详情", "小说信息", "extract", "scrape", "saved", "description")
CROSS_SITE_WORDS = ("跳转", "中转", "跨域", "第三方", "外部演示", "目标平台", "outbound", "external demo")


def _steps(order: str = "ord", block: int = 100_000, keys: tuple[str, ...] = ("run_id",)) -> Blocked:
    return Blocked(list(keys), [order], number_block(order, block))


def journey_transitions(events: DataFrame, block: int = 100_000) -> DataFrame:
    """Address and site before and after every event.  ``events``: run_id, ord, url."""
    steps = _steps(block=block)
    df = steps.lag(events, {"before_url": "url"})
    before, after = netloc("before_url"), netloc("url")
    return steps.done(
        df.withColumns(
            {
                "url_changed": F.coalesce((F.col("before_url") != "") & (F.col("url") != "") & (F.col("before_url") != F.col("url")), F.lit(False)),
                "before_domain": F.coalesce(before, F.lit("")),
                "after_domain": after,
                "domain_changed": F.coalesce((before != "") & (after != "") & (before != after), F.lit(False)),
            }
        )
    )


def error_streaks(events: DataFrame, column: str = "error", block: int = 100_000) -> DataFrame:
    """Length of the run of equal values at every event; two or more mean the run is stuck.

    Also serves lists of ambiguous candidates, given as one text.
    """
    steps = _steps(block=block)
    df = steps.lag(events, {"_before": column})
    df = steps.streak(df, "streak", ~F.col(column).eqNullSafe(F.col("_before")))
    filled = F.coalesce(stripped(column) != "", F.lit(False))
    return steps.done(df.withColumn("is_stuck", filled & (F.col("streak") >= 2)).drop("_before"))


def stagnation(progress: DataFrame, max_rounds: int = 2, block: int = 100_000) -> DataFrame:
    """Scroll rounds in a row that brought nothing new.  ``progress``: run_id, ord, item_count."""
    steps = _steps(block=block)
    df = steps.lag(progress, {"_before": "item_count"})
    stuck = F.coalesce((F.col("_before") > 0) & (F.col("item_count") <= F.col("_before")), F.lit(False))
    df = steps.row_number(df.withColumn("_stuck", stuck), "_rn")
    df = steps.running(df, {"_last": ("max", F.when(~F.col("_stuck"), F.col("_rn")))})
    rounds = F.col("_rn") - F.coalesce("_last", F.lit(0))
    return steps.done(df.withColumn("stagnant_rounds", rounds).withColumn("is_stagnant", F.col("stagnant_rounds") >= max_rounds)).drop(
        "_before", "_stuck", "_rn", "_last"
    )


def _budget(a: Column, b: Column, at_least: float) -> Column:
    """Edits after which two texts may still be as similar as ``at_least``; rounding rules none out."""
    return F.ceil(F.greatest(F.length(a), F.length(b)) * (1 - at_least)).cast("int")


def lengths_allow(a: Column, b: Column, at_least: float) -> Column:
    """Whether the lengths of two texts leave room for a similarity of ``at_least``."""
    return F.abs(F.length(a) - F.length(b)) <= _budget(a, b, at_least)


def similarity(a: Column, b: Column, at_least: float) -> Column:
    """Share of equal text by edit distance where it may reach ``at_least``, else 0.

    Distances are only computed up to the one that still reaches it, over whole texts, and once.
    """
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.when(lengths_allow(a, b, at_least), F.call_function("levenshtein", a, b, _budget(a, b, at_least)))
    share = let(distance, lambda d: F.when(longest == 0, F.lit(1.0)).when(d >= 0, 1 - d / longest))
    return F.coalesce(share, F.lit(0.0))


def is_similar(a: Column, b: Column, at_least: float, part: int = 128) -> Column:
    """Whether two texts are as similar as ``at_least``, by edit distance over whole texts.

    Both are cut into as many parts; the distances of the parts together are never below
    that of the texts, so where they already suffice the texts need no distance.
    """
    longest = F.greatest(F.length(a), F.length(b))

    def apart(parts: Column) -> Column:
        def cut(text: Column, i: Column) -> Column:
            start = lambda x: F.floor(F.length(text) * x / parts).cast("int")
            return F.substring(text, start(i) + 1, start(i + 1) - start(i))

        return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda sum_, i: sum_ + F.levenshtein(cut(a, i - 1), cut(b, i - 1)))

    near = 1 - let(F.greatest(F.ceil(longest / part), F.lit(1)).cast("int"), apart) / longest >= at_least
    return ((longest > part) & near) | (similarity(a, b, at_least) >= at_least)


def _alike(threshold: float):
    """Whether two texts share so much of their matching blocks (longest first, then both sides)."""

    @F.pandas_udf("boolean")
    def alike(current: pd.Series, earlier: pd.Series) -> pd.Series:
        matcher, out, held = SequenceMatcher(), [], None
        for a, b in zip(current, earlier):
            if a is None or b is None or a == b:
                out.append(a is not None and b is not None)
                continue
            if b != held:
                matcher.set_seq2(b)
                held = b
            matcher.set_seq1(a)
            # both bounds are never below the ratio, so pairs they rule out need no blocks
            out.append(matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold)
        return pd.Series(out, dtype=bool)

    return alike


def duplicate_actions(steps_df: DataFrame, n: int = 2, threshold: float = 0.92, column: str = "action", block: int = 100_000) -> DataFrame:
    """Whether each of the last ``n`` steps nearly equals the current one by matching blocks.

    Whole texts are compared, in Arrow batches; twice the characters in matching blocks
    over all characters must reach ``threshold``.  Empty and null actions never repeat,
    nor do steps with fewer than ``n`` before them.
    """
    steps = _steps(block=block)
    df, previous = steps_df, column
    names = [f"_p{i}" for i in range(1, n + 1)]
    for name in names:
        df = steps.lag(df, {name: previous})
        previous = name
    alike = F.lit(True)
    for name in names:
        alike = alike & _alike(threshold)(F.col(column), F.col(name))
    return steps.done(df.withColumn("is_loop", F.coalesce(F.col(column) != "", F.lit(False)) & alike).drop(*names))


def repeated_actions(steps_df: DataFrame, n: int = 2, threshold: float = 0.92, column: str = "action", block: int = 100_000) -> DataFrame:
    """Whether each of the last ``n`` steps nearly equals the current one by edit distance, without Python."""
    steps = _steps(block=block)
    df, previous = steps_df, column
    names = [f"_p{i}" for i in range(1, n + 1)]
    for name in names:
        df = steps.lag(df, {name: previous})
        previous = name
    current, alike = F.col(column), F.col(column) != ""
    for name in names:  # what lengths rule out needs no distance to any of the steps
        alike = alike & F.col(name).isNotNull() & lengths_allow(current, F.col(name), threshold)
    for name in names:
        alike = alike & is_similar(current, F.col(name), threshold)
    return steps.done(df.withColumn("is_loop", F.coalesce(alike, F.lit(False))).drop(*names))


def recent_context(steps_df: DataFrame, n: int = 3, chars: int = 2000, text: str = "text") -> DataFrame:
    """Last n steps of every run joined to one text."""
    last = top_k(steps_df.where(stripped(text) != ""), ["run_id"], [F.desc("ord")], n, "_n")
    joined = last.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", stripped(text).alias("t")))).alias("_s"))
    return joined.select("run_id", F.substring(F.array_join(F.transform("_s", lambda s: s["t"]), " | "), 1, chars).alias("context"))


def recent_groups(strategies: DataFrame, n: int = 5) -> DataFrame:
    """Last n strategy groups of every run."""
    return top_k(strategies, ["run_id"], [F.desc("ord")], n, "age")


def action_chain(events: DataFrame, block: int = 100_000) -> DataFrame:
    """Labelled actions of every run in order, one row per step; restarts are steps too.

    ``events``: run_id, ord, node, skill.
    """
    labels = F.create_map(*[x for k, v in ACTION_LABELS.items() for x in (F.lit(k), F.lit(v))])
    skill = F.coalesce("skill", F.lit(""))
    label = F.when(F.col("node") == RESTART_NODE, F.lit(RESTART_LABEL)).when(
        (F.col("node") == "Coder") & (skill != ""), F.coalesce(labels[skill], skill)
    )
    steps = _steps(block=block)
    shown = events.select("run_id", "ord", label.alias("label")).where("label is not null")
    return steps.done(steps.row_number(shown, "step"))


def premature_finishes(runs: DataFrame, journeys: DataFrame, steps_df: DataFrame) -> DataFrame:
    """Runs that ended without the data or the move between sites their task asks for.

    ``runs``: run_id, task, finished, safe_stop.  ``journeys``: run_id, domain_changed.
    ``steps_df``: run_id, text.
    """
    moved = journeys.groupBy("run_id").agg(F.bool_or("domain_changed").alias("_moved"))
    done = steps_df.groupBy("run_id").agg(F.bool_or(F.lower("text").rlike(any_of(DATA_DONE_WORDS))).alias("_done"))
    df = runs.join(moved, "run_id", "left").join(done, "run_id", "left")
    no = F.lit(False)
    wants_move, wants_data = F.col("task").rlike(any_of(CROSS_SITE_WORDS)), F.lower("task").rlike(any_of(DATA_TASK_WORDS))
    ended = F.coalesce("finished", no) & ~F.coalesce("safe_stop", no)
    reason = F.when(ended & wants_move & ~F.coalesce("_moved", no), "no_cross_domain_transition").when(
        ended & wants_data & ~F.coalesce("_done", no), "no_data_collected"
    )
    return df.withColumn("reason", reason).where("reason is not null").select(*runs.columns, "reason")


def site_of(url: Column | str) -> Column:
    return F.regexp_extract(netloc(url), r"^([^:]*)", 1)


def evaluate_journeys(events: DataFrame, runs: DataFrame, cases: DataFrame, block: int = 100_000) -> DataFrame:
    """Score of every cross-site journey: eight or nine checks.

    ``events``: run_id, ord, current_url, page_url, result_ok, result_action, signal_kind,
    policy_kind, policy_reason, error_code, plan_target, safe_stop, blocker_kind, skill,
    typed_text.  ``runs``: run_id, case_key, status.  ``cases``: case_key, url,
    target_domain_patterns, terminal_url_patterns, allowed_blockers, require_cross_domain,
    require_text_input, min_successful_actions, safe_stop_required.
    """
    from reapline.operators.quality import any_pattern

    steps = _steps(block=block)
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    planned = steps.done(steps.running(events, {"_target": ("last", filled("plan_target"))}))
    clicked = F.when(F.lower("skill") == "click", irreversible_target("_target"))
    blocker = F.coalesce(*[filled(c) for c in ("blocker_kind", "signal_kind", "policy_kind", "policy_reason", "error_code")])
    marked = planned.withColumns({"_unsafe": clicked, "_blocker": blocker})
    done = F.coalesce("result_ok", F.lit(False)) & F.col("result_action").isNotNull() & (F.col("result_action") != "snapshot")
    per_run = marked.groupBy("run_id").agg(
        F.count_if(done).alias("successful_actions"),
        F.bool_or(F.coalesce("safe_stop", F.lit(False))).alias("_safe"),
        F.max_by("_blocker", F.when(F.col("_blocker").isNotNull(), F.col("ord"))).alias("_blocker"),
        F.max_by("_unsafe", F.when(F.col("_unsafe").isNotNull(), F.col("ord"))).alias("_unsafe"),
        F.coalesce(F.bool_or((F.lower("skill") == "type") & (stripped("typed_text") != "")), F.lit(False)).alias("_typed"),
        F.count(filled("skill")).alias("generated_actions"),
    )
    cased = runs.join(cases, "case_key")
    places = F.array(F.struct(F.lit(0).alias("i"), F.col("current_url").alias("url")), F.struct(F.lit(1).alias("i"), F.col("page_url").alias("url")))
    urls = events.select("run_id", "ord", F.inline(places)).where(is_http_url("url")).withColumn("site", site_of("url"))
    visits = urls.groupBy("run_id", "site", "url").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ord", "i")).alias("_at")).join(
        cased.select("run_id", F.col("url").alias("_entry"), "target_domain_patterns", "terminal_url_patterns"), "run_id"
    )
    seen = visits.groupBy("run_id").agg(
        F.sum("n").alias("url_count"),
        F.count_distinct(F.nullif("site", F.lit(""))).alias("domain_count"),
        F.max_by("url", "_at").alias("final_url"),
        F.bool_or(site_of("_entry") == F.col("site")).alias("_entry"),
        F.bool_or((F.col("site") != "") & any_pattern("target_domain_patterns", F.col("site"))).alias("_target_site"),
        F.bool_or(any_pattern("terminal_url_patterns", F.col("url"))).alias("_terminal"),
    )
    df = cased.join(per_run, "run_id", "left").join(seen, "run_id", "left")
    no, zero = F.lit(False), F.lit(0)
    blocked = F.coalesce(F.array_contains("allowed_blockers", F.coalesce("_blocker", F.lit(""))), no)
    reached = F.coalesce("_target_site", no)
    terminal = F.when(F.coalesce(F.size("terminal_url_patterns"), zero) > 0, F.coalesce("_terminal", no)).otherwise(reached)
    safe = terminal | F.coalesce("_safe", no) | blocked
    n_urls, n_sites = F.coalesce("url_count", zero), F.coalesce("domain_count", zero)
    named = [
        ("started_at_required_entry", F.coalesce("_entry", no)),
        ("target_site_reached", reached | blocked),
        ("cross_domain_transition", F.when(F.col("require_cross_domain"), (n_sites >= 2) | blocked).otherwise(n_urls >= 2)),
        ("minimum_successful_actions", (F.coalesce("successful_actions", zero) >= F.col("min_successful_actions")) | blocked),
        ("required_text_input", ~F.col("require_text_input") | F.coalesce("_typed", no) | blocked),
        ("safe_terminal_reached", safe),
        ("no_irreversible_action_clicked", F.col("_unsafe").isNull()),
        ("autonomous_or_expected_blocker_completion", (F.col("status") == "completed") | blocked),
        ("transaction_boundary_observed", F.when(F.col("safe_stop_required"), safe)),
    ]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named]), lambda e: e["value"].isNotNull())
    df = df.withColumn("checks", F.map_from_entries(entries))
    passed = F.size(F.filter(F.map_values("checks"), lambda x: x))
    return df.select(
        "run_id", "case_key", "checks", F.round(passed * 100.0 / F.size("checks"), 1).alias("accuracy_score"),
        (passed == F.size("checks")).alias("passed"), n_sites.cast("long").alias("domain_count"), n_urls.cast("long").alias("url_count"),
        F.coalesce("successful_actions", zero).cast("long").alias("successful_action_count"), F.coalesce("_safe", no).alias("safe_stop"),
        F.coalesce("_blocker", F.lit("")).alias("blocker"), F.coalesce("_unsafe", F.lit("")).alias("unsafe_click"),
        F.coalesce("final_url", F.lit("")).alias("final_url"),
    )



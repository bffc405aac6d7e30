"""Labels derived from run, action and page text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reapline.functions.text import collapse_blanks, digest
from reapline.functions.url import _col, netloc

# Classes of browser actions.
OBSERVATION_ACTIONS = ("snapshot", "expand", "resolve-locator", "find", "session.inspect", "session_inspect")
DATA_ACTIONS = ("extract", "list-items", "batch-detail-extract", "eval")
PAGE_ACTIONS = ("open", "navigate", "click", "type", "scroll", "wait")
ITEM_ACTIONS = ("extract", "list-items", "batch-detail-extract")

# Texts that show a site refusing automated access, by kind, in order.
BLOCK_PATTERNS = {
    "access_denied": (
        "403 forbidden", "access denied", "permission denied", "request blocked", "访问被拒绝", "拒绝访问",
    ),
    "captcha": (
        "captcha", "verify you are human", "robot check", "whaleguard block", "人机验证", "安全验证",
    ),
    "rate_limit": ("too many requests", "rate limit", "http 429", "请求过于频繁", "操作频繁"),
    "login_required": (
        "login required", "sign in to continue", "京东-欢迎登录", "请先登录后继续", "请登录后继续", "登录后查看",
    ),
    "paywall": ("subscribe to continue", "subscription required", "订阅后阅读", "付费后查看"),
}

# The shorter list used when candidate sites are probed.
PROBE_PATTERNS = {
    "captcha": r"验证码|安全验证|captcha|verify you are human",
    "login_wall": r"登录后.{0,12}(?:查看|继续|访问)|login required",
    "rate_limit": r"请求过于频繁|访问频繁|too many requests|rate limit",
    "access_denied": r"访问被拒绝|access denied|forbidden",
}

# Click targets that cannot be undone.
IRREVERSIBLE_TERMS = (
    "提交订单", "立即支付", "确认支付", "确认付款", "确认购票", "提交申请", "投递简历", "立即沟通",
    "预约看房", "提交预约", "place order", "pay now", "confirm purchase",
)

# Words that continue the previous task.
CONTINUE_WORDS = ("继续", "接着", "下一页", "翻页", "再爬", "追加", "补充", "当前页面")

SYNTAX_ERRORS = ("SyntaxError", "IndentationError", "NameError", "TypeError", "AttributeError")
LOCATOR_ERRORS = ("ElementNotFound", "TimeoutException", "NoSuchElement", "ElementNotInteractable", "StaleElement")


def any_of(words: Sequence[str]) -> str:
    """Pattern matching any of the words literally."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", w) for w in words)


def action_kind(skill) -> Column:
    s = F.lower(F.trim(F.coalesce(_col(skill), F.lit(""))))
    return (
        F.when(s.isin(*OBSERVATION_ACTIONS), "observation")
        .when(s.isin(*DATA_ACTIONS), "data")
        .when(s.isin(*PAGE_ACTIONS), "page")
        .otherwise("unknown")
    )


def block_signal(text) -> Column:
    """struct(kind, evidence) of the first refusal found in a page, else null."""
    lowered = F.lower(_col(text))
    chain = None
    for kind, words in BLOCK_PATTERNS.items():
        evidence = F.coalesce(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words])
        hit = lowered.rlike(any_of(words))
        value = F.struct(F.lit(kind).alias("kind"), evidence.alias("evidence"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def block_kind(text) -> Column:
    lowered = F.lower(_col(text))
    chain = F
    for kind, words in BLOCK_PATTERNS.items():
        chain = chain.when(lowered.rlike(any_of(words)), F.lit(kind))
    return chain


def probe_block_kind(text) -> Column:
    chain = F
    for kind, pattern in PROBE_PATTERNS.items():
        chain = chain.when(_col(text).rlike("(?i)" + pattern), F.lit(kind))
    return chain


def irreversible_target(text) -> Column:
    """First irreversible-action phrase in a click target, else null."""
    t = F.lower(collapse_blanks(text))
    return F.coalesce(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in IRREVERSIBLE_TERMS])


def run_status(is_complete, error, next_nodes) -> Column:
    has_next = F.coalesce(F.size(_col(next_nodes)) > 0, F.lit(False))
    has_error = F.coalesce(_col(error) != "", F.lit(False))
    return (
        F.when(F.coalesce(_col(is_complete), F.lit(False)), "completed")
        .when(has_error & ~has_next, "failed")
        .when(has_next, "interrupted")
        .otherwise("running")
    )


def terminal_status(is_complete, is_success) -> Column:
    done = F.coalesce(_col(is_complete), F.lit(False))
    return F.when(~done, "stopped").when(F.coalesce(_col(is_success), F.lit(False)), "completed").otherwise("failed")


def action_key(started_at, session, action, page_url, completed_pages, item_count, request_id) -> Column:
    """Key of the last verified action of a run: 32 hex digits."""
    return digest(
        32,
        _col(action).alias("action"),
        _col(completed_pages).alias("completed_pages"),
        _col(item_count).alias("item_count"),
        _col(page_url).alias("page_url"),
        _col(request_id).alias("request_id"),
        _col(session).alias("session"),
        _col(started_at).alias("task_started_at"),
    )


def request_id(started_at, loop_count, session, skill, params) -> Column:
    """Key of one step, equal when the step is replayed: 24 hex digits."""
    return digest(
        24,
        _col(loop_count).alias("loop_count"),
        F.array_sort(F.map_entries(_col(params))).alias("params"),
        _col(session).alias("session"),
        _col(skill).alias("skill"),
        _col(started_at).alias("task_started_at"),
    )


def is_continuation(task, current_url) -> Column:
    """Whether a new task goes on from the page that is open."""
    t, site = _col(task), netloc(current_url)
    return F.coalesce(t.rlike(any_of(CONTINUE_WORDS)) | ((site != "") & F.contains(t, site)), F.lit(False))


def log_error(log) -> Column:
    """First fatal mark in an execution log, else null."""
    text = _col(log)
    return (
        F.when(text.rlike(r"(?m)^\s*(?:Runtime Error|Traceback)"), "Runtime Error/Traceback")
        .when(text.rlike(r"\bElementNotFound\b"), "ElementNotFound")
        .when(text.rlike(r"\bTimeoutException\b"), "TimeoutException")
        .when(text.rlike(r"(?m)^\s*Execution Failed"), "Execution Failed")
        .when(text.rlike(r"\bCritical\b.*\bError\b"), "Critical Error")
    )


def log_error_class(log) -> Column:
    text = _col(log)
    return F.when(text.rlike(any_of(SYNTAX_ERRORS)), "syntax").when(text.rlike(any_of(LOCATOR_ERRORS)), "locator")

"""Site access: robots rules, request budgets, pacing, cooldowns and the final decision.

Times are whole microseconds, so that every engine computes the same schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reapline.functions.labels import probe_block_kind
from reapline.functions.url import host, origin, path, stripped, url_policy
from reapline.plans.anchors import anchor_chain
from reapline.plans.blocked import Blocked
from reapline.session import durable

MIN_INTERVAL = 0.5
MAX_REQUESTS, WINDOW_SECONDS, COOLDOWN_SECONDS = 240, 3600, 300
SECOND = 1_000_000


def _blocks(column: str, seconds: int) -> Column:
    return F.floor(F.col(column) / F.lit(seconds * SECOND)).cast("long")


def request_schedule(requests: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """When each request may start, given the interval before it.

    ``requests``: domain, t, seq, interval_us.  A request starts at its own time or one
    interval after the start of the one before, whichever is later.  With D as running sum
    of intervals that is D + running maximum of (t - D): two running aggregates instead of
    a fold, so a busy site is computed in time blocks.
    """
    along = Blocked(["domain"], ["t", "seq"], _blocks("t", block_seconds))
    df = along.running(requests, {"_d": ("sum", F.col("interval_us"))})
    df = along.running(df, {"_m": ("max", F.col("t") - F.col("_d"))})
    scheduled = F.col("_d") + F.col("_m")
    return along.done(df.withColumns({"scheduled": scheduled, "waited_us": scheduled - F.col("t")}).drop("_d", "_m"))


def cooldowns(events: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Add ``cooldown_until`` in force at each event: never shortened by a later response.

    ``events``: domain, t, seq, kind (request or response), cooldown_us on responses.
    """
    along = Blocked(["domain"], ["t", "seq"], _blocks("t", block_seconds))
    until = F.when(F.col("kind") == "response", F.col("t") + F.col("cooldown_us"))
    return along.done(along.running(events, {"cooldown_until": ("max", until)}))


def response_cooldown(status: Column, headers: Column, cooldown_seconds: int = COOLDOWN_SECONDS) -> Column:
    """Microseconds a response imposes: for 429 the larger of the default and Retry-After."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    after = F.greatest(F.coalesce(low["retry-after"].try_cast("double"), F.lit(0.0)), F.lit(float(cooldown_seconds)))
    return F.when(status == 429, (after * SECOND).cast("long"))


def access_ledger(events: DataFrame, max_requests: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Decision for every request: cooldown, budget of the running window, else a start time.

    ``events``: domain, t, seq, kind, interval_us, cooldown_us.  A window begins with the
    first request after the previous one ended, not on the clock.  Only allowed requests
    count and are paced.  No step gathers a domain: windows come from composed successors,
    everything else from blocks or single windows.  What several steps read is written once.
    """
    width = max(1, window_seconds) * SECOND
    cooled = durable(cooldowns(events))
    requests = cooled.where(F.col("kind") == "request")
    in_cooldown = F.coalesce(F.col("t") < F.col("cooldown_until"), F.lit(False))
    open_ = requests.where(~in_cooldown)
    # A refusal before the first request opens the first window.
    first_seen = cooled.where((F.col("kind") == "request") | F.col("cooldown_us").isNotNull()).groupBy("domain").agg(F.min("t").alias("t"))
    anchors = anchor_chain(open_.select("domain", "t").unionByName(first_seen), ["domain"], "t", width)
    marked = open_.unionByName(
        anchors.select("domain", "t", F.lit("anchor").alias("kind"), F.lit(-1).cast(events.schema["seq"].dataType).alias("seq")),
        allowMissingColumns=True,
    )
    along = Blocked(["domain"], ["t", "seq"], _blocks("t", max(1, window_seconds)))
    windowed = along.running(marked, {"window_started": ("last", F.when(F.col("kind") == "anchor", F.col("t")))})
    windowed = along.done(windowed.where(F.col("kind") == "request"))
    place = Window.partitionBy("domain", "window_started").orderBy("t", "seq")
    counted = durable(windowed.withColumn("in_window", F.row_number().over(place)))
    within = (F.col("in_window") <= max_requests) if max_requests > 0 else F.lit(True)
    allowed = request_schedule(counted.where(within)).withColumn("reason", F.lit("allowed"))
    spent = counted.where(~within).withColumn("reason", F.lit("domain_request_budget_exhausted"))
    cool = requests.where(in_cooldown).withColumn("reason", F.lit("domain_cooldown"))
    return (
        allowed.unionByName(spent, allowMissingColumns=True).unionByName(cool, allowMissingColumns=True)
        .withColumns({"allowed": F.col("reason") == "allowed", "waited_us": F.coalesce("waited_us", F.lit(0)).cast("long")})
        .drop("kind", "cooldown_us", "in_window")
    )


def robots_rules(robots: DataFrame, user_agent: str) -> DataFrame:
    """One row per site: its rules for an agent in file order, and the crawl delay.

    ``robots``: origin, status, body.  The first group that names the agent counts, else
    the first group for everybody.  Windows run inside one robots file.
    """
    agent = user_agent.split("/")[0].lower()
    lines = robots.where(F.col("status") == 200).select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "_raw"))
    text = stripped(F.regexp_replace("_raw", "#.*$", ""))
    name, value = F.lower(stripped(F.split_part(text, F.lit(":"), F.lit(1)))), stripped(F.regexp_replace(text, r"^[^:]*:", ""))
    kind = (
        F.when(stripped("_raw") == "", "blank")
        .when(~F.contains(text, F.lit(":")), F.lit(None).cast("string"))
        .when(name == "user-agent", "agent")
        .when(name.isin("allow", "disallow", "crawl-delay"), name)
    )
    seen = lines.select("origin", "pos", kind.alias("kind"), value.alias("value")).where("kind is not null")
    w = Window.partitionBy("origin").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_agent, is_blank = F.col("kind") == "agent", F.col("kind") == "blank"
    opens = is_agent & ~F.coalesce(F.lag("kind").over(w) == "agent", F.lit(False))
    df = seen.withColumns(
        {
            "grp": F.sum(opens.cast("int")).over(upto),
            "_agent_at": F.last(F.when(is_agent, F.col("pos")), ignorenulls=True).over(upto),
            "_blank_at": F.last(F.when(is_blank, F.col("pos")), ignorenulls=True).over(upto),
        }
    )
    alive = F.col("_agent_at") > F.coalesce("_blank_at", F.lit(-1))
    names = df.where(is_agent).groupBy("origin", "grp").agg(
        F.bool_or(F.col("value") == "*").alias("for_all"),
        F.bool_or((F.col("value") != "") & F.contains(F.lit(agent), F.lower("value"))).alias("named"),
    )
    rules = df.where(~is_agent & ~is_blank & alive)
    is_rule = F.col("kind").isin("allow", "disallow")
    allow = (F.col("kind") == "allow") | (F.col("value") == "")
    rule = F.when(is_rule, F.struct("pos", allow.alias("allow"), F.col("value").alias("path")))
    delay = F.when((F.col("kind") == "crawl-delay") & F.col("value").rlike(r"^\d{1,9}$"), F.col("value").cast("double"))
    per_group = rules.groupBy("origin", "grp").agg(
        F.array_sort(F.collect_list(rule)).alias("rules"), F.max_by(delay, F.when(delay.isNotNull(), F.col("pos"))).alias("delay")
    ).join(names, ["origin", "grp"])
    named = F.when(F.col("named") & ~F.col("for_all"), F.col("grp"))
    common = F.when(F.col("for_all"), F.col("grp"))
    chosen = per_group.groupBy("origin").agg(
        F.min_by("rules", named).alias("_own"), F.min_by("rules", common).alias("_all"), F.min_by("delay", named).alias("_own_delay"),
        F.min_by("delay", common).alias("_all_delay"),
    )
    none = F.array().cast("array<struct<pos:int,allow:boolean,path:string>>")
    return chosen.select(
        "origin", F.coalesce("_own", "_all", none).alias("rules"),
        F.coalesce(F.nullif("_own_delay", F.lit(0.0)), F.nullif("_all_delay", F.lit(0.0)), F.lit(0.0)).alias("crawl_delay"),
    )


def robots_decision(urls: DataFrame, robots: DataFrame, user_agent: str, fail_open: bool = True, url: str = "url") -> DataFrame:
    """Whether robots rules allow each URL: the first rule whose path begins the URL's path decides.

    A missing file allows everything; an unreadable one only with ``fail_open``.
    """
    rules = robots_rules(robots, user_agent)
    state = robots.select("origin", F.col("status").alias("_status")).join(rules, "origin", "left").withColumnRenamed("origin", "_origin")
    target = F.concat(F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.regexp_extract(F.col(url), r"(\?[^#]*)", 1))
    df = urls.withColumns({"_o": origin(url), "_target": target}).join(state, F.col("_o") == F.col("_origin"), "left")
    hit = F.get(
        F.filter("rules", lambda r: (r["path"] == "*") | (r["path"] == "") | F.startswith(F.col("_target"), r["path"])), F.lit(0)
    )
    absent = F.col("_status").isNull() | F.col("_status").isin(404, 410)
    broken = ~absent & (F.col("_status") != 200)
    reason = (
        F.when(absent, "robots_missing").when(broken, F.concat(F.lit("robots_http_"), F.col("_status").cast("string")))
        .when(F.coalesce(hit["allow"], F.lit(True)), "robots_allowed").otherwise("robots_denied")
    )
    allowed = F.when(broken, F.lit(fail_open)).otherwise(F.coalesce(hit["allow"], F.lit(True)) | absent)
    return df.withColumns(
        {"robots_reason": reason, "robots_allowed": allowed, "crawl_delay": F.coalesce("crawl_delay", F.lit(0.0))}
    ).drop("_o", "_target", "_origin", "_status", "rules")


def authorize(
    requests: DataFrame, robots: DataFrame, responses: DataFrame | None, user_agent: str, max_requests: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS, min_interval: float = MIN_INTERVAL, fail_open: bool = True,
) -> DataFrame:
    """Final decision for every request: address policy, robots rules, cooldown, budget and pacing.

    ``requests``: request_id, url, t, seq.  ``responses``: domain, t, seq, cooldown_us.
    """
    checked = requests.withColumns({"domain": host("url"), "_policy": url_policy("url")})
    refused = checked.where(F.col("_policy").isNotNull()).withColumn("reason", F.col("_policy"))
    ruled = durable(robots_decision(checked.where(F.col("_policy").isNull()), robots, user_agent, fail_open))
    denied = ruled.where(~F.col("robots_allowed")).withColumn("reason", F.col("robots_reason"))
    interval = (F.greatest(F.lit(min_interval), F.col("crawl_delay")) * SECOND).cast("long")
    passing = ruled.where("robots_allowed").select(
        "request_id", "url", "domain", "t", "seq", "crawl_delay", F.lit("request").alias("kind"), interval.alias("interval_us"),
        F.lit(None).cast("long").alias("cooldown_us"),
    )
    events = passing
    if responses is not None:
        events = passing.unionByName(
            responses.select("domain", "t", "seq", F.lit("response").alias("kind"), "cooldown_us"), allowMissingColumns=True
        )
    decided = access_ledger(events, max_requests, window_seconds)
    columns = ["request_id", "url", "domain", "t", "reason"]
    out = decided.select(*columns, "crawl_delay", "waited_us", F.lit(True).alias("robots_checked"))
    nothing = {"crawl_delay": F.lit(0.0), "waited_us": F.lit(0).cast("long")}
    for part, was_checked in ((denied, True), (refused, False)):
        out = out.unionByName(part.select(*columns).withColumns({**nothing, "robots_checked": F.lit(was_checked)}))
    return out.withColumn("allowed", F.col("reason") == "allowed")


def until_first_denied(decisions: DataFrame) -> DataFrame:
    """Decisions of an action up to and including its first denial; first URL per site is paced.

    ``decisions``: action_id, pos, domain, allowed.  Both marks are aggregates, so an
    action with any number of URLs stays distributed.
    """
    stop = decisions.where(~F.col("allowed")).groupBy("action_id").agg(F.min("pos").alias("_stop"))
    first = decisions.groupBy("action_id", "domain").agg(F.min("pos").alias("_first"))
    df = decisions.join(stop, "action_id", "left").where(F.col("_stop").isNull() | (F.col("pos") <= F.col("_stop")))
    return df.join(first, ["action_id", "domain"]).withColumn("paced", F.col("pos") == F.col("_first")).drop("_stop", "_first")


def probe_eligibility(fetches: DataFrame, min_chars: int = 500) -> DataFrame:
    """Whether a probed page may join a benchmark, and why not.

    Columns: robots_allowed (null = unknown), status, content_length, body.
    """
    block = probe_block_kind("body")
    allowed, status = F.col("robots_allowed"), F.col("status")
    eligible = F.coalesce(allowed & (status == 200) & (F.col("content_length") >= min_chars) & block.isNull(), F.lit(False))
    reason = (
        F.when(~allowed, "robots_disallow").when(eligible, "eligible").when(allowed.isNull(), "robots_unknown")
        .when(status.isNull(), "request_error").otherwise(F.coalesce(block, F.concat(F.lit("http_"), status.cast("string"))))
    )
    return fetches.withColumns({"block_signal": block, "eligible": eligible, "reason": reason})

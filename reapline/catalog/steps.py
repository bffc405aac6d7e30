"""Step, journey, verdict and matching queries."""

from pyspark.sql import functions as F

from reapline.catalog.pages import page_snapshots
from reapline.catalog.quality import ITEMS_SQL, items
from reapline.catalog.registry import query, table
from reapline.operators import features, journeys, matching, progress, verdicts
from reapline.session import durable

STEP_SQL = """
k as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
ev as (select user_id as run_id, event_id as ord, event_type, value, k, 'https://s' || cast(k % 4 as varchar) || '.example/' || event_type as url from k)"""


def steps(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), "event_type", "value", k.alias("k"),
        F.concat(F.lit("https://s"), (k % 4).cast("string"), F.lit(".example/"), F.col("event_type")).alias("url"),
    )


@query(
    "journey_transitions",
    f"""with {STEP_SQL}, l as (select *, lag(url) over (partition by run_id order by ord) as before_url, lag(k % 4) over (partition by run_id order by ord) as before_site from ev)
    select run_id, ord, before_url, coalesce(before_url <> url, false) as url_changed, coalesce('s' || before_site || '.example', '') as before_domain,
      's' || k % 4 || '.example' as after_domain, coalesce(before_site <> k % 4, false) as domain_changed from l""",
)
def journey_transitions(spark, folder):
    df = journeys.journey_transitions(steps(spark, folder), block=1000)
    return df.select("run_id", "ord", "before_url", "url_changed", "before_domain", "after_domain", "domain_changed")


STREAK_SQL = """
l as (select *, lag(event_type) over (partition by run_id order by ord) is distinct from event_type as opens from ev),
i as (select *, sum(cast(opens as int)) over (partition by run_id order by ord) as island from l),
s as (select *, row_number() over (partition by run_id, island order by ord) as streak from i)"""


@query("error_streaks", f"with {STEP_SQL}, {STREAK_SQL} select run_id, ord, streak, streak >= 2 as is_stuck from s")
def error_streaks(spark, folder):
    df = journeys.error_streaks(steps(spark, folder).withColumnRenamed("event_type", "error"), block=1000)
    return df.select("run_id", "ord", "streak", "is_stuck")


@query(
    "stagnation",
    f"""with {STEP_SQL}, l as (select *, coalesce(lag(k) over w > 0 and k <= lag(k) over w, false) as stuck from ev window w as (partition by run_id order by ord)),
    i as (select *, sum(case when stuck then 0 else 1 end) over (partition by run_id order by ord) as island from l)
    select run_id, ord, case when stuck then count(*) filter (stuck) over (partition by run_id, island order by ord) else 0 end as stagnant_rounds from i""",
)
def stagnation(spark, folder):
    df = steps(spark, folder).withColumn("item_count", F.col("k"))
    return journeys.stagnation(df, block=1000).select("run_id", "ord", "stagnant_rounds")


@query(
    "loop_detection",
    """with t as (select conv_id as run_id, turn as ord, regexp_replace(text, '[^ -~]', '?', 'g') as a from conversations),
    l as (select *, lag(a) over w as p1, lag(a, 2) over w as p2 from t window w as (partition by run_id order by ord))
    select run_id, ord, coalesce(p1 is not null and p2 is not null and 1 - levenshtein(a, p1) / greatest(length(a), length(p1)) >= 0.2
      and 1 - levenshtein(a, p2) / greatest(length(a), length(p2)) >= 0.2, false) as is_loop from l""",
)
def loop_detection(spark, folder):
    c = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), F.regexp_replace("text", "[^ -~]", "?").alias("action")
    )
    return journeys.repeated_actions(c, n=2, threshold=0.2).select("run_id", "ord", "is_loop")


@query("duplicate_actions")
def duplicate_actions(spark, folder):
    """Steps whose whole text nearly equals that of the two before, by matching blocks; no SQL has these."""
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), F.col("text").alias("action"))
    return journeys.duplicate_actions(c).select("run_id", "ord", "is_loop")


@query(
    "recent_context",
    """with l as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3)
    select conv_id as run_id, left(string_agg(trim(text, chr(10) || ' '), ' | ' order by turn), 2000) as context from l group by 1""",
)
def recent_context(spark, folder):
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), "text")
    return journeys.recent_context(c)


@query(
    "action_chain",
    f"""with {STEP_SQL}, c as (select run_id, ord, case when event_type = 'error' and value > 100 then '模拟中断并恢复' when event_type = 'click' then '翻到下一页' when event_type = 'view' then '打开目标'
      when event_type = 'purchase' then 'buy' end as label from ev)
    select run_id, ord, label, row_number() over (partition by run_id order by ord) as step from c where label is not null""",
)
def action_chain(spark, folder):
    kind = F.col("event_type")
    df = steps(spark, folder).select(
        "run_id", "ord", F.when((kind == "error") & (F.col("value") > 100), journeys.RESTART_NODE).when(kind == "error", "Planner").otherwise("Coder").alias("node"),
        F.when(kind == "click", "click").when(kind == "view", "open").when(kind == "purchase", "buy").alias("skill"),
    )
    return journeys.action_chain(df, block=1000)


@query(
    "premature_finishes",
    f"""with {STEP_SQL}, r as (select c_custkey as run_id, case c_custkey % 4 when 0 then 'scrape the list' when 1 then 'follow the outbound link' when 2 then '提取榜单' else 'look around' end as task,
      c_custkey % 3 > 0 as finished, c_custkey % 10 = 0 as safe_stop from customer),
    m as (select run_id, bool_or(domain_changed) as moved from (select run_id, k % 4 <> lag(k % 4) over (partition by run_id order by ord) as domain_changed from ev) group by 1),
    d as (select run_id, bool_or(event_type = 'purchase' and value > 60) as done from ev group by 1)
    select run_id, case when task = 'follow the outbound link' and not coalesce(moved, false) then 'no_cross_domain_transition'
      when task in ('scrape the list', '提取榜单') and not coalesce(done, false) then 'no_data_collected' end as reason
    from r left join m using (run_id) left join d using (run_id) where finished and not safe_stop and
     ((task = 'follow the outbound link' and not coalesce(moved, false)) or (task in ('scrape the list', '提取榜单') and not coalesce(done, false)))""",
)
def premature_finishes(spark, folder):
    key = F.col("c_custkey")
    task = F.when(key % 4 == 0, "scrape the list").when(key % 4 == 1, "follow the outbound link").when(key % 4 == 2, "提取榜单").otherwise("look around")
    runs = table(spark, folder, "customer").select(key.alias("run_id"), task.alias("task"), (key % 3 > 0).alias("finished"), (key % 10 == 0).alias("safe_stop"))
    s = steps(spark, folder)
    moved = journeys.journey_transitions(s, block=1000).select("run_id", "domain_changed")
    said = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), "records saved").otherwise("clicked")
    return journeys.premature_finishes(runs, moved, s.select("run_id", said.alias("text"))).select("run_id", "reason")


@query(
    "evaluate_journeys",
    f"""with {STEP_SQL}, p as (select *, last_value(case when event_type = 'view' then case when value > 90 then 'Place  order now' else 'list' end end ignore nulls) over (partition by run_id order by ord) as target from ev),
    r as (select run_id, run_id % 10 as c, count(*) filter (event_type <> 'error') as acts, bool_or(event_type = 'signup' and value > 120) as safe,
      arg_max(case when value > 60 then 'captcha' else 'timeout' end, ord) filter (event_type = 'error') as blocker,
      bool_or(event_type = 'click' and target = 'Place  order now') as unsafe, bool_or(event_type = 'signup' and k % 2 = 0) as typed,
      count(*) as urls, count(distinct k % 4) as sites, bool_or(k % 4 = 0) as entry, bool_or(k % 4 = 3) as target_site, bool_or(event_type = 'purchase' and k % 4 = 3) as terminal, arg_max(url, ord) as final_url
      from p group by 1, 2),
    b as (select *, coalesce(c < 5 and blocker = 'captcha', false) as blocked from r),
    k2 as (select *, [entry, target_site or blocked, sites >= 2 or blocked, acts >= 60 or blocked, typed or blocked, (case when c % 2 = 0 then terminal else target_site end) or safe or blocked,
      not coalesce(unsafe, false), run_id % 3 = 0 or blocked] || case when c = 7 then [(case when c % 2 = 0 then terminal else target_site end) or safe or blocked] else [] end as checks from b)
    select run_id, round(len(list_filter(checks, lambda x: x)) * 100.0::double / len(checks), 1) as accuracy_score, len(list_filter(checks, lambda x: x)) = len(checks) as passed,
      sites as domain_count, urls as url_count, acts as successful_action_count, coalesce(safe, false) as safe_stop, coalesce(blocker, '') as blocker,
      case when unsafe then 'place order' else '' end as unsafe_click, final_url from k2""",
)
def evaluate_journeys(spark, folder):
    kind, value, none = F.col("event_type"), F.col("value"), F.lit(None).cast("string")
    s = steps(spark, folder)
    events = s.select(
        "run_id", "ord", F.col("url").alias("current_url"), none.alias("page_url"), (kind != "error").alias("result_ok"), F.lit("act").alias("result_action"),
        F.when((kind == "error") & (value > 60), "captcha").alias("signal_kind"), none.alias("policy_kind"), F.lit("").alias("policy_reason"),
        F.when(kind == "error", "timeout").alias("error_code"),
        F.when(kind == "view", F.when(value > 90, "Place  order now").otherwise("list")).alias("plan_target"),
        ((kind == "signup") & (value > 120)).alias("safe_stop"), none.alias("blocker_kind"),
        F.when(kind == "click", "Click").when(kind == "signup", "type").alias("skill"), F.when(F.col("k") % 2 == 0, "words").otherwise(" ").alias("typed_text"),
    )
    run, case = F.col("run_id"), F.col("c")
    ids = s.select("run_id").distinct()
    name = lambda c: F.concat(F.lit("case-"), c.cast("string"))
    runs = ids.select("run_id", name(run % 10).alias("case_key"), F.when(run % 3 == 0, "completed").otherwise("stopped").alias("status"))
    cases = ids.select((run % 10).alias("c")).distinct().select(
        name(case).alias("case_key"), F.lit("https://s0.example/start").alias("url"), F.array(F.lit("^s3\\.")).alias("target_domain_patterns"),
        F.when(case % 2 == 0, F.array(F.lit("S3.*/purchase$"))).otherwise(F.array().cast("array<string>")).alias("terminal_url_patterns"),
        F.when(case < 5, F.array(F.lit("captcha"))).otherwise(F.array().cast("array<string>")).alias("allowed_blockers"),
        F.lit(True).alias("require_cross_domain"), F.lit(True).alias("require_text_input"), F.lit(60).alias("min_successful_actions"),
        (case == 7).alias("safe_stop_required"),
    )
    return journeys.evaluate_journeys(events, runs, cases, block=1000).drop("checks", "case_key")


VERDICT_SQL = """
a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' as ok,
  case l_linenumber when 1 then 'open' when 2 then 'click' when 3 then 'scroll' when 4 then 'type' when 5 then 'snapshot' when 6 then 'extract' else 'wait' end as skill,
  case when l_partkey % 3 = 0 then 'https://a.example/p' else '' end as want, case when l_suppkey % 2 = 0 then 'https://a.example/p/1' else 'https://b.example/' end as after_url,
  l_suppkey % 2 = 0 as changed, l_partkey % 5 = 0 as contract, l_quantity, l_discount from lineitem)"""


@query(
    "action_verdicts",
    f"""with {VERDICT_SQL}, v as (select *, case when not ok then null when skill = 'snapshot' then 'observation'
      when skill = 'extract' then case when l_discount > 0.07 then 'data_quality' when l_discount > 0.03 then 'schema_match' end
      when skill in ('open', 'click') and want <> '' then case when changed then 'url_match' end when skill = 'open' then null
      when skill = 'click' then case when contract then 'task_contract' when changed then 'page_url_change' end
      when skill = 'scroll' and contract then case when l_quantity > 45 then 'scroll_evidence_missing' when l_quantity > 20 then 'scroll_metrics' else 'scroll_no_effect' end
      when skill in ('scroll', 'wait') then case when contract then 'task_contract' else 'page_passive' end
      when skill = 'type' then case when contract then 'task_contract' when l_discount >= 0.05 then 'target_confidence' end end as decision from a)
    select skill, decision, decision not in ('data_quality', 'scroll_evidence_missing', 'scroll_no_effect') as is_success, count(*) as actions from v group by all""",
)
def action_verdicts(spark, folder):
    line, quantity, discount = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount")
    names = ["open", "click", "scroll", "type", "snapshot", "extract"]
    skill = F.lit("wait")
    for i, n in reversed(list(enumerate(names, 1))):
        skill = F.when(line == i, n).otherwise(skill)
    even = F.col("l_suppkey") % 2 == 0
    df = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") != "R").alias("ok"), skill.alias("skill"),
        F.when(F.col("l_partkey") % 3 == 0, "https://a.example/p").otherwise("").alias("expected_url"),
        F.when(even, "https://a.example/p/1").otherwise("https://b.example/").alias("after_url"), even.alias("url_changed"),
        (F.col("l_partkey") % 5 == 0).alias("is_contract_action"), F.when(quantity <= 45, F.lit(0.0)).alias("before_x"), F.lit(0.0).alias("before_y"),
        F.when(quantity > 20, F.lit(300.0)).otherwise(0.0).alias("after_x"), F.lit(0.0).alias("after_y"),
        F.when(discount >= 0.05, 0.85).otherwise(0.6).alias("target_confidence"), F.lit("selected").alias("target_status"),
        F.when(discount > 0.07, "data_quality").when(discount > 0.03, "schema_match").alias("data_decision"),
        F.when(discount > 0.07, False).when(discount > 0.03, True).alias("data_success"),
    )
    return verdicts.action_verdicts(df).groupBy("skill", "decision", "is_success").agg(F.count(F.lit(1)).alias("actions"))


@query(
    "review_flags",
    """with o as (select *, o_orderkey % 8 as w from orders)
    select array_to_string(list_filter([case when w = 0 then 'high_risk_action:eval' end, case when w = 1 then 'high_risk_url_scheme' end, case when w = 2 then 'large_detail_batch_without_limit' end,
      case when w = 3 then 'high_risk_code:system_command_exec' end, case when o_custkey % 5 >= 2 then 'step_failures:' || (o_custkey % 5) end, case when w = 4 then 'irreversible_code:irreversible_click' end,
      case when o_orderstatus <> 'P' and w = 5 then 'low_confidence' end, case when o_orderstatus = 'F' and w = 6 then 'success_but_fatal_log' end,
      case when o_orderstatus = 'O' and w = 7 then 'failure_but_success_log' end], lambda x: x is not null), ',') as reasons, count(*) as runs from o group by 1""",
)
def review_flags(spark, folder):
    w, none = F.col("o_orderkey") % 8, F.lit("")
    df = table(spark, folder, "orders").select(
        F.when(w < 3, "browser_action").otherwise("python_code").alias("execution_mode"),
        F.when(w == 0, "eval").when(w == 1, "open").when(w == 2, "batch-detail-extract").alias("skill"),
        F.when(w == 1, "ftp://host/x").otherwise(none).alias("url"), F.when(w == 2, 101).alias("batch_size"), F.lit(0).alias("batch_limit"),
        F.when(w == 3, "os.system('ls')").when(w == 4, "page.click('confirm order')").otherwise(none).alias("code"),
        (F.col("o_custkey") % 5).alias("step_fail_count"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("is_success"),
        F.when(w == 5, "Maybe it worked").otherwise("sure").alias("summary"), none.alias("message"),
        F.when(w == 6, "Traceback (most recent call)").when(w == 7, "all records saved").otherwise("step").alias("log"),
    )
    return verdicts.review_flags(df).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("runs"))


@query(
    "finalize_results",
    f"""with {STEP_SQL}, r as (select *, case k % 5 when 0 then 'click' when 1 then 'type' else 'extract' end as skill, case when k % 17 = 0 then 429 else 200 end as st,
      event_type <> 'error' as was_ok, event_type = 'view' and value > 80 as captcha from ev),
    f as (select *, was_ok and skill in ('click', 'type') and k % 4 = 2 as denied from r)
    select case when denied then 'site_policy_denied' when (was_ok and st = 429) or captcha then 'site_blocked' when not was_ok then 'failed' end as error_code,
      case when denied then 'robots_denied' when was_ok and st = 429 then 'rate_limit' when captcha then 'captcha' end as block_kind,
      was_ok and not denied and not (st = 429 or captcha) as ok, count(*) as results from f group by all""",
)
def finalize_results(spark, folder):
    s = steps(spark, folder)
    k, kind = F.col("k"), F.col("event_type")
    results = s.select(
        F.col("ord").alias("result_id"), (kind != "error").alias("ok"), F.when(k % 5 == 0, "click").when(k % 5 == 1, "type").otherwise("extract").alias("skill"),
        F.col("url").alias("final_url"), F.when(k % 17 == 0, 429).otherwise(200).alias("status_code"),
        F.when((kind == "view") & (F.col("value") > 80), "Please solve the CAPTCHA").otherwise("page").alias("body"), F.when(kind == "error", "failed").alias("error_code"),
    )
    decisions = s.select("url", (k % 4 != 2).alias("allowed"), F.lit("robots_denied").alias("reason")).distinct()
    out = verdicts.finalize_results(results, decisions)
    return out.groupBy("error_code", "block_kind", "ok").agg(F.count(F.lit(1)).alias("results"))


@query(
    "invalid_actions",
    f"""with {STEP_SQL}, a as (select *, case event_type when 'click' then 'click' when 'view' then 'expand' when 'signup' then 'type' when 'error' then '' else 'list-items' end as skill,
      case k % 6 when 0 then '' when 1 then 'g_list_1' else 'e' || k % 6 end as ref, case when k % 9 = 0 then 'css:a' else '' end as locator, k % 2 = 0 as required,
      case when k % 4 = 0 then 'selected' when k % 4 = 1 then 'not_found' end as status, 'e4' as expected from ev)
    select case when skill = '' then 'missing_skill' when ref = '' and locator = '' then 'missing_target_parameter' when starts_with(ref, 'g_') then 'virtual_group_ref'
      when skill = 'click' and locator <> '' then 'free_form_locator' when skill in ('click', 'type') and required and coalesce(status <> 'selected', true) then 'target_not_selected'
      when skill in ('click', 'type') and required and ref = '' then 'target_ref_missing' when skill in ('click', 'type') and required and ref <> expected then 'target_ref_mismatch' end as reason,
      count(*) as actions from a group by 1""",
)
def invalid_actions(spark, folder):
    s, k, kind = steps(spark, folder), F.col("k"), F.col("event_type")
    skill = F.when(kind == "click", "Click").when(kind == "view", "expand").when(kind == "signup", "type").when(kind == "error", " ").otherwise("list-items")
    ref = F.when(k % 6 == 0, "").when(k % 6 == 1, "g_list_1").otherwise(F.concat(F.lit("e"), (k % 6).cast("string")))
    actions = s.select(
        "run_id", F.col("ord").alias("step"), skill.alias("skill"),
        F.create_map(F.lit("ref"), ref, F.lit("locator"), F.when(k % 9 == 0, "css:a").otherwise("")).alias("params"), F.lit(True).alias("has_refs"),
        (k % 2 == 0).alias("target_required"),
    )
    chosen = s.where("k % 4 < 2").select(
        "run_id", F.col("ord").alias("step"), F.when(k % 4 == 0, "selected").otherwise("not_found").alias("status"), F.lit("e4").alias("target_ref")
    )
    return verdicts.invalid_actions(actions, chosen).groupBy("reason").agg(F.count(F.lit(1)).alias("actions"))


@query("match_elements")
def match_elements(spark, folder):
    nodes = durable(page_snapshots(spark, folder))
    requests = nodes.where("tag = 'a'").groupBy("snapshot_id").agg(F.min_by("text", "ord").alias("target_hint")).select(
        F.col("snapshot_id").alias("request_id"), "snapshot_id", F.lit("click").alias("intent"), "target_hint", F.array(F.lit("link")).alias("roles"),
        F.lit(None).cast("array<string>").alias("texts"), F.lit("").alias("region_hint"), F.lit("").alias("near"), F.array(F.lit("no such text")).alias("exclude"),
    )
    return matching.match_elements(nodes, requests)


def controls(spark, folder):
    lines = table(spark, folder, "lineitem")
    place = (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ord")
    return lines.select(
        F.col("l_orderkey").alias("snapshot_id"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("ref"),
        F.when(F.col("l_linenumber") == 7, "Next").otherwise(F.col("l_linenumber").cast("string")).alias("label"),
        F.when(F.col("l_linenumber") == 7, "next").otherwise("page_number").alias("direction"), (F.col("l_returnflag") != "R").alias("enabled"), place,
    )


@query(
    "match_pagination",
    """with c as (select l_orderkey as s, 'e' || l_partkey as ref, case when l_linenumber = 7 then 'next' else cast(l_linenumber as varchar) end as label from lineitem where l_returnflag <> 'R'),
    q as (select o_orderkey as s, case when o_orderkey % 2 = 0 then 'next' else cast(o_orderkey % 6 + 1 as varchar) end as want from orders)
    select s as request_id, min(ref) as target_ref from q join c using (s) where want = label group by s having count(distinct ref) = 1""",
)
def match_pagination(spark, folder):
    key = F.col("o_orderkey")
    requests = table(spark, folder, "orders").select(
        key.alias("request_id"), key.alias("snapshot_id"), F.lit("click").alias("intent"),
        F.when(key % 2 == 0, "go to next").otherwise(F.concat(F.lit("page "), (key % 6 + 1).cast("string"))).alias("target_hint"), F.lit("pagination").alias("region_hint"),
        F.lit(None).cast("array<string>").alias("texts"),
    )
    return matching.match_pagination(controls(spark, folder), requests)


@query(
    "next_page_ref",
    """with c as (select l_orderkey as s, 'e' || l_partkey as ref, l_linenumber as n, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey as ord from lineitem where l_returnflag <> 'R'),
    p as (select s, arg_min(ref, ord) filter (n <> 7 and n = s % 6 + 1) as a, arg_max(ref, ord) filter (n = 7) as b from c group by s)
    select o_orderkey as run_id, coalesce(a, b) as target_ref from orders left join p on s = o_orderkey""",
)
def next_page_ref(spark, folder):
    key = F.col("o_orderkey")
    runs = table(spark, folder, "orders").select(key.alias("run_id"), key.alias("snapshot_id"), (key % 6 + 1).alias("page_number"))
    return matching.next_page_ref(controls(spark, folder), runs).select("run_id", "target_ref")


REGION_SQL = """
reg as (select p_size as run_id, 'r' || p_partkey as ref, p_partkey as ord, case p_partkey % 4 when 0 then 'nav' when 1 then 'table' else 'div' end as tag,
  case p_type when 'ECONOMY' then 'list' when 'STANDARD' then 'table' when 'SMALL' then 'card_grid' else 'text' end as kind, p_name as name, p_partkey % 90 as items,
  cast(floor(p_retailprice) as int) as src, p_partkey % 6 <> 0 as ok, cast(cast(p_retailprice as decimal(12,2)) as varchar) as sample, p_partkey % 11 = 0 as failed from part)"""


def regions(spark, folder):
    key, kind = F.col("p_partkey"), F.col("p_type")
    return table(spark, folder, "part").select(
        F.col("p_size").alias("run_id"), F.concat(F.lit("r"), key.cast("string")).alias("ref"), key.alias("ord"),
        F.when(key % 4 == 0, "nav").when(key % 4 == 1, "table").otherwise("div").alias("tag"), F.lit("").alias("role"),
        F.when(kind == "ECONOMY", "list").when(kind == "STANDARD", "table").when(kind == "SMALL", "card_grid").otherwise("text").alias("kind"),
        F.col("p_name").alias("name"), F.lit("").alias("why"), F.array(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("samples"),
        F.when(key % 6 != 0, F.array(F.lit("expand"), F.lit("extract"))).otherwise(F.array(F.lit("expand"))).alias("available_actions"),
        F.col("p_retailprice").cast("int").alias("source_score"), (key % 90).cast("int").alias("item_count"), (key % 11 == 0).alias("failed"),
    )


@query(
    "rank_regions",
    f"""with {REGION_SQL}, s as (select *, case when ok then src + case when tag = 'nav' then -1500 else 0 end
      + case when run_id % 3 = 0 then case when kind = 'table' or tag = 'table' then 1800 else -800 end else 0 end
      + case when run_id % 3 = 1 then case when kind in ('card_grid', 'list') then 750 else 0 end + 250 else 0 end
      + case when run_id % 3 = 2 then case when kind in ('list', 'card_grid') then 500 else 120 end else 0 end
      + case when items >= 20 then 220 else 0 end - least(abs(items - 20), 100) else -10000 end as score from reg where not failed)
    select run_id, ref, cast(score as int) as region_score from s where score > 0 qualify row_number() over (partition by run_id order by score desc, ord) = 1""",
)
def rank_regions(spark, folder):
    df = regions(spark, folder)
    run = F.col("run_id")
    schema = F.when(run % 3 == 0, F.array(F.lit("team"), F.lit("year"))).when(run % 3 == 1, F.array(F.lit("price"))).otherwise(F.array(F.lit("title"), F.lit("url")))
    contracts = df.select("run_id").distinct().select("run_id", schema.alias("schema"), F.lit(20).alias("required_count"))
    found = matching.rank_regions(df.drop("failed"), contracts, df.where("failed"))
    return found.select("run_id", "ref", F.col("region_score").cast("int").alias("region_score"))


@query(
    "rank_regions_by_hint",
    f"""with {REGION_SQL}, s as (select run_id, ref, ord, src, case when ok then 50 else 0 end + case when kind = 'list' then 15 else 0 end + case when contains(lower(ref || ' ' || name || ' ' || kind || ' ' || sample), 'red widget') then 30
      when contains(lower(ref || ' ' || name || ' ' || kind || ' ' || sample), 'red') or contains(lower(ref || ' ' || name || ' ' || kind || ' ' || sample), 'widget') then 10 else 0 end
      + least(items, 50) + least(src // 20, 30) as score, kind || '|' || name || '|' || items || '|' || sample as sig from reg),
    n as (select *, row_number() over (partition by run_id order by score desc, ord) as n from s),
    p as (select run_id, max(ref) filter (n = 1) as ref, max(score) filter (n = 1) as s1, max(score) filter (n = 2) as s2, max(sig) filter (n = 1) as g1, max(sig) filter (n = 2) as g2,
      max(src) filter (n = 1) as c1, max(src) filter (n = 2) as c2 from n where n <= 2 group by run_id)
    select run_id, case when not (coalesce(s1 - s2 < 15, false) and not coalesce(g1 = g2 and c1 > c2, false)) then ref end as ref, cast(s1 as int) as hint_score,
      coalesce(s1 - s2 < 15, false) and not coalesce(g1 = g2 and c1 > c2, false) as is_ambiguous from p""",
)
def rank_regions_by_hint(spark, folder):
    df = regions(spark, folder).drop("failed")
    requests = df.select("run_id").distinct().select(
        "run_id", F.lit("extract").alias("intent"), F.lit("Red Widget").alias("target_hint"), F.lit("").alias("region_hint"), F.lit(None).cast("array<string>").alias("texts"),
        F.lit("list").alias("want_kind"), F.lit(None).cast("int").alias("want_count"),
    )
    adjusted = df.withColumn("available_actions", F.when(F.array_contains("available_actions", "extract"), F.array(F.lit("extract"))).otherwise(F.array().cast("array<string>")))
    found = matching.rank_regions_by_hint(adjusted, requests)
    return found.withColumn("hint_score", F.col("hint_score").cast("int"))


@query(
    "rank_filter_inputs",
    """with i as (select p_size as run_id, 'e' || p_partkey as ref, p_partkey as ord, p_partkey % 9 = 0 as search, lower(p_name) as name, p_partkey % 2 = 0 as box, p_partkey % 3 = 0 as typed from part),
    s as (select *, case when search then 100 else 80 end + case when contains(name, 'ring') then 30 else 0 end + case when not search and box then 20 else 0 end as score from i where search or box or typed)
    select run_id, ref, score as input_score from s qualify row_number() over (partition by run_id order by score desc, ord) = 1""",
)
def rank_filter_inputs(spark, folder):
    key = F.col("p_partkey")
    inputs_df = table(spark, folder, "part").select(
        F.col("p_size").alias("run_id"), F.concat(F.lit("e"), key.cast("string")).alias("ref"), F.when(key % 9 == 0, "search").otherwise("form").alias("source"),
        F.col("p_name").alias("name"), F.when(key % 2 == 0, "searchbox").otherwise("").alias("role"), F.when(key % 3 == 0, "text").otherwise("number").alias("input_type"),
        key.alias("ord"),
    )
    filters = inputs_df.select("run_id").distinct().withColumn("field_hint", F.lit("Ring"))
    return matching.rank_filter_inputs(inputs_df, filters).select("run_id", "ref", "input_score")


@query(
    "anchor_match",
    f"""with {ITEMS_SQL} select run_id, run_id % 4 = 0 or bool_or(contains(lower(title), 'part 99')) as anchor_match from items group by run_id""",
)
def anchor_match(spark, folder):
    df = items(spark, folder)
    anchors = df.select("run_id").distinct().withColumn(
        "anchor_values", F.when(F.col("run_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Part 99"), F.lit("zzz")))
    )
    return matching.anchor_match(df, anchors)


@query(
    "progress_summary",
    f"""with {ITEMS_SQL}, e as (select l_suppkey % 40 as run_id, l_orderkey as ord, l_linenumber as n, case when l_linenumber = 1 then 'open' when l_linenumber = 7 and l_orderkey < 900 then 'filter' when l_linenumber < 6 then 'collect' else 'scroll' end as kind from lineitem),
    lf as (select run_id, max(ord) as last_at from e where kind = 'filter' group by 1),
    d as (select e.run_id, count(distinct n) filter (kind = 'collect' and ord > last_at) as pages, count(distinct n) filter (kind = 'filter') as filters, max(n) filter (kind = 'scroll') as scrolls from e left join lf using (run_id) group by 1),
    j as (select run_id, count(*) as n, avg(cast(title is not null as int)) >= 0.8 and avg(cast(title_ok as int)) >= 0.8 as good from judged group by 1),
    m as (select run_id, bool_or(contains(lower(title), 'part 777')) as met from items group by 1),
    f as (select run_id, n, pages, coalesce(met and run_id % 2 = 0, false) as met, n >= 350 and good as ok, pages >= 4 as pages_ok, filters >= 1 as f_ok, coalesce(scrolls >= 6 + run_id % 3, false) as s_ok
      from j join d using (run_id) join m using (run_id))
    select run_id, n as item_count, pages as completed_pages, (ok or met) and (met or pages_ok) as list_complete, met as stop_condition_met,
      case when met then 'until_text:Part 777' when ok and pages_ok then 'contract_satisfied' else '' end as stop_reason,
      concat_ws(',', case when not f_ok then 'filters' end, case when not pages_ok then 'pagination' end, case when not s_ok then 'scroll' end) as unmet,
      (ok or met) and (met or pages_ok) and f_ok and pages_ok and s_ok as is_done from f""",
)
def progress_summary(spark, folder):
    df = items(spark, folder)
    line, run = F.col("l_linenumber"), F.col("run_id")
    kind = F.when(line == 1, "open").when((line == 7) & (F.col("l_orderkey") < 900), "filter").when(line < 6, "collect").otherwise("scroll")
    events = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("run_id"), F.col("l_orderkey").alias("ord"), kind.alias("kind"), line.alias("number")
    )
    contracts = df.select("run_id").distinct().select(
        "run_id", F.array(F.lit("title")).alias("schema"), F.lit(350).alias("min_items"), F.lit(4).alias("target_pages"),
        F.when(run % 2 == 0, "Part 777").otherwise("").alias("until_text"), F.lit(1).alias("filters"), (6 + run % 3).alias("scroll_rounds"),
        F.lit(False).alias("details"), F.lit(True).alias("open_target"),
    )
    return progress.progress_summary(events, df, contracts).withColumn("unmet", F.array_join("unmet", ","))


@query("page_groups")
def page_groups(spark, folder):
    nodes = page_snapshots(spark, folder)
    data = nodes.where("tag = 'ul'").select(
        "snapshot_id", "ref", "ord", F.lit("list").alias("kind"), F.lit(6).alias("item_count")
    )
    return features.page_groups(nodes, data).groupBy("kind").agg(F.count(F.lit(1)).alias("groups"))

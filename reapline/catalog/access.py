"""Access queries: events as requests of a user's site, errors as refusals."""

from pyspark.sql import functions as F

from reapline.catalog.registry import query, table
from reapline.functions import url
from reapline.operators import access
from reapline.plans.blocked import micros

ROBOTS_BODY = "User-agent: *\nDisallow: /en/1\nAllow: /fr\nDisallow: /fr\nCrawl-delay: 2\n\nUser-agent: reaper\nDisallow: /private\n"


def events(spark, folder):
    return events_of(table(spark, folder, "events"))


def events_of(source):
    refused = F.col("event_type") == "error"
    return source.select(
        F.col("user_id").alias("domain"), micros("ts").alias("t"), F.col("event_id").alias("seq"),
        F.when(refused, "response").otherwise("request").alias("kind"),
        F.when(~refused, F.lit(600_000_000) + F.floor(F.col("value")) * 1_000_000).cast("long").alias("interval_us"),
        F.when(refused & (F.col("value") > 30), F.floor(F.col("value")) * 60_000_000).cast("long").alias("cooldown_us"),
    )


EVENTS_SQL = """
ev as (select user_id as d, epoch_us(ts) as t, event_id as seq, event_type = 'error' as refused, cast(floor(value) as bigint) as v, value from events)"""


@query(
    "pacing",
    f"""with {EVENTS_SQL}, r as (select *, sum(600000000 + v * 1000000) over w as dd from ev where not refused window w as (partition by d order by t, seq)),
    s as (select *, dd + max(t - dd) over (partition by d order by t, seq) as scheduled from r)
    select d as domain, seq, cast(scheduled as bigint) as scheduled, cast(scheduled - t as bigint) as waited_us from s""",
)
def pacing(spark, folder):
    df = access.request_schedule(events(spark, folder).where("kind = 'request'"))
    return df.select("domain", "seq", "scheduled", "waited_us")


LEDGER_SQL = f"""recursive {EVENTS_SQL},
c as (select *, max(case when refused and value > 30 then t + v * 60000000 end) over (partition by d order by t, seq) as until from ev),
ok as (select * from c where not refused and not coalesce(t < until, false)),
w as (
  select d, min(t) as a from ev where not refused or value > 30 group by d
  union all
  select w.d, (select min(ok.t) from ok where ok.d = w.d and ok.t >= w.a + 86400000000) as a from w where w.a is not null
),
placed as (select ok.*, (select max(a) from w where w.d = ok.d and w.a <= ok.t) as started from ok),
ranked as (select *, row_number() over (partition by d, started order by t, seq) as n from placed),
allowed as (select *, sum(600000000 + v * 1000000) over (partition by d order by t, seq) as dd from ranked where n <= 2),
sched as (select *, dd + max(t - dd) over (partition by d order by t, seq) - t as waited from allowed)"""


@query(
    "access_ledger",
    f"""with {LEDGER_SQL}
    select d as domain, seq, 'allowed' as reason, started as window_started, cast(waited as bigint) as waited_us from sched
    union all select d, seq, 'domain_request_budget_exhausted', started, 0 from ranked where n > 2
    union all select d, seq, 'domain_cooldown', null, 0 from c where not refused and coalesce(t < until, false)""",
)
def access_ledger(spark, folder):
    df = access.access_ledger(events(spark, folder), max_requests=2, window_seconds=86400)
    return df.select("domain", "seq", "reason", "window_started", "waited_us")


@query(
    "cooldowns",
    f"""with {EVENTS_SQL} select d as domain, seq, max(case when refused and value > 30 then t + v * 60000000 end) over (partition by d order by t, seq) as cooldown_until from ev""",
)
def cooldowns(spark, folder):
    return access.cooldowns(events(spark, folder)).select("domain", "seq", "cooldown_until")


HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':\\d*$', '')"
ROBOTS_SQL = f"""
p as (select *, {HOST} as host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from pages),
st as (select *, case length(host) % 5 when 0 then 404 when 1 then 503 else 200 end as status from p),
ruled as (select *, case when status = 404 then 'robots_missing' when status = 503 then 'robots_http_503'
  when starts_with(path, '/en/1') then 'robots_denied' else 'robots_allowed' end as robots_reason from st)"""


def robots(spark, folder):
    sites = table(spark, folder, "pages").select(url.origin("url").alias("origin"), F.length(url.host("url")).alias("n")).distinct()
    status = F.when(F.col("n") % 5 == 0, 404).when(F.col("n") % 5 == 1, 503).otherwise(200)
    return sites.select("origin", status.alias("status"), F.lit(ROBOTS_BODY).alias("body"))


@query(
    "robots_decision",
    f"""with {ROBOTS_SQL} select page_id, robots_reason, robots_reason in ('robots_allowed', 'robots_missing') as robots_allowed,
    case when status = 200 then 2.0::double else 0.0::double end as crawl_delay from ruled""",
)
def robots_decision(spark, folder):
    df = access.robots_decision(table(spark, folder, "pages"), robots(spark, folder), "Crawler/1.0", fail_open=False)
    return df.select("page_id", "robots_reason", "robots_allowed", "crawl_delay")


@query(
    "authorize",
    f"""with {ROBOTS_SQL}, dom as (select *, page_id * 100000000 as t, case when status = 200 then 2000000 else 500000 end as step from ruled
      where robots_reason in ('robots_allowed', 'robots_missing')),
    n as (select *, row_number() over (partition by host, t // 3600000000 order by t) as k from dom)
    select page_id as request_id, robots_reason as reason, false as allowed from ruled where robots_reason in ('robots_denied', 'robots_http_503')
    union all select page_id, 'allowed', true from dom""",
)
def authorize(spark, folder):
    requests = table(spark, folder, "pages").select(
        F.col("page_id").alias("request_id"), "url", (F.col("page_id") * 100_000_000).alias("t"), F.col("page_id").alias("seq")
    )
    df = access.authorize(requests, robots(spark, folder), None, "Crawler/1.0", fail_open=False)
    return df.select("request_id", "reason", "allowed")


@query(
    "until_first_denied",
    """with a as (select user_id as action_id, event_id as pos, event_type as domain, value < 60 as allowed from events),
    s as (select *, coalesce(sum(case when allowed then 0 else 1 end) over (partition by action_id order by pos rows between unbounded preceding and 1 preceding), 0) as before,
      row_number() over (partition by action_id, domain order by pos) = 1 as paced from a)
    select action_id, pos, allowed, paced from s where before = 0""",
)
def until_first_denied(spark, folder):
    df = table(spark, folder, "events").select(
        F.col("user_id").alias("action_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("domain"), (F.col("value") < 60).alias("allowed")
    )
    return access.until_first_denied(df).select("action_id", "pos", "allowed", "paced")


@query(
    "probe_eligibility",
    """with d as (select doc_id, case doc_id % 6 when 0 then null when 1 then false else true end as ra, case doc_id % 7 when 0 then 404 when 1 then null else 200 end as st, n_chars,
      case when regexp_matches(text, '(?i)验证码|安全验证|captcha|verify you are human') then 'captcha' when regexp_matches(text, '(?i)登录后.{0,12}(?:查看|继续|访问)|login required') then 'login_wall'
        when regexp_matches(text, '(?i)请求过于频繁|访问频繁|too many requests|rate limit') then 'rate_limit' when regexp_matches(text, '(?i)访问被拒绝|access denied|forbidden') then 'access_denied' end as b from documents)
    select case when ra = false then 'robots_disallow' when coalesce(ra and st = 200 and n_chars >= 500 and b is null, false) then 'eligible' when ra is null then 'robots_unknown'
      when st is null then 'request_error' else coalesce(b, 'http_' || st) end as reason, count(*) as pages from d group by 1""",
)
def probe_eligibility(spark, folder):
    n = F.col("doc_id")
    df = table(spark, folder, "documents").select(
        F.when(n % 6 == 0, F.lit(None).cast("boolean")).otherwise(n % 6 != 1).alias("robots_allowed"),
        F.when(n % 7 == 0, 404).when(n % 7 == 1, F.lit(None).cast("int")).otherwise(200).alias("status"),
        F.col("n_chars").alias("content_length"), F.col("text").alias("body"),
    )
    return access.probe_eligibility(df).groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))

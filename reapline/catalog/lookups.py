"""Lookups on pages (text, siblings, regions, group members), address rules, and written files read back."""

from pyspark.sql import functions as F

from reapline.catalog.registry import query, table
from reapline.functions.text import ellipsize, is_valid_thread_id, lenient_json, sanitize_locator, slug, verdict_fields
from reapline.functions.url import PRIVATE_IPV4, is_private_host, let, same_target, url_policy
from reapline.operators import features, snapshots
from reapline.session import spread
from reapline.sources import writers
from reapline.streaming.sinks import stream_folder

# Turns as nodes of a conversation's page; every conversation asks for the first word of
# its first turn, for four letters inside it, and for a word that only some turns hold.
TURNS_SQL = """
n as (select conv_id as snapshot_id, 'r' || cast(turn as varchar) as ref, turn as ord, coalesce(text, '') as text, 'p' || cast(turn % 2 as varchar) as parent_ref from conversations),
opening as (select conv_id, arg_min(coalesce(text, ''), turn) as t from conversations group by 1),
asked as (select conv_id * 3 as request_id, conv_id as snapshot_id, regexp_extract(t, '^[A-Za-z]+') as text, null as scope_parent from opening
  union all select conv_id * 3 + 1, conv_id, substr(t, 3, 4), null from opening union all select conv_id * 3 + 2, conv_id, 'The', 'p1' from opening)"""


def turn_nodes(spark, folder):
    c = table(spark, folder, "conversations")
    none = F.lit("")
    return c.select(
        F.col("conv_id").alias("snapshot_id"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("ref"), F.col("turn").alias("ord"),
        F.coalesce("text", none).alias("text"), F.concat(F.lit("p"), (F.col("turn") % 2).cast("string")).alias("parent_ref"),
        *[none.alias(n) for n in ("name", "placeholder", "label", "input_type", "value")],
    )


@query(
    "find_text",
    f"""with {TURNS_SQL}, tok as (select distinct snapshot_id, ref, ord, trim(lower(unnest(regexp_split_to_array(text, '\\s+'))), '.,;:!?"''()[]{{}}') as token from n),
    parts as (select request_id, snapshot_id, unnest(regexp_split_to_array(lower(text), '\\s+')) as token from asked),
    by_token as (select distinct request_id, snapshot_id, ref, ord, 'token' as match_kind from parts join tok using (snapshot_id, token) where length(token) >= 2),
    by_part as (select request_id, snapshot_id, ref, ord, 'substring' as match_kind from asked a join n using (snapshot_id)
      where length(trim(a.text, e' \\t\\n\\r')) >= 2 and contains(lower(n.text), lower(a.text)) and request_id not in (select request_id from by_token)),
    hits as (select h.* from (from by_token union all from by_part) h join asked using (request_id) join n on n.snapshot_id = h.snapshot_id and n.ref = h.ref
      where scope_parent is null or scope_parent = parent_ref)
    select request_id, snapshot_id, ref, match_kind, row_number() over (partition by request_id order by ord, ref) as hit_no from hits""",
)
def find_text(spark, folder):
    nodes = turn_nodes(spark, folder)
    first = nodes.groupBy("snapshot_id").agg(F.min_by("text", "ord").alias("t"))
    key, none = F.col("snapshot_id"), F.lit(None).cast("string")
    wanted = F.array(
        F.struct((key * 3).alias("request_id"), F.regexp_extract("t", "^[A-Za-z]+", 0).alias("text"), none.alias("scope_parent")),
        F.struct((key * 3 + 1).alias("request_id"), F.substring("t", 3, 4).alias("text"), none.alias("scope_parent")),
        F.struct((key * 3 + 2).alias("request_id"), F.lit("The").alias("text"), F.lit("p1").alias("scope_parent")),
    )
    requests = first.select("snapshot_id", F.inline(wanted))
    hits = snapshots.find_text(snapshots.text_index(nodes), nodes, requests)
    return hits.select("request_id", "snapshot_id", "ref", "match_kind", "hit_no")


# Events as nodes: a user is a page, an event type a region of it.
EVENT_NODES_SQL = """
n as (select user_id as snapshot_id, 'e' || cast(event_id as varchar) as ref, 'g-' || event_type as parent_ref, event_id as ord,
  case when event_id % 7 > 0 then '/b/' || event_type || '/' || cast(event_id as varchar) || '/' else '' end as xpath from events)"""


def event_nodes(spark, folder):
    e = table(spark, folder, "events")
    number = F.col("event_id").cast("string")
    xpath = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("/b/"), "event_type", F.lit("/"), number, F.lit("/"))).otherwise("")
    return e.select(
        F.col("user_id").alias("snapshot_id"), F.concat(F.lit("e"), number).alias("ref"), F.concat(F.lit("g-"), "event_type").alias("parent_ref"),
        F.col("event_id").alias("ord"), xpath.alias("xpath"),
    )


@query(
    "near_siblings",
    f"""with {EVENT_NODES_SQL} select a.ref as anchor, s.ref, s.ord, row_number() over (partition by a.ref order by s.ord, s.ref) as hit_no
    from n a join n s using (snapshot_id, parent_ref) where a.ord % 10 = 0""",
)
def near_siblings(spark, folder):
    nodes = event_nodes(spark, folder)
    anchors = nodes.where("ord % 10 = 0").select(F.col("ref").alias("request_id"), "snapshot_id", "ref")
    return snapshots.near(nodes, anchors).select(F.col("request_id").alias("anchor"), "ref", "ord", "hit_no")


@query(
    "region_match",
    f"""with {EVENT_NODES_SQL}, r as (select distinct snapshot_id, parent_ref as region_ref from n),
    p as (select snapshot_id, region_ref, ref as target_ref, parent_ref, xpath from r join n using (snapshot_id) union all select snapshot_id, ref, ref, ref, '' from n)
    select snapshot_id, region_ref, target_ref, case when xpath = '' then region_ref = target_ref else region_ref = parent_ref end as matches from p""",
)
def region_match(spark, folder):
    nodes = event_nodes(spark, folder)
    regions = nodes.select("snapshot_id", F.col("parent_ref").alias("ref")).distinct()
    paths = regions.withColumn("xpath", F.concat(F.lit("/b/"), F.expr("substr(ref, 3)")))
    pairs = regions.withColumnRenamed("ref", "region_ref").join(nodes.select("snapshot_id", F.col("ref").alias("target_ref")), "snapshot_id")
    own = nodes.select("snapshot_id", F.col("ref").alias("region_ref"), F.col("ref").alias("target_ref"))
    known = nodes.select("snapshot_id", "ref", "xpath").unionByName(paths)
    return snapshots.region_match(known, pairs.unionByName(own)).select("snapshot_id", "region_ref", "target_ref", "matches")


@query(
    "expand_group",
    f"""with {EVENT_NODES_SQL} select snapshot_id, parent_ref as group_id, ref, ord, row_number() over (partition by snapshot_id, parent_ref order by ord) - 1 as member_no from n
    where parent_ref <> 'g-error'""",
)
def expand_group(spark, folder):
    nodes = event_nodes(spark, folder)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda r: r["ref"])
    kind = F.when(F.col("parent_ref") != "g-error", "list").otherwise("alert")
    groups = nodes.groupBy("snapshot_id", "parent_ref").agg(refs.alias("refs")).withColumns({"kind": kind, "group_id": F.col("parent_ref")})
    return snapshots.expand_group(groups.drop("parent_ref"), nodes, kind="list").select("snapshot_id", "group_id", "ref", "ord", "member_no")


# Addresses made from lines; a third of them begin like private networks.
HOSTS_SQL = """
o as (select *, case when l_partkey % 3 = 0 then [10, 127, 172, 192, 169, 198, 203, 0][l_suppkey % 8 + 1] else l_partkey % 256 end as a,
  case when l_partkey % 3 = 0 then [16, 168, 254, 18, 51, 0][l_orderkey % 6 + 1] else l_orderkey % 256 end as b, (l_orderkey // 256) % 256 as c, l_suppkey % 256 as d from lineitem),
h as (select *, a || '.' || b || '.' || c || '.' || d as host, ((a * 256 + b) * 256 + c) * 256 + d as number from o),
u as (select *, case l_linenumber when 1 then 'http://' || host || '/x' when 2 then 'https://user:pw@' || host || '/' when 3 then 'ftp://' || host
  when 4 then ' http://LOCALHOST.:8080/a ' when 5 then 'https://example.org/p?q' else 'http://' || host || ':8080' end as url from h)"""


def _blocks_sql():
    number = lambda dotted: sum(int(x) << (24 - 8 * i) for i, x in enumerate(dotted.split(".")))
    return " or ".join(f"number between {number(a)} and {number(b)}" for a, b in PRIVATE_IPV4)


@query(
    "url_policy",
    f"""with {HOSTS_SQL} select host, url, {_blocks_sql()} as is_private, case when l_linenumber = 3 then 'http_https_required' when l_linenumber = 2 then 'embedded_credentials'
      when l_linenumber = 4 or (l_linenumber <> 5 and ({_blocks_sql()})) then 'private_network_denied' end as denied,
      case l_linenumber when 3 then 'http_https_required' when 2 then 'embedded_credentials' end as denied_inside, count(*) as n from u group by all""",
)
def url_rules(spark, folder):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    third = F.col("l_partkey") % 3 == 0
    parts = (
        F.when(third, pick((10, 127, 172, 192, 169, 198, 203, 0), F.col("l_suppkey") % 8)).otherwise(F.col("l_partkey") % 256),
        F.when(third, pick((16, 168, 254, 18, 51, 0), F.col("l_orderkey") % 6)).otherwise(F.col("l_orderkey") % 256),
        F.expr("(l_orderkey div 256) % 256"), F.col("l_suppkey") % 256,
    )
    df = table(spark, folder, "lineitem").select("l_linenumber", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("host"))
    n, h = F.col("l_linenumber"), F.col("host")
    url = (
        F.when(n == 1, F.concat(F.lit("http://"), h, F.lit("/x"))).when(n == 2, F.concat(F.lit("https://user:pw@"), h, F.lit("/")))
        .when(n == 3, F.concat(F.lit("ftp://"), h)).when(n == 4, " http://LOCALHOST.:8080/a ").when(n == 5, "https://example.org/p?q")
        .otherwise(F.concat(F.lit("http://"), h, F.lit(":8080")))
    )
    made = df.groupBy("host", url.alias("url")).agg(F.count(F.lit(1)).alias("n"))
    return made.select(
        "host", "url", is_private_host("host").alias("is_private"), url_policy("url").alias("denied"), url_policy("url", True).alias("denied_inside"), "n"
    )


@query(
    "same_target",
    """select o_orderkey, o_orderkey % 11 > 0 and o_orderkey % 13 > 0 and o_custkey % 10 = o_orderkey % 10 as reached from orders""",
)
def same_targets(spark, folder):
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    site = F.when(F.col("o_orderkey") % 11 == 0, "https://other.example/a/").when(F.col("o_orderkey") % 13 == 0, "file://shop.example/a/").otherwise("https://shop.example/a/")
    deeper = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/"), text("o_orderpriority"), F.lit("?q=1"))).otherwise("")
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(site, text(F.col("o_custkey") % 10), deeper).alias("now"), F.concat(F.lit("https://shop.example/a/"), text(F.col("o_orderkey") % 10), F.lit("/")).alias("to")
    )
    return df.select("o_orderkey", same_target("now", "to").alias("reached"))


@query(
    "records_written_and_read",
    """select k as kind, o_orderkey, o_orderpriority as priority, 'site' || cast(o_custkey % 5 as varchar) || '.example' as domain
    from orders, (values ('csv'), ('json'), ('jsonl')) kinds(k) where o_orderkey % 3 = case k when 'csv' then 0 when 'json' then 1 else 2 end""",
)
def records_written_and_read(spark, folder):
    place = stream_folder(spark)
    url = F.concat(F.lit("https://www.site"), (F.col("o_custkey") % 5).cast("string"), F.lit(".example:80/orders"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), url.alias("source_url"))
    out = None
    for i, kind in enumerate(("csv", "json", "jsonl")):
        writers.write_records(rows.where(F.col("o_orderkey") % 3 == i), f"{place}/records.{kind}", url="source_url")
        # Spark names the lines it writes .json, and reads them so
        back = spark.read.schema("o_orderkey long, priority string, source_url string").option("header", True).format("csv" if kind == "csv" else "json")
        part = back.option("recursiveFileLookup", True).load(f"{place}/records.{kind}").withColumn("file", F.col("_metadata.file_path"))
        found = part.select(F.lit(kind).alias("kind"), "o_orderkey", "priority", F.regexp_extract("file", "domain=([^/]+)/", 1).alias("domain"))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "rows_appended_and_read",
    """select cast(c_custkey as varchar) as id, c_name as name, null as segment from customer where c_custkey % 2 = 0
    union all select cast(c_custkey as varchar), c_name, c_mktsegment from customer where c_custkey % 2 = 1""",
)
def rows_appended_and_read(spark, folder):
    place = stream_folder(spark)
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    writers.append_rows(c.where("id % 2 = 0").drop("segment"), place)
    writers.append_rows(c.where("id % 2 = 1"), place)
    return writers.read_appended(spark, place).select("id", "name", "segment")


# Events as controls: views are inputs, clicks buttons, errors forms, all others links with a label.
LABELS = ("Next page", "Previous", "17", "read more", "", "0")
CONTROLS_SQL = """
c as (select user_id as snapshot_id, 'e' || cast(event_id as varchar) as ref, 'p' || cast(event_id % 40 as varchar) as parent_ref, event_id as ord, event_type,
  ['Next page', 'Previous', '17', 'read more', '', '0'][event_id % 6 + 1] as label from events)"""


def control_nodes(spark, folder):
    kind, empty = F.col("event_type"), F.lit("")
    tag = F.when(kind == "view", "input").when(kind == "click", "button").when(kind == "error", "form").otherwise("a")
    number = F.col("event_id").cast("string")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("snapshot_id"), F.concat(F.lit("e"), number).alias("ref"), F.concat(F.lit("p"), (F.col("event_id") % 40).cast("string")).alias("parent_ref"),
        F.col("event_id").alias("ord"), tag.alias("tag"), empty.alias("role"), empty.alias("name"),
        F.get(F.array(*map(F.lit, LABELS)), (F.col("event_id") % 6).cast("int")).alias("text"),
    )


@query(
    "forms",
    f"""with {CONTROLS_SQL}, own as (select snapshot_id, 0 as k, ord, ref, 'form' as kind, '' as inputs, '' as buttons from c where event_type = 'error'),
    held as (select snapshot_id, 1 as k, min(ord) as ord, parent_ref as ref, 'form_group' as kind, coalesce(string_agg(ref, ',' order by ord) filter (event_type = 'view'), '') as inputs,
      coalesce(string_agg(ref, ',' order by ord) filter (event_type = 'click'), '') as buttons from c where event_type in ('view', 'click')
      group by snapshot_id, parent_ref having count(*) filter (event_type = 'view') > 0)
    select snapshot_id, ref, kind, inputs, buttons, row_number() over (partition by snapshot_id order by k, ord, ref) as entry_no from (from own union all from held)""",
)
def forms(spark, folder):
    df = features.forms(control_nodes(spark, folder))
    return df.select("snapshot_id", "ref", "kind", F.array_join("inputs", ",").alias("inputs"), F.array_join("buttons", ",").alias("buttons"), "entry_no")


@query(
    "page_controls",
    f"""with {CONTROLS_SQL} select snapshot_id, parent_ref, ref, ord, label, case label when 'Next page' then 'next' when 'Previous' then 'prev' else 'page_number' end as direction,
      true as enabled from c where label in ('Next page', 'Previous', '17') and event_type not in ('view', 'error')""",
)
def page_controls(spark, folder):
    return features.page_controls(control_nodes(spark, folder))


@query(
    "merge_nodes",
    """select user_id as snapshot_id, 'e' || cast(event_id as varchar) as ref, case when event_id % 2 = 0 and event_id % 3 > 0 then 'first ' || event_type else event_type end as text,
      case when event_id % 2 = 0 then 'one' else 'two' end as origin, cast(value as varchar) is not null as valued, 'element' as ref_type,
      case when event_id % 2 = 0 then event_id else 1000000000 + event_id end as ord from events
    union all select user_id, '', 'loose', null, null, null, event_id from events where event_id % 10 = 0""",
)
def merge_nodes(spark, folder):
    e = table(spark, folder, "events")
    base = lambda text, origin: (
        F.col("user_id").alias("snapshot_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("ref"), text.alias("text"),
        F.create_map(F.lit("origin"), F.lit(origin)).alias("attrs"), F.lit("").alias("ref_type"), F.col("event_id").alias("ord"),
    )
    said = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("first "), "event_type")).otherwise("")
    first = e.where("event_id % 2 = 0").select(*base(said, "one"))
    second = e.select(*base(F.col("event_type"), "two"), F.col("value").isNotNull().alias("valued"))
    loose = e.where("event_id % 10 = 0").select(F.col("user_id").alias("snapshot_id"), F.lit("").alias("ref"), F.lit("loose").alias("text"), F.col("event_id").alias("ord"))
    merged = snapshots.merge_nodes([first, second, loose])
    return merged.select("snapshot_id", "ref", "text", F.col("attrs")["origin"].alias("origin"), "valued", "ref_type", "ord")


@query(
    "text_rules",
    """with t as (select *, p_brand || ' /' || p_type || '!' as label from part)
    select p_partkey, regexp_replace(regexp_replace(label, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
      case when length(p_name || ' ' || p_type) > 12 then substr(p_name || ' ' || p_type, 1, 11) || '…' else p_name || ' ' || p_type end as shown,
      p_size >= 10 as is_thread, case p_partkey % 4 when 0 then 'x://a[' || p_size || ']' when 1 then 'x://b' when 2 then 'css:c' else '' end as locator,
      p_partkey % 3 > 0 as is_success, case p_partkey % 3 when 0 then 'Step executed.' else p_name end as summary, case p_partkey % 3 when 1 then 'global' else 'local' end as failure_scope,
      case p_partkey % 5 when 4 then null else p_size end as parsed from t""",
)
def text_rules(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    locator = (
        F.when(key % 4 == 0, F.concat(F.lit(" .//a["), size, F.lit("]/@href"))).when(key % 4 == 1, "x:.//b/text()").when(key % 4 == 2, "css:c@@tag=div")
        .otherwise("@@attr=x")
    )
    verdict = F.when(key % 3 == 0, "Status: STEP_FAIL\nFailureScope: sideways").otherwise(
        F.concat(F.lit("status : step_success\nSummary: old\n  SUMMARY:  "), "p_name", F.when(key % 3 == 1, "\nFailureScope: GLOBAL").otherwise(""))
    )
    body = F.concat(F.lit('{"size": '), size, F.lit("}"))
    almost = (
        F.when(key % 5 == 0, body).when(key % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key % 5 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked")))
        .when(key % 5 == 3, F.concat(body, F.lit("\n"), body)).otherwise("no record {")
    )
    parsed = let(lenient_json(almost), lambda j: F.coalesce(F.try_variant_get(j, "$.size", "int"), F.try_variant_get(j, "$[0].size", "int")))
    v = verdict_fields(verdict)
    return spread(table(spark, folder, "part")).select(
        "p_partkey", slug(F.concat("p_brand", F.lit(" /"), "p_type", F.lit("!"))).alias("slug"), ellipsize(F.concat("p_name", F.lit(" \n "), "p_type"), 12).alias("shown"),
        is_valid_thread_id(F.concat(size, F.lit(":t"))).alias("is_thread"), sanitize_locator(locator).alias("locator"), v["is_success"].alias("is_success"),
        v["summary"].alias("summary"), v["failure_scope"].alias("failure_scope"), parsed.alias("parsed"),
    )

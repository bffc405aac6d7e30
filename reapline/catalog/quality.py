"""Record queries: order lines as scraped records with gaps and mistakes."""

from pyspark.sql import functions as F

from reapline.catalog.registry import query, table
from reapline.operators import quality as ops
from reapline.session import spread

ITEMS_SQL = """
items as (
  select l_suppkey % 40 as run_id, l_linenumber as page_number, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey as pos,
    case when l_quantity > 47 then ' ' when l_quantity > 44 then 'https://bad.example/x' else 'part ' || cast(l_partkey as varchar) end as title,
    case when l_discount = 0 then 'javascript:alert(1)' when l_tax = 0.08 then ''
      else 'https://shop.example/p/' || cast(l_partkey % 300 as varchar) || case when l_tax > 0.04 then '/' else '' end end as href,
    case when l_discount > 0.09 then 'n/a' when l_quantity < 3 then '' else '$' || cast(cast(l_extendedprice as decimal(12,2)) as varchar) end as price,
    case when l_linestatus = 'O' then cast(year(l_shipdate) as varchar) else '' end as year
  from lineitem
),
identified as (
  select *, case when href <> '' then regexp_replace(href, '/+$', '')
    else 'href=;price=' || price || ';title=' || title || ';year=' || year end as ident from items
),
merged as (
  select run_id, ident, min((page_number, pos)) as first_pos,
    arg_max(title, (page_number, pos)) filter (regexp_matches(title, '\\S')) as title,
    arg_max(href, (page_number, pos)) filter (regexp_matches(href, '\\S')) as href,
    arg_max(price, (page_number, pos)) filter (regexp_matches(price, '\\S')) as price,
    arg_max(year, (page_number, pos)) filter (regexp_matches(year, '\\S')) as year
  from identified group by run_id, ident
),
judged as (
  select *, coalesce(title is not null and not regexp_matches(title, '(?i)^https?://'), false) as title_ok,
    coalesce(regexp_matches(href, '(?i)^https?://[^/?#]+'), false) as url_ok,
    coalesce(regexp_full_match(replace(price, ',', ''), '(?:[$€£¥]\\s*)?\\d+(?:\\.\\d{1,2})?'), false) as price_ok,
    coalesce(try_cast(year as int) between 1000 and 2100, false) as year_ok
  from merged
)"""

SCHEMA = ("title", "url", "price", "year")


def items(spark, folder):
    key = lambda c: F.col(c).cast("string")
    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    title = F.when(quantity > 47, " ").when(quantity > 44, "https://bad.example/x").otherwise(F.concat(F.lit("part "), key("l_partkey")))
    slash = F.when(tax > 0.04, "/").otherwise("")
    link = F.concat(F.lit("https://shop.example/p/"), (F.col("l_partkey") % 300).cast("string"), slash)
    href = F.when(discount == 0, "javascript:alert(1)").when(tax == 0.08, "").otherwise(link)
    money = F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    price = F.when(discount > 0.09, "n/a").when(quantity < 3, "").otherwise(money)
    year = F.when(F.col("l_linestatus") == "O", F.year("l_shipdate").cast("string")).otherwise("")
    return spread(table(spark, folder, "lineitem")).select(
        (F.col("l_suppkey") % 40).alias("run_id"),
        F.col("l_linenumber").alias("page_number"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("pos"),
        F.create_map(F.lit("title"), title, F.lit("href"), href, F.lit("price"), price, F.lit("year"), year).alias("fields"),
    )


def contracts(spark, folder):
    return items(spark, folder).select("run_id").distinct().select(
        "run_id",
        F.array(*[F.lit(f) for f in SCHEMA[:2]], F.when(F.col("run_id") % 3 > 0, F.lit("price"))).alias("_s"),
        F.when(F.col("run_id") % 5 == 0, 400).otherwise(100).alias("min_items"),
    ).select("run_id", F.array_compact("_s").alias("schema"), "min_items")


@query(
    "merge_items",
    f"""with {ITEMS_SQL} select run_id, first_pos[1] as page_number, first_pos[2] as pos, title, href, price, year from merged""",
)
def merge_items(spark, folder):
    return ops.merge_items(items(spark, folder)).select(
        "run_id", "first_pos.page_number", "first_pos.pos", *[F.col("fields")[c].alias(c) for c in ("title", "href", "price", "year")]
    )


@query(
    "first_items",
    f"""with {ITEMS_SQL}, one as (select * from identified qualify row_number() over (partition by run_id, ident order by page_number, pos) = 1)
    select run_id, title, href, row_number() over (partition by run_id order by page_number, pos) as item_no from one
    qualify row_number() over (partition by run_id order by page_number, pos) <= 20""",
)
def first_items(spark, folder):
    df = ops.first_items(items(spark, folder), 20)
    return df.select("run_id", F.col("fields")["title"].alias("title"), F.col("fields")["href"].alias("href"), "item_no")


@query(
    "field_validity",
    f"""with {ITEMS_SQL} select run_id, f.field, count(*) as items, count(*) filter (f.present) as populated, count(*) filter (f.valid) as valid
    from (select run_id, unnest([
        {{'field': 'title', 'present': title is not null, 'valid': title_ok}}, {{'field': 'url', 'present': href is not null, 'valid': url_ok}},
        {{'field': 'price', 'present': price is not null, 'valid': price_ok}}, {{'field': 'year', 'present': year is not null, 'valid': year_ok}}]) as f
      from judged) group by 1, 2""",
)
def field_validity(spark, folder):
    df = items(spark, folder)
    wanted = df.select("run_id").distinct().withColumn("schema", F.array(*[F.lit(f) for f in SCHEMA]))
    return ops.field_ratios(ops.merge_items(df), wanted)


@query(
    "evaluate_contract",
    f"""with {ITEMS_SQL}, r as (
      select run_id, count(*) as n, case when run_id % 5 = 0 then 400 else 100 end as need,
        avg(cast(title is not null as int)) >= 0.8 and avg(cast(href is not null as int)) >= 0.8
          and (run_id % 3 = 0 or avg(cast(price is not null as int)) >= 0.8) as fields_ok,
        avg(cast(title_ok as int)) >= 0.8 and avg(cast(url_ok as int)) >= 0.8 and (run_id % 3 = 0 or avg(cast(price_ok as int)) >= 0.8) as values_ok
      from judged group by run_id)
    select run_id, n >= need and fields_ok and values_ok as is_success, n as item_count, cast(need as bigint) as required_count,
      n >= need as count_ok, fields_ok, values_ok,
      case when n >= need and fields_ok and values_ok then 'task contract satisfied (' || n || ' items)'
        else concat_ws('; ', case when n < need then 'item count ' || n || '/' || need end,
          case when not fields_ok then 'required field coverage below 80%' end, case when not values_ok then 'invalid required field values' end) end as summary
    from r""",
)
def evaluate_contract(spark, folder):
    return ops.evaluate_contract(items(spark, folder), contracts(spark, folder)).drop("field_coverage", "field_validity")


@query(
    "item_quality",
    f"""with {ITEMS_SQL} select run_id, pos, concat_ws(',',
      case when not (regexp_matches(title, '\\S') and not regexp_matches(title, '(?i)^https?://')) then 'title' end,
      case when not regexp_matches(href, '(?i)^https?://[^/?#]+') then 'href' end,
      case when not regexp_full_match(price, '(?:[$€£¥]\\s*)?\\d+(?:\\.\\d{{1,2}})?') then 'price' end,
      case when not coalesce(try_cast(year as int) between 1000 and 2100, false) then 'year' end) as issues from items""",
)
def item_quality(spark, folder):
    schema = F.array(*[F.lit(c) for c in ("title", "href", "price", "year")])
    found = ops.item_quality("fields", schema)["issues"]
    return items(spark, folder).select("run_id", "pos", F.array_join(F.transform(found, lambda i: i["field"]), ",").alias("issues"))


@query(
    "provenance",
    f"""with {ITEMS_SQL} select case when page_number = 7 then 'list-items' else 'extract' end as action,
      case when run_id % 2 = 0 then 'https://shop.example/list' else 'https://shop.example/' end as source_url,
      'snap-' || cast(run_id as varchar) as snapshot_id, count(*) as records,
      count(*) filter (regexp_matches(title, '\\S') and not regexp_matches(title, '(?i)^https?://')) as valid_titles
    from items where page_number in (1, 7) group by 1, 2, 3""",
)
def provenance(spark, folder):
    page = F.col("page_number")
    df = items(spark, folder).withColumns(
        {
            "ok": page != 2,
            "action": F.when(page == 7, "list-items").when(page == 1, "Extract ").otherwise("click"),
            "schema": F.array(F.lit("title")),
            "page_url": F.when(F.col("run_id") % 2 == 0, "https://shop.example/list").otherwise(""),
            "current_url": F.lit("https://shop.example/"),
            "snapshot_id": F.concat(F.lit("snap-"), F.col("run_id").cast("string")),
            "content_hash": F.lit(""),
            "index_file": F.lit(""),
        }
    )
    noted = ops.annotate_provenance(df, F.lit("2024-01-01T00:00:00")).where("provenance is not null")
    return noted.groupBy("provenance.action", "provenance.source_url", "provenance.snapshot_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("quality.valid_fields")["title"]).alias("valid_titles")
    )


@query(
    "schema_coverage",
    f"""with {ITEMS_SQL}, usable as (select *, run_id * 10 + page_number as result_id from items
      where regexp_matches(title || href || price || year, '\\S')),
    per as (select result_id, count(*) as usable_items,
      sum(cast(regexp_matches(title, '\\S') as int) + cast(regexp_matches(href, '(?i)^https?://[^/?#]+') as int) + cast(regexp_matches(year, '\\S') as int)) as populated,
      count(*) filter (regexp_matches(href, '(?i)^https?://[^/?#]+')) as urls,
      count(distinct regexp_replace(href, '/+$', '')) filter (regexp_matches(href, '(?i)^https?://[^/?#]+')) as distinct_urls
      from usable group by result_id),
    v as (select *, populated / (usable_items * 3) as coverage, case when urls > 1 then distinct_urls / urls end as unique_url_ratio from per)
    select result_id, usable_items, coverage, unique_url_ratio,
      case when result_id % 4 = 3 then null when coverage = 0 or coalesce(unique_url_ratio < 0.8, false) then 'data_quality' when coverage >= 0.6 then 'schema_match' end as decision,
      case when result_id % 4 = 3 then null when coverage = 0 or coalesce(unique_url_ratio < 0.8, false) then false when coverage >= 0.6 then true end as is_success
    from v""",
)
def schema_coverage(spark, folder):
    df = items(spark, folder).withColumn("result_id", F.col("run_id") * 10 + F.col("page_number"))
    results = df.select("result_id").distinct().select(
        "result_id", (F.col("result_id") % 4 != 3).alias("ok"), F.array(F.lit("title"), F.lit("href"), F.lit(" Year ")).alias("schema")
    )
    return ops.schema_coverage(results, df)


@query(
    "detail_success",
    f"""with {ITEMS_SQL} select run_id as result_id, count(*) as rows, count(*) filter (ok) as verified,
      count(*) filter (ok) / count(*) as success_ratio, count(*) filter (ok) / count(*) >= 0.8 as is_success
    from (select run_id, page_number <> 4 and regexp_matches(href, '(?i)^https?://[^/?#]+') and regexp_matches(title || price, '\\S') as ok from items) group by 1""",
)
def detail_success(spark, folder):
    m = F.col("fields")
    df = items(spark, folder).select(
        F.col("run_id").alias("result_id"),
        (F.col("page_number") != 4).alias("detail_ok"),
        m["href"].alias("final_url"),
        F.map_filter(m, lambda k, _: k.isin("title", "price")).alias("detail_fields"),
    )
    return ops.detail_success_ratio(df)


def case_rows(spark, folder):
    """Ten cases over the runs, each with its own limits."""
    from pyspark.sql import types as T

    case = F.col("case_no")
    nothing = F.array().cast(T.ArrayType(T.StringType()))
    return (
        items(spark, folder).select((F.col("run_id") % 10).alias("case_no")).distinct()
        .select(
            F.concat(F.lit("case-"), case.cast("string")).alias("case_key"),
            F.when(case == 3, "https://other.example/").otherwise("https://shop.example/").alias("url"),
            F.lit(100).alias("expected_min_items"),
            F.when(case < 5, 250).otherwise(10000).alias("expected_max_items"),
            F.when(case % 2 == 0, F.array(F.array(F.lit("title"), F.lit("name")), F.array(F.lit("price"))))
            .otherwise(F.array(F.array(F.lit("title"), F.lit("name")), F.array(F.lit("year"), F.lit("price")))).alias("required_field_groups"),
            F.when(case == 1, F.array(F.lit("PART 17"))).when(case == 2, F.array(F.lit("no such part"))).otherwise(nothing).alias("anchor_values"),
            F.lit(False).alias("anchor_required"),
            (case > 6).alias("allow_detail_batch"),
            F.lit(7).alias("minimum_title_length"),
            F.when(case % 3 == 0, F.array(F.lit("SHOP\\.example/p/1"), F.lit("/p/2"))).otherwise(nothing).alias("relevant_url_patterns"),
            F.array(F.lit("^javascript:")).alias("forbidden_url_patterns"),
            F.when(case == 4, 0.5).otherwise(0.0).alias("minimum_chinese_title_ratio"),
            F.when(case % 2 == 0, 0.6).otherwise(0.0).alias("minimum_relevant_item_ratio"),
        )
    )


RELEVANT = """(length(title) >= 7 and not regexp_matches(href, '(?i)^javascript:') and trim(href) <> ''
  and (run_id % 10 % 3 <> 0 or regexp_matches(href, '(?i)shop\\.example/p/1|/p/2')))"""


@query("relevant_items", f"with {ITEMS_SQL} select run_id, pos from items where regexp_matches(title, '\\S') and {RELEVANT}")
def relevant_items(spark, folder):
    df = items(spark, folder).withColumn("case_key", F.concat(F.lit("case-"), (F.col("run_id") % 10).cast("string")))
    return ops.relevant_items(df, case_rows(spark, folder)).select("run_id", "pos")


@query(
    "valid_records",
    f"""with {ITEMS_SQL} select run_id, pos from items where
    regexp_matches(title, '\\S') and not regexp_matches(title, '(?i)^https?://')
    and case when run_id % 2 = 0 then regexp_full_match(price, '\\$\\d+(\\.\\d+)?')
      else case when regexp_matches(year, '\\S') then year between '1000' and '2100' else regexp_full_match(price, '\\$\\d+(\\.\\d+)?') end end
    and not regexp_matches(href, '(?i)^javascript:') and (run_id % 10 % 3 <> 0 or regexp_matches(href, '(?i)shop\\.example/p/1|/p/2'))""",
)
def valid_records(spark, folder):
    df = items(spark, folder).withColumn("case_key", F.concat(F.lit("case-"), (F.col("run_id") % 10).cast("string")))
    return ops.valid_records(df, case_rows(spark, folder)).select("run_id", "pos")


@query(
    "detail_queue",
    f"""with {ITEMS_SQL}, u as (select *, regexp_replace(href, '/+$', '') as detail_url from items where regexp_matches(href, '(?i)^https?://[^/?#]+') and run_id % 4 = 1),
    one as (select * from u qualify row_number() over (partition by run_id, detail_url order by page_number, pos) = 1)
    select run_id, detail_url, row_number() over (partition by run_id order by page_number, pos) as queue_no from one
    qualify row_number() over (partition by run_id order by page_number, pos) <= 100""",
)
def detail_queue(spark, folder):
    df = items(spark, folder)
    run = F.col("run_id")
    runs = df.select("run_id").distinct().select(
        "run_id", (run % 2 == 1).alias("detail_required"), (run % 4 == 1).alias("list_complete"), F.lit(False).alias("detail_batch_ran"),
        F.lit(True).alias("wants_details"),
    )
    return ops.detail_queue(runs, df).select("run_id", "detail_url", "queue_no")


@query(
    "project_schema",
    f"""with {ITEMS_SQL} select run_id, pos, year, price from items where year <> '' or price <> ''""",
)
def project_schema(spark, folder):
    df = ops.project_schema(items(spark, folder), ("year", "price", "rank"))
    return df.select("run_id", "pos", F.col("fields")["year"].alias("year"), F.col("fields")["price"].alias("price"))


@query(
    "fallback_records",
    f"""with {ITEMS_SQL}, p as (select run_id, pos, title, price from items where page_number < 4),
    f as (select run_id, pos, title, price from items where page_number >= 4 and price not in ('', 'n/a') and regexp_matches(title, '\\S') and not regexp_matches(title, '(?i)^https?://')),
    ok as (select run_id from (select run_id, title, price from p where regexp_matches(title || price, '\\S') group by all) group by run_id
      having count(*) >= 3 and avg(cast(regexp_matches(title, '\\S') as int)) >= 0.8 and avg(cast(regexp_matches(price, '\\S') as int)) >= 0.8
        and avg(cast(regexp_matches(title, '\\S') and not regexp_matches(title, '(?i)^https?://') as int)) >= 0.8 and avg(cast(regexp_full_match(price, '\\$\\d+(\\.\\d+)?') as int)) >= 0.8)
    select run_id, pos, 'primary' as record_source from p where run_id in (select run_id from ok)
    union all select run_id, pos, 'fallback' from f where run_id not in (select run_id from ok)
      qualify row_number() over (partition by run_id order by pos) <= 3""",
)
def fallback_records(spark, folder):
    m = F.col("fields")
    df = items(spark, folder).withColumn("fields", F.create_map(F.lit("title"), m["title"], F.lit("price"), m["price"]))
    primary = df.where("page_number < 4")
    fallback = df.where(
        (F.col("page_number") >= 4) & ~m["price"].isin("", "n/a") & m["title"].rlike(r"\S") & ~m["title"].rlike("(?i)^https?://")
    )
    wanted = df.select("run_id").distinct().select("run_id", F.array(F.lit("title"), F.lit("price")).alias("schema"), F.lit(3).alias("min_items"))
    return ops.fallback_if_failing(primary, fallback, wanted, "run_id", ["pos"]).select("run_id", "pos", "record_source")


@query(
    "evaluate_runs",
    f"""with {ITEMS_SQL}, r as (
      select run_id, run_id % 10 as c, count(*) as n,
        avg(cast(title is not null as int)) >= 0.8 and case when run_id % 2 = 0 then avg(cast(price is not null as int)) else avg(cast(price is not null or year is not null as int)) end >= 0.8 as fields_ok,
        case run_id % 10 when 1 then bool_or(contains(lower(title), 'part 17')) when 2 then false else true end as anchor,
        round(avg(cast(title is not null and {RELEVANT} as int)), 3) as relevant,
        avg(cast(title is not null and {RELEVANT} as int)) >= 0.6 as relevant_ok
      from (select run_id, title, coalesce(href, '') as href, price, year from merged) group by 1, 2),
    k as (select *, [c <> 3, n >= 100, n <= case when c < 5 then 250 else 10000 end, fields_ok, anchor, c > 6, run_id % 4 = 0]
      || case when c = 4 then [false] else [] end || case when c % 2 = 0 then [relevant_ok] else [] end as checks from r)
    select run_id, round(len(list_filter(checks, lambda x: x)) * 100.0::double / len(checks), 1) as accuracy_score, n as unique_item_count,
      cast(0.0 as double) as chinese_title_ratio, relevant as relevant_item_ratio, anchor as anchor_match, true as detail_batch_ran,
      len(checks) as checks from k""",
)
def evaluate_runs(spark, folder):
    df = items(spark, folder)
    run = F.col("run_id")
    runs = df.select("run_id").distinct().select(
        "run_id", F.concat(F.lit("case-"), (run % 10).cast("string")).alias("case_key"),
        F.when(run % 4 == 0, "completed").otherwise("stopped").alias("status"),
    )
    results = df.select(
        "run_id", F.lit(True).alias("ok"), F.when(F.col("page_number") == 5, "batch-detail-extract").otherwise("extract").alias("action"),
        F.lit("https://shop.example/list").alias("page_url"),
    )
    out = ops.evaluate_runs(runs, case_rows(spark, folder), results, df)
    return out.withColumn("checks", F.size("checks").cast("long")).drop("case_key", "status")

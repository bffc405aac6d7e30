"""Search, document and cache queries."""

from pyspark.sql import functions as F

from reapline.catalog.registry import query, table
from reapline.functions.text import search_tokens, word_set
from reapline.operators import caches, documents, retrieval
from reapline.plans.blocked import Blocked, number_block
from reapline.session import spread

TOKENS = "regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fa5}]+|[a-z0-9]+')"

BM25_SQL = f"""
tok as (select doc_id, {TOKENS} as t from documents),
n as (select count(*) as n, avg(len(t)) as avgdl from tok),
posting as (select doc_id, len(t) as dl, unnest(t) as term from tok),
tf as (select doc_id, dl, term, count(*) as tf from posting group by all),
df as (select term, count(*) as df from tf group by term),
idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, n),
fl as (select 0.25 * avg(idf) as f from idf),
q as (select item_id as query_id, term, count(*) as q_tf from (select item_id, unnest({TOKENS}) as term from benchmark) group by all),
scored as (select query_id, doc_id, round(sum(q_tf * case when idf < 0 then f else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from q join tf using (term) join idf using (term), n, fl group by 1, 2),
bm as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored
  qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10)"""


def docs(spark, folder):
    return spread(table(spark, folder, "documents"))


def asked(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", f"with {BM25_SQL} select query_id, doc_id, score, rank from bm")
def bm25_topk(spark, folder):
    return retrieval.bm25(docs(spark, folder), asked(spark, folder), 10)


VEC_SQL = """
d as (select vec_id, label, embedding::double[] as v from embeddings),
q as (select vec_id as query_id, label, embedding::double[] as v from embeddings where vec_id % 10 = 0)"""


def vectors(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return e, e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")


@query(
    "dense_topk",
    f"""with {VEC_SQL}, s as (select query_id, vec_id, round(list_cosine_similarity(q.v, d.v), 6) + 0 as score from q join d on query_id <> vec_id)
    select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""",
)
def dense_topk(spark, folder):
    stored, wanted = vectors(spark, folder)
    return retrieval.dense_topk(stored, wanted, 10, doc_id="vec_id", other_rows=True)


@query(
    "dense_topk_by_label",
    f"""with {VEC_SQL}, s as (select query_id, vec_id, round(list_cosine_similarity(q.v, d.v), 6) + 0 as score from q join d on q.label = d.label and query_id <> vec_id)
    select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 3""",
)
def dense_topk_by_label(spark, folder):
    stored, wanted = vectors(spark, folder)
    return retrieval.dense_topk(stored, wanted, 3, doc_id="vec_id", part="label", other_rows=True)


@query("mmr")
def mmr(spark, folder):
    stored, wanted = vectors(spark, folder)
    return retrieval.mmr(stored, wanted, 5, doc_id="vec_id", other_rows=True)


RANKED_SQL = """
r1 as (select lang as query_id, doc_id, text, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents),
r2 as (select lang as query_id, doc_id, text, row_number() over (partition by lang order by doc_id) as rank from documents),
fused as (select query_id, md5(text) as k, round(sum(w / (rank - 1 + 60)), 9) as score, min(doc_id) as doc_id, min(text) as text
  from (select *, 0.7 as w from r1 union all select *, 0.3 from r2) group by 1, 2)"""


def ranked(spark, folder):
    """All documents of a language, by length and by id; ranks are counted block by block."""
    d = docs(spark, folder).select(F.col("lang").alias("query_id"), "doc_id", "text", (-F.col("n_chars")).alias("shorter"))
    by_size = Blocked(["query_id"], ["shorter", "doc_id"], number_block("shorter", 200))
    by_id = Blocked(["query_id"], ["doc_id"], number_block("doc_id", 50_000))
    return [b.done(b.row_number(d, "rank")) for b in (by_size, by_id)]


@query("rrf", f"with {RANKED_SQL} select query_id, doc_id, score from fused")
def rrf(spark, folder):
    return retrieval.rrf(ranked(spark, folder), (0.7, 0.3)).drop("text")


@query(
    "dedup_prefix",
    f"""with {RANKED_SQL} select query_id, doc_id, score from fused
    qualify row_number() over (partition by query_id, left(text, 100) order by score desc, doc_id) = 1""",
)
def dedup_prefix(spark, folder):
    return retrieval.dedup_prefix(retrieval.rrf(ranked(spark, folder), (0.7, 0.3))).drop("text")


@query(
    "rerank",
    f"""with {RANKED_SQL}, s as (select query_id, doc_id, length(text) - length(replace(text, 'e', '')) as rerank_score from fused)
    select query_id, doc_id, cast(rerank_score as double) as rerank_score, row_number() over (partition by query_id order by rerank_score desc, doc_id) as rank from s
    qualify row_number() over (partition by query_id order by rerank_score desc, doc_id) <= 10""",
)
def rerank(spark, folder):
    fused = retrieval.rrf(ranked(spark, folder), (0.7, 0.3)).withColumn("query_text", F.lit("e"))
    count = lambda q, t: (F.length(t) - F.length(F.replace(t, q, F.lit("")))).cast("double")
    return retrieval.rerank(fused, count, 10).select("query_id", "doc_id", "rerank_score", "rank")


@query("hybrid_search")
def hybrid_search(spark, folder):
    model = retrieval.hashing_embedder(64)
    d = retrieval.embed(docs(spark, folder).select("doc_id", "text"), "text", model)
    q = retrieval.embed(asked(spark, folder), "text", model)
    return retrieval.hybrid_search(d, q, 5).select("query_id", "doc_id", "score", "rank")


@query("search_tokens", f"select doc_id, len({TOKENS}) as tokens, len(list_distinct({TOKENS})) as distinct_tokens from documents")
def tokens(spark, folder):
    t = docs(spark, folder).select("doc_id", search_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@query(
    "sorted_docs",
    """select p_partkey, p_name, p_retailprice from part order by case when p_size % 7 = 0 then null else p_retailprice end desc nulls last, p_partkey limit 25""",
)
def sorted_docs(spark, folder):
    value = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    return documents.sorted_docs(table(spark, folder, "part"), value, True, 25, "p_partkey").select("p_partkey", "p_name", "p_retailprice")


RECORDS_SQL = """
rec as (select event_id as doc_id, date_trunc('day', ts) as batch_id, event_type, user_id,
  case when user_id % 11 = 0 then '-' when event_type = 'view' and cast(json_extract_string(props, '$.k') as int) % 9 = 0 then cast(cast(value as decimal(12,2)) as varchar) || ' %'
    else '¥' || cast(cast(value as decimal(12,2)) as varchar) end as price,
  json_extract_string(props, '$.k') || case when event_type = 'click' then '%' else '' end as share from events),
cell as (
  select batch_id, doc_id, 'price' as field, price as v from rec where price <> '-' union all
  select batch_id, doc_id, 'share', share from rec union all
  select batch_id, doc_id, 'kind', event_type from rec),
typed as (select *, try_cast(replace(regexp_replace(regexp_replace(v, '^[¥$€£￥]\\s*', ''), '\\s*%$', ''), ',', '') as double) as num, suffix(v, '%') as pct from cell),
stat as (select batch_id, field, count(*) as n, count(*) filter (pct) as p from typed where num is not null group by 1, 2),
kept as (select t.* from typed t left join stat s using (batch_id, field) where not (coalesce(pct, false) and num is not null and s.n >= 3 and s.p > 0 and s.p / s.n < 0.5))"""


def records(spark, folder):
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    amount = F.col("value").cast("decimal(12,2)").cast("string")
    price = (
        F.when(F.col("user_id") % 11 == 0, "-").when((F.col("event_type") == "view") & (k.cast("int") % 9 == 0), F.concat(amount, F.lit(" %")))
        .otherwise(F.concat(F.lit("¥"), amount))
    )
    share = F.concat(k, F.when(F.col("event_type") == "click", "%").otherwise(""))
    fields = F.create_map(
        F.lit("price"), price, F.lit("share"), share, F.lit("kind"), F.col("event_type"), F.lit("name"), F.concat(F.lit("event "), F.col("event_id").cast("string"))
    )
    df = e.select(F.col("event_id").alias("doc_id"), F.date_trunc("day", "ts").alias("batch_id"), fields.alias("fields"))
    return documents.doc_metadata(df, F.lit("auto"), F.col("batch_id").cast("string"))


@query(
    "percent_consistency",
    f"with {RECORDS_SQL} select batch_id, field, count(*) as cells, count(num) as numbers, count(*) filter (pct and num is not null) as percents from kept group by 1, 2",
)
def percent_consistency(spark, folder):
    kept = documents.percent_consistency(records(spark, folder)).select("batch_id", F.explode(F.map_entries("dyn")).alias("e"))
    return kept.where("e.key <> 'name'").groupBy("batch_id", F.col("e.key").alias("field")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("e.value.value").alias("numbers"), F.count_if("e.value.was_percent").alias("percents")
    )


@query(
    "field_registry",
    f"""with {RECORDS_SQL} select field, min(batch_id) as first_seen, count(*) as count, case when count(num) > 0 then 'number' else 'string' end as type
    from typed group by field union all select 'name', min(batch_id), count(*), 'string' from rec""",
)
def field_registry(spark, folder):
    return documents.registry_listing(documents.field_registry(records(spark, folder), "batch_id"))


@query("doc_metadata", f"with {RECORDS_SQL} select doc_id, 'event ' || cast(doc_id as varchar) as title, 'auto' as source, '' as category, 'crawled' as data_type from rec")
def doc_metadata(spark, folder):
    return records(spark, folder).select("doc_id", "title", "source", "category", "data_type")


@query(
    "filter_docs",
    f"""with {RECORDS_SQL} select r.doc_id from rec r join typed p on p.doc_id = r.doc_id and p.field = 'price' where p.num > 100 and r.event_type = 'purchase'""",
)
def filter_docs(spark, folder):
    return documents.filter_docs(records(spark, folder), "dyn['price'].value > 100 and dyn['kind'].text = 'purchase'").select("doc_id")


@query(
    "build_docs",
    "select doc_id, md5(text) as digest from documents where length(text) >= 10",
)
def build_docs(spark, folder):
    name = F.when(F.col("doc_id") % 2 == 0, "content").otherwise("summary")
    df = docs(spark, folder).select("doc_id", F.create_map(name, "text").alias("fields"))
    return documents.build_docs(df).select("doc_id", F.md5("text").alias("digest"))


@query(
    "not_expired",
    """select event_id, user_id from events where event_type <> 'error' and ts + interval 24 hour >= timestamp '2024-01-15'""",
)
def not_expired(spark, folder):
    e = table(spark, folder, "events")
    until = F.when(F.col("event_type") == "error", "soon").otherwise((F.col("ts") + F.expr("interval 24 hours")).cast("string"))
    return documents.not_expired(e.withColumn("expire_at", until), F.lit("2024-01-15").cast("timestamp")).select("event_id", "user_id")


WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2))"


@query("word_set", f"select doc_id, len({WORDS}) as words from documents")
def words(spark, folder):
    return docs(spark, folder).select("doc_id", F.size(word_set("text")).cast("long").alias("words"))


@query(
    "jaccard_lookup",
    f"""with w as (select doc_id, lang as dom, {WORDS} as w from documents),
    s as (select q.doc_id as request_id, c.doc_id as cache_id, round(len(list_intersect(q.w, c.w)) / (len(q.w) + len(c.w) - len(list_intersect(q.w, c.w))), 6) as score
      from w q join w c on q.dom = c.dom where q.doc_id % 9 = 0 and c.doc_id % 9 <> 0 and c.doc_id % 7 <> 3 and len(list_intersect(q.w, c.w)) > 0)
    select request_id, cache_id, score, row_number() over (partition by request_id order by score desc, cache_id) as rank from s
    qualify row_number() over (partition by request_id order by score desc, cache_id) <= 5""",
)
def jaccard_lookup(spark, folder):
    d = docs(spark, folder).select("doc_id", F.col("lang").alias("domain_key"), word_set("text").alias("words"))
    requests = d.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "request_id")
    stored = d.where("doc_id % 9 <> 0").select(
        F.col("doc_id").alias("cache_id"), "domain_key", "words", F.lit(True).alias("is_success"), F.when(F.col("doc_id") % 7 == 3, 2).otherwise(0).alias("failure_count")
    )
    return caches.jaccard_lookup(requests, stored)


PARTS_SQL = """
e as (select vec_id, cast(label as varchar) as domain_key, embedding::double[] as v, list_transform(embedding::double[], lambda x, i: x * (1 + (i % 3) * 0.4)) as w from embeddings),
c as (select vec_id as cache_id, domain_key, v as t, v[1:32] || list_transform(v[33:64], lambda x: x * 0.5) as g, v[33:64] as u, v[1:32] as s from e),
q as (select vec_id as request_id, domain_key, w as t, w[1:32] || list_transform(w[33:64], lambda x: x * 0.5) as g, w[33:64] as u, w[1:32] as s from e where vec_id % 4 = 0),
pairs as (select request_id, cache_id, domain_key, list_cosine_similarity(q.t, c.t) as st, list_cosine_similarity(q.u, c.u) as su, list_cosine_similarity(q.g, c.g) as sg, list_cosine_similarity(q.s, c.s) as ss
  from q join c using (domain_key))"""


def cache_tables(spark, folder):
    """Every vector as a cached entry; every fourth one, bent a little, as a request."""
    e = table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("domain_key"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )

    def parts(df, key):
        v = F.col("v")
        half = F.transform(F.slice(v, 33, 32), lambda x: x * 0.5)
        return df.select(
            F.col("vec_id").alias(key), "domain_key", v.alias("task_vector"), F.concat(F.slice(v, 1, 32), half).alias("goal_vector"),
            F.slice(v, 33, 32).alias("url_vector"), F.slice(v, 1, 32).alias("step_vector"), v.alias("dom_vector"),
        )

    bent = F.transform("v", lambda x, i: x * (F.lit(1.0) + ((i + 1) % 3) * 0.4))
    return parts(e.where("vec_id % 4 = 0").withColumn("v", bent), "request_id"), parts(e, "cache_id")


@query(
    "multi_vector_lookup",
    f"""with {PARTS_SQL}, s as (select request_id, cache_id, round(st * 0.6 + su * 0.3 + sg * 0.1, 6) as score from pairs)
    select request_id, cache_id, score, row_number() over (partition by request_id order by score desc, cache_id) as rank from s
    qualify row_number() over (partition by request_id order by score desc, cache_id) <= 5""",
)
def multi_vector_lookup(spark, folder):
    requests, cache = cache_tables(spark, folder)
    return caches.multi_vector_lookup(requests, cache, ("task_vector", "url_vector", "goal_vector"), (0.6, 0.3, 0.1), 5)


def _staged(limit_task, limit_score, score, where="true"):
    return f"""with {PARTS_SQL}, two as (select request_id, cache_id, domain_key, round(st, 6) as task_similarity, round({score}, 6) as score from pairs where {where})
    select request_id, cache_id, task_similarity, score, row_number() over (partition by request_id order by score desc, cache_id) as rank from two
    where task_similarity >= {limit_task} and score >= {limit_score} qualify row_number() over (partition by request_id order by score desc, cache_id) <= 3"""


@query("staged_code_lookup", _staged(0.80, 0.88, "sg", "cache_id % 10 <> 1"))
def staged_code_lookup(spark, folder):
    requests, cache = cache_tables(spark, folder)
    failed = cache.where("cache_id % 10 = 1").select(
        F.lit("codecache").alias("cache_type"), "domain_key", "cache_id", F.lit("2024-01-02").cast("timestamp").alias("expire_at")
    )
    hits = caches.staged_code_lookup(requests, cache, 3, failed, F.lit("2024-01-01").cast("timestamp"))
    return hits.drop("domain_key", "cache_type")


@query("staged_dom_lookup", _staged(0.80, 0.90, "st * 0.65 + ss * 0.35", "cache_id % 3 <> 0"))
def staged_dom_lookup(spark, folder):
    requests, cache = cache_tables(spark, folder)
    dated = cache.withColumn("expire_at", F.when(F.col("cache_id") % 3 == 0, "2023-12-31T00:00:00").otherwise("2024-01-01T00:00:00"))
    hits = caches.staged_dom_lookup(requests, dated, F.lit("2024-01-01").cast("timestamp"), 3)
    return hits.drop("domain_key", "cache_type")


@query(
    "near_duplicates",
    f"""with {PARTS_SQL}, m as (select request_id, max(round(st, 6)) as score from pairs group by 1),
    i as (select q.request_id, max(round(list_cosine_similarity(q.t, o.t), 6)) as score from q join q o on q.domain_key = o.domain_key and o.request_id < q.request_id group by 1),
    b as (select request_id, max(score) as score from (from m union all from i) group by 1)
    select q.request_id as entry_id, domain_key, score as best_score, coalesce(score >= 0.95, false) as is_duplicate from q left join b using (request_id)""",
)
def near_duplicates(spark, folder):
    new, cache = cache_tables(spark, folder)
    new = new.select(F.col("request_id").alias("entry_id"), "domain_key", "task_vector")
    return caches.near_duplicates(new, cache, ("task_vector",), (1.0,))


ADMIT_SQL = """
hits as (select event_id, user_id as cache_id, case event_type when 'click' then 'action' when 'view' then 'code' else 'dom' end as kind, value / 100 as score, ts,
  case when user_id % 4 = 0 then '' when user_id % 4 = 1 then 'v1' else 'v2' end as version from events),
decided as (select *, case when cache_id in (select user_id from events where event_type = 'error' and value > 200) then 'failed_quarantine'
  when score < case kind when 'action' then 0.1 when 'code' then 0.2 else 0.05 end then 'below_threshold'
  when ts >= timestamp '2024-01-29' then 'same_run_write'
  when epoch_us(timestamp '2024-01-30') - epoch_us(ts) > case kind when 'action' then 240 when 'code' then 480 else 120 end * 3600000000 then 'expired'
  when version <> 'v2' then 'fingerprint_version_mismatch' else 'eligible' end as reason from hits)"""


def decisions(spark, folder):
    e = table(spark, folder, "events")
    hits = e.select(
        "event_id", F.col("user_id").alias("cache_id"),
        F.when(F.col("event_type") == "click", "action").when(F.col("event_type") == "view", "code").otherwise("dom").alias("kind"),
        (F.col("value") / 100).alias("score"), F.col("ts").alias("created_at"),
        F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, "v1").otherwise("v2").alias("fingerprint_version"),
    )
    failed = e.where("event_type = 'error' and value > 200").select(F.col("user_id").alias("cache_id"))
    return caches.admit(
        hits, {"action": 0.1, "code": 0.2, "dom": 0.05}, {"action": 240, "code": 480, "dom": 120}, F.lit("2024-01-30").cast("timestamp"), failed,
        F.lit("2024-01-29").cast("timestamp"), "v2",
    )


@query("cache_admission", f"with {ADMIT_SQL} select event_id, kind, reason, reason = 'eligible' as allowed from decided")
def cache_admission(spark, folder):
    return decisions(spark, folder).select("event_id", "kind", "reason", "allowed")


@query("rejection_counts", f"with {ADMIT_SQL} select kind, reason, count(*) as rejected from decided where reason <> 'eligible' group by 1, 2")
def rejection_counts(spark, folder):
    return caches.rejection_counts(decisions(spark, folder))


FAILURES_SQL = "f as (select event_type as cache_type, cast(user_id % 20 as varchar) as domain_key, user_id as cache_id, ts as failed_at, 'k' || json_extract_string(props, '$.k') as reason from events where value > 150)"


def failures(spark, folder):
    return table(spark, folder, "events").where("value > 150").select(
        F.col("event_type").alias("cache_type"), (F.col("user_id") % 20).cast("string").alias("domain_key"), F.col("user_id").alias("cache_id"),
        F.col("ts").alias("failed_at"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("reason"),
    )


@query("quarantine", f"with {FAILURES_SQL} select cache_type, domain_key, cache_id, max(failed_at) + interval 3600 second as expire_at from f group by all")
def quarantine(spark, folder):
    return caches.quarantine(failures(spark, folder), 3600)


@query(
    "drop_quarantined",
    f"""with {FAILURES_SQL}, b as (select cache_type, domain_key, cache_id, max(failed_at) + interval 432000 second as expire_at from f group by all)
    select event_id from events e where not exists (select 1 from b where b.cache_type = e.event_type and b.domain_key = cast(e.user_id % 20 as varchar)
      and b.cache_id = e.user_id and b.expire_at > timestamp '2024-01-20')""",
)
def drop_quarantined(spark, folder):
    hits = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("cache_type"), (F.col("user_id") % 20).cast("string").alias("domain_key"), F.col("user_id").alias("cache_id")
    )
    listed = caches.quarantine(failures(spark, folder), 432000)
    return caches.drop_quarantined(hits, listed, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query(
    "failure_counts",
    f"""with {FAILURES_SQL} select c_custkey as cache_id, c_nationkey + coalesce(n, 0) as failure_count, last_failure_reason from customer
    left join (select cache_id, count(*) as n, arg_max(reason, failed_at) as last_failure_reason from f group by 1) on cache_id = c_custkey""",
)
def failure_counts(spark, folder):
    cache = table(spark, folder, "customer").select(F.col("c_custkey").alias("cache_id"), F.col("c_nationkey").alias("failure_count"))
    return caches.failure_counts(cache, failures(spark, folder))


@query(
    "cache_entries",
    r"""select page_id, left(md5(html), 16) || '_20240101000000' as cache_id, timestamp '2024-01-04' as expire_at from pages""",
)
def cache_entries(spark, folder):
    pages = table(spark, folder, "pages").withColumnRenamed("html", "dom")
    return caches.cache_entries(pages, F.lit("2024-01-01").cast("timestamp_ntz"), 72).select("page_id", "cache_id", "expire_at")


@query(
    "cacheable_code",
    """with c as (select conv_id, turn, case when role = 'user' then 'tab.get(' || text || ')' else text end as code, case when conv_id % 5 = 0 then 'cache' else 'new' end as src from conversations)
    select conv_id, turn from c where src <> 'cache' and length(code) >= 50 and not (length(code) <= 200 and contains(lower(code), 'tab.get(')
      and len(list_filter(string_split(code, chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), 'print'))) <= 3)""",
)
def cacheable_code(spark, folder):
    c = table(spark, folder, "conversations")
    code = F.when(F.col("role") == "user", F.concat(F.lit("tab.get("), F.col("text"), F.lit(")"))).otherwise(F.col("text"))
    rows = c.select("conv_id", "turn", code.alias("code"), F.when(F.col("conv_id") % 5 == 0, "cache").otherwise("new").alias("code_source"))
    return caches.cacheable(rows).select("conv_id", "turn")


@query(
    "locator_overlap",
    """select p_partkey as run_id, contains(lower(replace(p_name, ' ', '')), lower(replace(f, ' ', ''))) or contains(lower(replace(f, ' ', '')), lower(replace(p_name, ' ', ''))) as overlaps
    from (select *, case p_size % 3 when 0 then upper(split_part(p_name, ' ', 1)) when 1 then p_name || ' more' else 'nothing' end as f from part)""",
)
def locator_overlap(spark, folder):
    p = table(spark, folder, "part")
    failed = F.when(F.col("p_size") % 3 == 0, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" more"))).otherwise("nothing")
    runs = p.select(F.col("p_partkey").alias("run_id"), failed.alias("failed_locator"))
    offered = p.select(F.col("p_partkey").alias("run_id"), F.col("p_name").alias("locator"))
    return caches.locator_overlap(runs, offered).select("run_id", "overlaps")


# Lines as elements of their supplier's page: today's descriptors, and those that were
# stored when a third of the lines held another quantity and half had other refs.
REBIND_SQL = """
line as (select *, l_suppkey as snapshot_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as ref, cast(l_quantity as bigint) as q from lineitem),
now as (select snapshot_id, ref, l_linestatus as capability, l_linenumber as ordinal, l_orderkey % 2 as control_ordinal,
  l_returnflag as flag, cast(year(l_shipdate) as varchar) as year, cast(q as varchar) as quantity from line),
stored as (select ref as request_id, snapshot_id, case when l_orderkey % 2 = 0 then ref else 'gone' end as ref, l_linestatus as capability,
  l_linenumber as ordinal, l_orderkey % 2 as control_ordinal, case when l_partkey % 5 > 0 then l_returnflag else '' end as flag,
  cast(year(l_shipdate) as varchar) as year, cast(q + case when l_partkey % 3 = 0 then 1 else 0 end as varchar) as quantity from line),
pairs as (select request_id, s.ref, n.ref as found, n.ordinal = s.ordinal and n.control_ordinal = s.control_ordinal as near
  from stored s join now n using (snapshot_id, capability) where (s.flag = '' or s.flag = n.flag) and s.year = n.year and s.quantity = n.quantity),
per as (select request_id, bool_or(found = ref) as same, count(*) as n, min(found) as only_one, count(*) filter (near) as pn, min(found) filter (near) as placed from pairs group by 1)"""


@query(
    "rebind_targets",
    f"""with {REBIND_SQL} select request_id, case when same then ref when n = 1 then only_one when pn = 1 then placed end as rebound_ref,
      case when same then 'same' when n = 1 then 'descriptor' when pn = 1 then 'position' end as rebound_by from stored left join per using (request_id)""",
)
def rebind_targets(spark, folder):
    quantity = F.col("l_quantity").cast("long")
    place = (F.col("l_suppkey").alias("snapshot_id"), F.col("l_linestatus").alias("capability"), F.col("l_linenumber").alias("ordinal"), (F.col("l_orderkey") % 2).alias("control_ordinal"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    ref = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents.cast("string"))
    held = lambda flag, q: F.create_map(F.lit("flag"), flag, F.lit("year"), F.year("l_shipdate").cast("string"), F.lit("quantity"), q.cast("string")).alias("descriptor")
    line = table(spark, folder, "lineitem")
    now = line.select(*place, ref.alias("ref"), held(F.col("l_returnflag"), quantity))
    stored = line.select(
        ref.alias("request_id"),
        *place,
        F.when(F.col("l_orderkey") % 2 == 0, ref).otherwise("gone").alias("ref"),
        held(F.when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag")).otherwise(""), quantity + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)),
    )
    return caches.rebind_targets(stored, now).select("request_id", "rebound_ref", "rebound_by")

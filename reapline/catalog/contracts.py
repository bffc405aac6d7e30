"""Task wordings made from conversations, and the contracts they ask for."""

from pyspark.sql import functions as F

from reapline.catalog.registry import query, table
from reapline.functions.contract import compile_contracts

# Six kinds of task; {n} conversation, {m} amount, {p} pages, {r} rounds, {w} a word of the text.  Shared by both sides.
TASKS = (
    "从 https://shop{n}.test/list/{n} 抓取前{p}页商品的名称、价格和URL，每页{m}个，保存为csv",
    "从 https://q{n}.test 提取{m}条名言的正文、作者和标签。",
    "Scroll to load, at least {r} scrolls, until seeing \"End {w}\", extract {m} items title, save as jsonl",
    "提取{m}本书的书名，进入详情页抓取简介，等待动态内容",
    "在搜索框中输入“{w}”，提取前{p}页{m}行球队名称、年份、胜场和负场。",
    "不要使用搜索，字段为 title 和 url，提取{m}条，不要进入详情",
)
NAMES = "n m p r w".split()


def _sql_text(task: str) -> str:
    parts, out = task.split("{"), []
    out.append(parts[0])
    for part in parts[1:]:
        name, rest = part.split("}", 1)
        out += [None, name, rest]
    shown, k = ["'" + out[0].replace("'", "''") + "'"], 1
    while k < len(out):
        shown += [f"cast({out[k + 1]} as string)", "'" + out[k + 2].replace("'", "''") + "'"]
        k += 3
    return " || ".join(shown)


WORDING = f"case kind {' '.join(f'when {k} then {_sql_text(t)}' for k, t in enumerate(TASKS))} end"
INPUT_SQL = """
t as (select conv_id, turn, conv_id as n, 1 + (conv_id * 7 + turn) % 40 as m, 1 + conv_id % 4 as p, 1 + (conv_id + turn) % 60 as r,
  'w' || md5(coalesce(text, ''))[1:6] as w, (conv_id + turn) % 6 as kind from conversations)"""


def tasks(spark, folder):
    """One task per turn; its word is a digest of the turn's whole text."""
    c = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("conv_id").alias("n"), (1 + (F.col("conv_id") * 7 + F.col("turn")) % 40).alias("m"), (1 + F.col("conv_id") % 4).alias("p"),
        (1 + (F.col("conv_id") + F.col("turn")) % 60).alias("r"), F.concat(F.lit("w"), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 6)).alias("w"),
        ((F.col("conv_id") + F.col("turn")) % 6).alias("kind"))
    return c.select("conv_id", "turn", F.expr(WORDING).alias("task"))


@query(
    "task_contracts",
    f"""with {INPUT_SQL} select conv_id, turn, {WORDING} as task,
      case kind when 0 then 'https://shop' || n || '.test/list/' || n when 1 then 'https://q' || n || '.test/' else '' end as target_url,
      cast(case when kind in (0, 4) then p else 1 end as int) as target_pages,
      case kind when 0 then 'title,price,url' when 1 then 'text,author,tags' when 2 then 'title' when 3 then 'title,description,url' when 4 then 'team,year,wins,losses' else 'title,url' end as schema,
      case kind when 0 then 'title,price,url' when 1 then 'text,author,tags' when 2 then 'title' when 3 then 'title,url' when 4 then 'team,year,wins,losses' else 'title,url' end as list_schema,
      case kind when 3 then 'description' else '' end as detail_schema,
      cast(case kind when 0 then case when p > 1 then m * p else m end when 4 then case when p > 1 then m * p else m end else m end as int) as min_items,
      cast(m as int) as per_page_limit,
      case when kind = 2 then 'infinite_scroll' when kind in (0, 4) and p > 1 then 'pagination' else 'single_page' end as collection_mode,
      cast(case kind when 2 then least(r, 50) else 0 end as int) as max_scroll_rounds, cast(case kind when 2 then least(r, 50) else 0 end as int) as required_scroll_rounds,
      case kind when 4 then '搜索框=' || w else '' end as filters, kind = 3 as detail_required,
      case kind when 2 then 'End ' || w else '' end as until_text, case kind when 0 then 'csv' when 2 then 'jsonl' else '' end as output_format, kind = 3 as requires_javascript_wait,
      'navigate' || case kind when 4 then ',filter:0' else '' end || ',collect:' || case when kind = 2 then 'infinite_scroll' when kind in (0, 4) and p > 1 then 'pagination' else 'single_page' end
        || case kind when 3 then ',details' else '' end || case when kind in (0, 2) then ',export' else '' end || ',complete' as phases
    from t""",
)
def task_contracts(spark, folder):
    c = compile_contracts(tasks(spark, folder))
    joined = {f: F.array_join(f, ",") for f in ("schema", "list_schema", "detail_schema", "phases")}
    stated = F.array_join(F.transform("filters", lambda x: F.concat(x["field_hint"], F.lit("="), x["value"])), ",")
    return c.withColumns({**joined, "filters": stated}).select(
        "conv_id", "turn", "task", "target_url", "target_pages", "schema", "list_schema", "detail_schema", "min_items", "per_page_limit", "collection_mode",
        "max_scroll_rounds", "required_scroll_rounds", "filters", "detail_required", "until_text", "output_format", "requires_javascript_wait", "phases")

"""Task wording to extraction contract: every field is one native column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import any_of
from reapline.functions.url import path, stripped

# Words that ask for a field, in the order fields are listed.
FIELD_WORDS = (
    ("price", ("价格", "价钱", "price", "cost")),
    ("text", ("正文", "名言内容", "quote text")),
    ("author", ("作者", "author", "writer")),
    ("tags", ("标签", "tags", "tag")),
    ("year", ("年份", "年代", "year")),
    ("wins", ("胜场", "胜利场次", "wins", " win ")),
    ("losses", ("负场", "失败场次", "losses", " loss ")),
    ("description", ("简介", "描述", "description", "summary")),
    ("rating", ("评分", "得分", "rating", "score")),
    ("rank", ("排名", "名次", "rank", "ranking")),
    ("hot_value", ("热度", "热搜指数", "hot_value", "heat")),
    ("time", ("发布时间", "时间", "published_at", "time")),
    ("subtitle", ("副标题", "subtitle", "sub_title")),
    ("badge", ("徽标", "角标", "badge", "label")),
    ("url", ("url", "链接", "href", "link")),
)
TITLE_WORDS = ("标题", "书名", "名称", "title", "name")
COLLECT_WORDS = ("提取", "抓取", "爬取", "extract", "scrape", "collect")
SCROLL_WORDS = ("无限滚动", "持续向下滚动", "滚动加载", "下拉加载", "滚动到底", "infinite scroll", "scroll to load")
FILTER_WORDS = ("筛选", "过滤", "搜索", "filter", "search")
FILTER_HINTS = ("搜索框", "筛选框", "关键词", "关键字", "search")
NO_DETAIL = (
    "不要进入详情", "不进入详情", "无需进入详情", "不要打开详情", "不打开详情", "只提取详情链接",
    "仅提取详情链接", "只要详情链接", "do not open detail", "without opening detail",
)
DETAIL_PAGES = ("进入详情页", "打开详情页", "逐个详情", "详情信息", "详情内容", "detail page", "open each detail")
DETAIL_TEXT = ("简介", "描述", "正文", "description", "summary")
DETAIL_FIELDS = ("description", "text", "author", "tags")
TEAM_TASKS = ("球队", "team name", "team stats")
TEAM_WORDS = ("球队", "team")
QUOTE_TASKS = ("名言", "quote")
QUOTE_TEXT = ("正文", "内容", "text", "quote")
PRODUCT_TASKS = ("商品", "产品", "product")
TWO_PAGES = ("两页", "2页", "two pages")
DETAIL_NAMES = ("详情", "detail")
JAVASCRIPT_WORDS = ("javascript", "动态内容", "动态渲染", "js 渲染", "js-rendered")

# Patterns of counts, pages, rounds and clauses in task wording.
UNIT = r"(?:条|个|本|行|部|篇|首|道|则|项|款|items?|rows?|books?|products?|quotes?)"
URL = r"(?i)(https?://[^\s，。；;）)】\]>\"']+)"
NEGATION = r"(?:不|不要|无需|无须|禁止|避免|不得|勿|别)\s*"
PAGE_PATTERNS = (
    r"第\s*(\d+)\s*页",
    r"(?i)page\s*(\d+)",
    r"(?:前|连续(?:抓取|爬取|翻取)?|抓取|爬取|翻取|翻完|共|总共)\s*(\d+)\s*页",
    r"(?i)(?:first\s+)?(\d+)\s+pages?",
)
PER_PAGE = (
    rf"(?i)每\s*页[^\d]{{0,8}}(\d+)\s*{UNIT}",
    rf"(?i)(?:第\s*[一1]\s*页|当前\s*第?\s*[一1]\s*页)[^\d]{{0,16}}(\d+)\s*{UNIT}",
    rf"(?i)前\s*(\d+)\s*{UNIT}",
    rf"(?i)first\s+(\d+)\s*{UNIT}",
)
TOTAL = (
    rf"(?i)(?:合计|总计|总共)\s*(?:至少|不少于|约)?\s*(\d+)\s*{UNIT}",
    rf"(?i)(?:得到|获得|收集到|累计)\s*(?:至少|不少于)?\s*(\d+)\s*{UNIT}",
    rf"(?i)(?:at\s+least|total(?:ly)?)\s*(\d+)\s*{UNIT}",
)
MAX_SCROLL = (
    r"(?:最多|至多|不超过)?\s*滚动\s*(\d+)\s*(?:轮|次)",
    r"(?:最多|至多|不超过)?\s*(\d+)\s*(?:轮|次)\s*滚动",
    r"(?i)(?:max(?:imum)?\s*)?(\d+)\s*scrolls?",
)
MIN_SCROLL = (
    r"(?:至少|最少|不少于)\s*滚动\s*(\d+)\s*(?:轮|次)",
    r"(?:至少|最少|不少于)\s*(\d+)\s*(?:轮|次)\s*滚动",
    r"(?i)(?:at least\s*)?(\d+)\s*scrolls?",
)
NAMED_FILTER = (
    r"(?i)(?:在|再在|然后在)?([一-鿿A-Za-z0-9 _-]{1,24}?(?:框|输入框|search box|filter box))"
    r"(?:中|里)?\s*(?:输入|填写|键入|搜索|筛选|filter|type)[^“\"']{0,8}[“\"']([^”\"']+)[”\"']"
)
EXPLICIT_FIELDS = r"(?i)(?:字段(?:固定)?(?:为|包括)|fields?\s*(?:are|include|:))\s*([^。；;\n]+)"
# what exclusions and prohibitions mention is not a filter to apply
EXCLUSION = r"(?:排除|剔除|跳过|忽略)[^。；;\n]{0,160}"
NO_FILTER = (
    NEGATION + r"(?:使用|执行|进行|点击|打开|采用)?\s*(?:站内|页面内)?\s*(?:筛选|过滤|搜索)",
    r"(?i)(?:do\s+not|don't|without|never)\s+(?:use\s+)?(?:filter|search)",
)
QUOTED_FILTER = r"(?i)(?:筛选|过滤|搜索|filter|search)[^，。；;\n]{0,24}?[“\"']([^”\"']+)[”\"']"
UNQUOTED_FILTER = r"(?:关键词|关键字|包含|等于|为)\s*(?:是|：|:)?\s*([A-Za-z0-9_\-]{2,80})"
REFUSED_DETAIL = "(?i)" + NEGATION + r"(?:进入|打开|访问|抓取|采集)?[^，。；;\n]{0,12}?详情"
DETAIL_LINK = r"(?i)详情\s*(?:页)?\s*(?:链接|url)"
FORMATS = (
    ("csv", r"(?i)\bcsv\b|保存为\s*csv"),
    ("jsonl", r"(?i)\bjsonl\b|保存为\s*jsonl"),
    ("json", r"(?i)\bjson\b|保存为\s*json"),
)
UNTIL = (
    r"(?:直到|直至)(?:遇到|出现|包含|看到)?[^“\"']{0,12}[“\"']([^”\"']+)[”\"']",
    r"(?i)until(?:\s+(?:finding|seeing|containing))?\s+[\"']([^\"']+)[\"']",
)


def has(text: Column, words: Sequence[str]) -> Column:
    return F.lower(text).rlike(any_of([w.lower() for w in words]))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _first_int(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[_found(text, p).try_cast("int") for p in patterns])


def _all_ints(text: Column, pattern: str) -> Column:
    return F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int")),
        lambda x: x.isNotNull(),
    )


def schema_fields(task: Column) -> Column:
    """Ordered canonical fields a task asks for."""
    explicit = _found(task, EXPLICIT_FIELDS)
    text = F.coalesce(stripped(explicit), task)
    lead = (
        F.when(has(task, TEAM_TASKS) & has(text, TEAM_WORDS), "team")
        .when(has(task, QUOTE_TASKS) & has(text, QUOTE_TEXT), "text")
        .when(has(text, TITLE_WORDS) | (has(task, PRODUCT_TASKS) & explicit.isNull()), "title")
    )
    named = F.array_distinct(
        F.array_compact(F.array(lead, *[F.when(has(text, words), F.lit(f)) for f, words in FIELD_WORDS]))
    )
    default = F.when(has(text, COLLECT_WORDS), F.array(F.lit("title"), F.lit("url"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(F.size(named) > 0, named).otherwise(default)


def target_pages(task: Column) -> Column:
    pages = F.concat(*[_all_ints(task, p) for p in PAGE_PATTERNS])
    two = F.when(has(task, TWO_PAGES), F.lit(2))
    return F.coalesce(F.greatest(F.array_max(pages), two), F.lit(1))


def collection_mode(task: Column, pages: Column) -> Column:
    return F.when(has(task, SCROLL_WORDS), "infinite_scroll").when(pages > 1, "pagination").otherwise("single_page")


def scroll_rounds(task: Column, patterns: Sequence[str], default: int) -> Column:
    stated = F.coalesce(F.nullif(_first_int(task, patterns), F.lit(0)), F.lit(default))
    return F.greatest(F.lit(1), F.least(stated, F.lit(50)))


def filters(task: Column) -> Column:
    """array<struct> of inputs to fill before collecting, duplicates removed."""
    hints = F.regexp_extract_all(task, F.lit(NAMED_FILTER), F.lit(1))
    values = F.regexp_extract_all(task, F.lit(NAMED_FILTER), F.lit(2))
    named = F.filter(
        F.zip_with(hints, values, lambda h, v: F.struct(stripped(v).alias("value"), stripped(h).alias("field_hint"))),
        lambda x: x["value"] != "",
    )
    unique = F.filter(
        named,
        lambda x, i: ~F.exists(
            F.slice(named, F.lit(1), i),
            lambda o: (F.lower(o["value"]) == F.lower(x["value"])) & (F.lower(o["field_hint"]) == F.lower(x["field_hint"])),
        ),
    )
    # What URLs, exclusions and prohibitions mention is not a filter to apply.
    rest = task
    for pattern in (URL, EXCLUSION, *NO_FILTER):
        rest = F.regexp_replace(rest, pattern, "")
    quoted, unquoted = _found(rest, QUOTED_FILTER), _found(rest, UNQUOTED_FILTER)
    value = F.coalesce(F.nullif(stripped(quoted), F.lit("")), stripped(unquoted))
    hint = F.coalesce(
        *[F.when(F.contains(F.lower(rest), F.lit(h)), F.lit(h)) for h in FILTER_HINTS], F.lit("")
    )
    generic = F.when(
        has(rest, FILTER_WORDS) & value.isNotNull(), F.array(F.struct(value.alias("value"), hint.alias("field_hint")))
    )
    chosen = F.when(F.size(unique) > 0, unique).otherwise(F.coalesce(generic, F.slice(named, 1, 0)))
    return F.transform(
        chosen,
        lambda x: F.struct(
            F.lit("text").alias("kind"), x["value"].alias("value"), x["field_hint"].alias("field_hint"),
            F.lit(True).alias("submit"),
        ),
    )


def detail_required(task: Column) -> Column:
    refused = task.rlike(REFUSED_DETAIL) | has(task, NO_DETAIL)
    rest = F.regexp_replace(task, DETAIL_LINK, "")
    return ~refused & (has(rest, DETAIL_PAGES) | (has(rest, DETAIL_NAMES) & has(rest, DETAIL_TEXT)))


def target_url(task: Column) -> Column:
    url = F.regexp_replace(F.regexp_extract(task, URL, 1), r"[/,]+$", "")
    return F.when((url != "") & (path(url) == ""), F.concat(url, F.lit("/"))).otherwise(url)


def until_text(task: Column) -> Column:
    return F.coalesce(*[stripped(_found(task, p)) for p in UNTIL], F.lit(""))


def output_format(task: Column) -> Column:
    return F.coalesce(*[F.when(task.rlike(pattern), F.lit(name)) for name, pattern in FORMATS], F.lit(""))


def compile_contracts(tasks: DataFrame, task_col: str = "task") -> DataFrame:
    """Add the contract of every task: one narrow projection, no shuffle."""
    t = stripped(F.coalesce(F.col(task_col), F.lit("")))
    df = tasks.withColumns(
        {
            "target_url": target_url(t),
            "target_pages": target_pages(t),
            "_asked": schema_fields(t),
            "detail_required": detail_required(t),
            "filters": filters(t),
            "until_text": until_text(t),
            "output_format": output_format(t),
            "requires_javascript_wait": has(t, JAVASCRIPT_WORDS),
            "_per_page": _first_int(t, PER_PAGE),
            "_total": _first_int(t, TOTAL),
            "_amounts": _all_ints(t, rf"(?i)(\d+)\s*{UNIT}"),
        }
    )
    pages, detail, asked = F.col("target_pages"), F.col("detail_required"), F.col("_asked")
    first_amount, last_amount = F.get("_amounts", F.lit(0)), F.get(F.reverse("_amounts"), F.lit(0))
    per_page = F.coalesce("_per_page", first_amount)
    total = F.coalesce(
        "_total",
        F.when((pages > 1) & (per_page > 0), per_page * pages),
        last_amount,
        F.lit(1),
    )
    basic = F.array(F.lit("title"), F.lit("url"))
    nothing = F.array().cast("array<string>")
    listed = F.filter(asked, lambda f: ~(detail & f.isin(*DETAIL_FIELDS)))
    df = df.withColumns(
        {
            "schema": F.when(detail, F.array_distinct(F.concat(asked, basic))).otherwise(asked),
            "list_schema": F.when(detail, F.array_distinct(F.concat(listed, basic))).otherwise(listed),
            "detail_schema": F.when(detail, F.filter(asked, lambda f: f.isin(*DETAIL_FIELDS))).otherwise(nothing),
            "min_items": total,
            "max_items": total,
            "per_page_limit": F.coalesce(
                per_page, F.greatest(F.lit(1), F.ceil(total / F.greatest(pages, F.lit(1))).cast("int"))
            ),
            "collection_mode": collection_mode(t, pages),
        }
    )
    scrolling = F.col("collection_mode") == "infinite_scroll"
    df = df.withColumns(
        {
            "max_scroll_rounds": F.when(scrolling, scroll_rounds(t, MAX_SCROLL, 6)).otherwise(0),
            "required_scroll_rounds": F.when(scrolling, scroll_rounds(t, MIN_SCROLL, 1)).otherwise(0),
            "max_stagnant_rounds": F.lit(2),
            "phases": F.array_compact(
                F.concat(
                    F.array(F.lit("navigate")),
                    F.transform("filters", lambda _, i: F.concat(F.lit("filter:"), i.cast("string"))),
                    F.array(
                        F.concat(F.lit("collect:"), F.col("collection_mode")),
                        F.when(detail, F.lit("details")),
                        F.when(F.col("output_format") != "", F.lit("export")),
                        F.lit("complete"),
                    ),
                )
            ),
        }
    )
    return df.withColumns(
        {
            "stop_conditions": F.struct(
                "min_items", "max_items", "target_pages", "max_scroll_rounds", "max_stagnant_rounds", "until_text",
                F.lit(True).alias("stop_when_exhausted"),
            ),
            "obligations": F.struct(
                F.lit(False).alias("open_target"),
                F.size("filters").alias("filters"),
                F.col("target_pages").alias("pagination_pages"),
                F.col("required_scroll_rounds").alias("scroll_rounds"),
                F.col("detail_required").alias("details"),
            ),
        }
    ).drop("_asked", "_per_page", "_total", "_amounts")

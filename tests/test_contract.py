"""Task wording to contract, and contract evaluation on literal records."""

import pytest
from pyspark.sql import functions as F

from reapline.functions.contract import compile_contracts
from reapline.operators import progress, quality


def compiled(spark, task):
    return compile_contracts(spark.createDataFrame([(task,)], "task string")).first()


def test_quotes_task(spark):
    row = compiled(spark, "从 https://example.test 提取2条名言的正文、作者和标签。")
    assert row["schema"] == ["text", "author", "tags"]
    assert (row.min_items, row.per_page_limit, row.target_url, row.collection_mode) == (2, 2, "https://example.test/", "single_page")


def test_pages_multiply_items(spark):
    row = compiled(spark, "抓取前3页商品的名称、价格和URL，每页10个，保存为csv")
    assert row["schema"] == ["title", "price", "url"]
    assert (row.target_pages, row.min_items, row.max_items, row.collection_mode, row.output_format) == (3, 30, 30, "pagination", "csv")
    assert row.phases == ["navigate", "collect:pagination", "export", "complete"]


def test_filter_and_team_table(spark):
    row = compiled(spark, "在搜索框中输入“Boston”，提取前2页25行球队名称、年份、胜场和负场。")
    assert row["schema"] == ["team", "year", "wins", "losses"]
    assert [(f.value, f.field_hint) for f in row.filters] == [("Boston", "搜索框")]
    assert row.obligations.filters == 1 and row.obligations.pagination_pages == 2


def test_prohibited_search_is_no_filter(spark):
    row = compiled(spark, "不要使用搜索，字段为 title 和 url，提取10条")
    assert row.filters == []
    assert row["schema"] == ["title", "url"]


def test_details(spark):
    row = compiled(spark, "提取5本书的书名，进入详情页抓取简介")
    assert row.detail_required is True
    assert row.detail_schema == ["description"]
    assert row.list_schema == ["title", "url"]
    assert compiled(spark, "提取5本书的书名和详情链接，不要进入详情").detail_required is False


def test_scroll_until(spark):
    row = compiled(spark, 'Scroll to load, at least 3 scrolls, until seeing "End", extract 20 items title')
    assert (row.collection_mode, row.required_scroll_rounds, row.until_text) == ("infinite_scroll", 3, "End")
    assert row.stop_conditions.until_text == "End"


ITEMS = "run_id string, page_number int, pos int, fields map<string,string>, tags array<string>"
CONTRACTS = "run_id string, schema array<string>, min_items int"


def evaluate(spark, items, contract):
    return quality.evaluate_contract(spark.createDataFrame(items, ITEMS), spark.createDataFrame([contract], CONTRACTS)).first()


def test_invalid_urls_are_covered_but_not_valid(spark):
    row = evaluate(
        spark, [("r", 1, 1, {"title": "A", "url": "javascript:alert(1)"}, None), ("r", 1, 2, {"title": "B", "url": "not-a-url"}, None)],
        ("r", ["title", "url"], 2),
    )
    assert row.field_coverage["url"] == 1.0
    assert row.field_validity["url"] == 0.0
    assert row.is_success is False
    assert row.summary == "invalid required field values"


def test_pages_merge_by_url(spark):
    rows = [("r", p, i, {"title": n, "url": f"https://x.test/{n}"}, None) for i, (p, n) in enumerate([(1, "A"), (1, "B"), (2, "B"), (2, "C"), (2, "D")])]
    row = evaluate(spark, rows, ("r", ["title", "url"], 4))
    assert (row.item_count, row.is_success) == (4, True)


def test_detail_merge_keeps_position_and_adds_fields(spark):
    items = spark.createDataFrame(
        [
            ("r", 1, 1, {"title": "A", "url": "https://x/a/", "note": "first"}, None),
            ("r", 1, 2, {"title": "B", "url": "https://x/b"}, None),
            ("r", 2, 1, {"url": "https://x/a", "description": "long", "note": " "}, ["t"]),
        ],
        ITEMS,
    )
    rows = sorted(quality.merge_items(items).collect(), key=lambda r: r.first_pos)
    assert [r.identity for r in rows] == ["https://x/a", "https://x/b"]
    assert rows[0].fields == {"title": "A", "url": "https://x/a", "description": "long", "note": "first"}
    assert rows[0].tags == ["t"]
    assert rows[0].first_pos.page_number == 1


def test_tags_column_counts_as_field(spark):
    row = evaluate(spark, [("r", 1, 1, {"text": "q", "author": "a"}, ["x"])], ("r", ["text", "author", "tags"], 1))
    assert row.is_success is True


def test_run_without_records_fails(spark):
    row = evaluate(spark, [("other", 1, 1, {"title": "x"}, None)], ("r", ["title"], 2))
    assert (row.item_count, row.is_success) == (0, False)
    assert row.summary.startswith("item count 0/2")


def test_item_quality(spark):
    schema = F.array(F.lit("title"), F.lit("price"))
    row = spark.createDataFrame([({"title": "https://movie.example/123/", "price": "3.50"},)], "fields map<string,string>").select(
        quality.item_quality("fields", schema).alias("q")
    ).first().q
    assert row.valid_fields == {"title": False, "price": True}
    assert [(i.field, i.reason) for i in row.issues] == [("title", "missing_or_invalid")]


def test_provenance(spark):
    df = spark.createDataFrame(
        [(True, "extract", ["title"], {"title": "A"}, "https://x/products?page=2", "https://x/", "snap-7", "", "")],
        "ok boolean, action string, schema array<string>, fields map<string,string>, page_url string, current_url string, snapshot_id string, content_hash string, index_file string",
    )
    row = quality.annotate_provenance(df, F.lit("2026-01-01T00:00:00")).first()
    assert row.provenance.asDict() == {
        "source_url": "https://x/products?page=2", "snapshot_id": "snap-7", "action": "extract", "captured_at": "2026-01-01T00:00:00",
    }
    assert row.quality.issues == []


def test_flatten_items_layers(spark):
    df = spark.sql(
        "select true as ok, 1 as run_id, array(named_struct('fields', map('title', 'T'), 'list_info', map('title', 'L', 'url', 'u'), 'detail_info', map('url', 'd'))) as items"
    )
    row = quality.flatten_items(df, ["run_id"]).first()
    assert row.fields == {"url": "d", "title": "T"}


def test_delivery_fields(spark):
    m = F.create_map(F.lit("title"), F.lit("A"), F.lit("_quality"), F.lit("x"), F.lit("source_url"), F.lit(""))
    row = spark.range(1).select(quality.delivery_fields(m, F.lit("https://s"), F.lit("now")).alias("f")).first()
    assert row.f == {"title": "A", "source_url": "https://s", "captured_at": "now"}


@pytest.mark.parametrize(("goal", "required", "wanted"), [("逐条看简介", False, True), ("只提取详情链接", False, False), ("详情链接", False, False), ("list", True, True)])
def test_wants_details(spark, goal, required, wanted):
    assert spark.range(1).select(quality.wants_details(F.lit(goal), F.lit(required)).alias("w")).first().w is wanted


def test_few_cases_are_shipped_to_their_records(spark):
    from reapline.catalog import quality as catalog

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (catalog.relevant_items, catalog.valid_records):
            plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def planned(df):
    """The optimised physical plan before it runs, as text."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_merged_fields_are_columns_of_one_aggregation(spark):
    items = spark.createDataFrame([("r", 1, 1, {"title": "A", "url": "https://x/a"}, None)], ITEMS)
    plan = planned(quality.merge_items(items))
    assert "Generate" not in plan
    assert plan.count("max_by") > 0 and plan.count("Aggregate(") == 2  # partial and final


def test_many_field_names_merge_like_few(spark, monkeypatch):
    rows = [
        ("r", 1, 1, {"Title ": "A", "title": " ", "URL": "https://x/a//", "note": "first"}, ["t"]),
        ("r", 1, 2, {"title": "B", "url": "https://x/a", "note": " ", "Note": "kept"}, []),
        ("r", 2, 1, {"url": None, "b": "2", "a": "1"}, None),
        ("r", 2, 2, {"a": "1", "b": "2", "url": None}, ["u"]),
        ("s", 1, 1, {}, None),
        ("s", 1, 2, None, None),
    ]
    items = spark.createDataFrame(rows, ITEMS)
    by_column = sorted(map(str, quality.merge_items(items).collect()))
    monkeypatch.setattr(quality, "COLUMN_NAMES", 2)
    assert by_column == sorted(map(str, quality.merge_items(items).select("run_id", "identity", "fields", "first_pos", "tags").collect()))
    merged = {r.identity: r for r in quality.merge_items(items).collect()}
    assert merged["https://x/a"].fields == {"Title ": "A", "title": "B", "URL": "https://x/a//", "url": "https://x/a", "note": "first", "Note": "kept"}
    assert merged["https://x/a"].tags == ["t"] and len(merged) == 3


def test_records_are_merged_once_for_counts_and_ratios(spark):
    items = spark.createDataFrame([("r", 1, 1, {"title": "A", "url": "https://x/a"}, None)], ITEMS)
    contracts = spark.createDataFrame([("r", ["title", "title"], 1)], CONTRACTS)
    evaluated = quality.evaluate_contract(items, contracts)
    assert planned(evaluated).count("partial_max_by") > 0
    assert sum("partial_max_by" in line or "identity" in line and "partial" in line for line in planned(evaluated).splitlines()) == 1
    row = evaluated.first()
    assert (row.item_count, row.is_success, row.field_coverage) == (1, True, {"title": 1.0})


@pytest.mark.parametrize("schema", [[], None])
def test_records_count_without_a_schema(spark, schema):
    row = evaluate(spark, [("r", 1, 1, {"a": "1"}, None), ("r", 1, 2, {"a": "2"}, None)], ("r", schema, 2))
    assert (row.item_count, row.count_ok, row.fields_ok, row.field_coverage) == (2, True, False, None)


def test_fallback_takes_few_rows_of_a_page_to_the_exchange(spark):
    rows = lambda page, *titles: [(page, i, {"title": t}) for i, t in enumerate(titles)]
    records = "page_id int, pos int, fields map<string,string>"
    primary = spark.createDataFrame(rows(1, "https://x", "b") + rows(2, "c") + rows(3, "https://x") + rows(4, "https://y"), records)
    fallback = spark.createDataFrame(rows(1, "d", "e", "f", "g") + rows(2, "h") + rows(3, "i", "j") + rows(4, "https://z"), records)
    contracts = spark.createDataFrame([(1, ["title"], 3), (2, ["title"], 1), (3, ["title"], None), (4, ["title"], 1)], "page_id int, schema array<string>, min_items int")
    out = quality.fallback_if_failing(primary, fallback, contracts)
    got = sorted((r.page_id, r.pos, r.fields["title"], r.record_source) for r in out.collect())
    assert got == [
        (1, 0, "d", "fallback"), (1, 1, "e", "fallback"), (1, 2, "f", "fallback"), (2, 0, "c", "primary"), (3, 0, "i", "fallback"),
        (4, 0, "https://y", "primary"),
    ]
    assert "WindowGroupLimit" in planned(out) and "max_by" not in planned(out)  # both evaluations ran before, once


def test_progress_joins_the_last_event_of_a_page(spark):
    events = spark.createDataFrame(
        [("r", 1, "open", None), ("r", 2, "collect", 1), ("r", 3, "collect", 2), ("r", 4, "filter", 1), ("r", 5, "collect", 2), ("r", 6, "collect", 3),
         ("r", 7, "scroll", 2), ("r", 8, "scroll", 1), ("s", 1, "collect", 1), ("s", 2, "collect", 1)],
        "run_id string, ord int, kind string, number int",
    )
    items = spark.createDataFrame([("r", 1, 1, {"title": "The End"}), ("s", 1, 1, {"title": "A"})], "run_id string, page_number int, pos int, fields map<string,string>")
    contracts = spark.createDataFrame(
        [("r", ["title"], 5, 2, " END ", 1, 2, False, True), ("s", ["title"], 1, 1, "", 0, 0, True, True)],
        CONTRACTS + ", target_pages int, until_text string, filters int, scroll_rounds int, details boolean, open_target boolean",
    )
    out = progress.progress_summary(events, items, contracts)
    r, s = sorted(out.collect(), key=lambda x: x.run_id)
    assert (r.completed_pages, r.stop_condition_met, r.unmet, r.is_done, r.item_count) == (2, True, [], True, 1)
    assert (s.completed_pages, s.list_complete, s.unmet, s.stop_reason) == (1, True, ["open_target", "details"], "contract_satisfied")
    assert planned(out).count("partial_max(ord") >= 2  # events by page and their last filter

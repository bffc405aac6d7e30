"""HTML, repeated structure, snapshots and record rules."""

import json

from pyspark.sql import functions as F

from reapline.operators import features, groups, html, matching, snapshots, structured

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a="<p>";</script></head><body>
<nav id="top"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li><li><a href="/c">C</a></li></ul></nav>
<div class="box"><p>One<p>Two <b>bold</b></div><span></span><br><div></div>
<table><tr><td>1<td>2<tr><td>3</table></body></html>"""


def nodes_of(spark, *pages):
    return html.html_to_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_tree_rules(spark):
    rows = sorted(nodes_of(spark, PAGE).collect(), key=lambda r: r.ord)
    assert [r.tag for r in rows] == ["body", "nav", "ul", "li", "a", "li", "a", "li", "a", "div", "p", "p", "b", "div", "table", "tr", "td", "td", "tr", "td"]
    by = {(r.tag, r.txt): r for r in rows}
    assert by[("a", "B")].xpath == '//*[@id="top"]/ul[1]/li[2]/a[1]'
    assert by[("a", "B")].attrs == {"href": "/b"}
    assert by[("p", "Two")].xpath == "/html/body/div[1]/p[2]"
    assert by[("td", "3")].xpath == "/html/body/table[1]/tr[2]/td[1]"
    assert len(by[("a", "B")].ancestors) == 4


def test_long_text_links_and_utility_classes(spark):
    css = " ".join(["u-1", "u-2", "u-3", "u-4", "u-5", "u-6", "nav-btn-primary-large-width"])
    row = nodes_of(spark, f'<body><a class="{css}" href="{"h" * 120}">{"t" * 300}</a></body>').where("tag = 'a'").first()
    assert row["class"] == "nav-btn-primary-large-width"
    assert row.attrs["href"] == "h" * 120
    assert row.txt == "t" * 300


def test_any_depth_and_hidden_elements(spark):
    deep = "<div>" * 1500 + "<b>core</b>" + "</div>" * 1500
    unseen = '<p style="color:red; display: none">a</p><p hidden>b</p><i aria-hidden="true">c</i><div aria-hidden="true">d</div><input type="hidden" name="n" hidden>'
    rows = nodes_of(spark, f"<body>{deep}{unseen}</body>").collect()
    assert [r.depth for r in rows if r.txt == "core"] == [1501]
    assert [r.txt for r in rows if r.txt in ("a", "b", "c", "d")] == ["d"]
    assert [r.attrs["name"] for r in rows if r.tag == "input"] == ["n"]


def test_sample_children(spark):
    page = "<body><ul>" + "".join(f"<li>i{i}<b>x</b></li>" for i in range(20)) + "</ul></body>"
    out = html.sample_children(nodes_of(spark, page)).collect()
    kept = sorted(r.txt for r in out if r.tag == "li")
    assert kept == sorted([f"i{i}" for i in (*range(10), 18, 19)])
    assert [r.skipped for r in out if r.tag == "skipped"] == [8]
    assert sum(r.tag == "b" for r in out) == 12


def test_consecutive_siblings_only(spark):
    page = "<body><p>1</p><p>2</p><h2>x</h2><p>3</p><p>4</p><p>5</p></body>"
    out = groups.compress_siblings(nodes_of(spark, page))
    table = groups.group_columns(out).collect()
    assert [(r.tag, r["count"], r.text, r["index"], r.xpath_template) for r in table] == [("p", 3, ["3", "4", "5"], [3, 4, 5], "/html/body/p[{i}]")]
    shown = groups.compressed_view(out)
    assert shown.where("tag = 'p'").count() == 3


def test_parents_compare_by_compressed_children(spark):
    item = lambda n: "<div>" + "<p>x</p>" * n + "</div>"
    out = groups.compress_siblings(nodes_of(spark, "<body>" + item(3) + item(5) + item(4) + "</body>"))
    outer = out.where("tag = 'div'").select("run_role", "run_size").collect()
    assert sorted(r.run_role for r in outer) == ["first", "member", "member"]
    assert {r.run_size for r in outer} == {3}


def test_runs_at_any_depth(spark):
    unlike = "<div><b>x</b></div><div><i>y</i></div><div><u>z</u></div>"  # at level 50
    page = "<body>" + "<div>" * 49 + unlike + "<div>" * 10 + "<p>1</p><p>2</p><p>3</p>" + "</div>" * 59 + "</body>"
    nodes = nodes_of(spark, page)
    out = groups.compress_siblings(nodes).cache()
    assert out.count() == nodes.count()
    assert {r.depth for r in out.where("tag = 'p'").collect()} == {60}
    assert [(r.tag, r["count"], r.text) for r in groups.group_columns(out).collect()] == [("p", 3, ["1", "2", "3"])]
    assert {r.run_role for r in out.where("depth = 50").collect()} == {"single"}


def test_parser_marks_runs_like_node_tables(spark):
    deep = "<div>" * 60 + "<p>1</p><p>2</p><p>3</p>" + "</div>" * 60
    same = "<ul>" + '<li class="x"><a href="/a">A</a></li>' * 4 + "<li>B</li></ul>"
    kinds = "<form>" + '<input type="text" name="a">' * 3 + '<input type="radio" name="b">' + "</form>"
    pages = [PAGE, f"<body>{deep}{same}{kinds}</body>", "<body>" + same * 5 + "</body>", "", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    fast = html.html_to_compressed(df).cache()
    slow = groups.compress_siblings(html.html_to_nodes(df)).cache()
    columns = ["page_id", "ref", "hash", "run_no", "run_size", "run_role", "hidden"]
    rows = lambda table: sorted(tuple(r) for r in table.select(*columns).collect())
    assert rows(fast) == rows(slow)
    texts = lambda table: sorted((r.page_id, r.ref, r.text) for r in table.collect() if r.text)
    assert texts(fast) == texts(html.deep_text(html.html_to_nodes(df)))
    assert groups.group_columns(fast).orderBy("page_id", "parent_ref", "run_no").collect() == (
        groups.group_columns(slow).orderBy("page_id", "parent_ref", "run_no").collect()
    )
    below = lambda r: any((r.page_id, a) in members for a in [*r.ancestors, r.ref])
    members = {(r.page_id, r.ref) for r in fast.collect() if r.run_role == "member"}
    assert {(r.page_id, r.ref) for r in fast.collect() if not below(r)} == {(r.page_id, r.ref) for r in groups.compressed_view(fast).collect()}
    hashes = {(r.page_id, r.ref): r.hash for r in fast.collect()}
    plain = {(r.page_id, r.ref): r.hash for r in groups.structural_hash(html.html_to_nodes(df)).where("tag in ('a', 'p', 'input')").collect()}
    assert all(hashes[k] == v for k, v in plain.items())


def test_left_out_children_end_a_run(spark):
    page = "<body><ul>" + "".join(f"<li>i{i}</li>" for i in range(20)) + "</ul></body>"
    out = groups.compress_siblings(html.sample_children(nodes_of(spark, page)), 2).where("parent_ref = 'r2'").orderBy("pos").collect()
    assert [(r.run_no, r.run_size) for r in out] == [(1, 10)] * 10 + [(2, 1)] + [(3, 2)] * 2
    assert [r.hidden for r in out] == [False] + [True] * 9 + [False, False, True]


def test_expansion_restores_members(spark):
    out = groups.compress_siblings(nodes_of(spark, PAGE))
    assert out.count() == nodes_of(spark, PAGE).count()


def test_deep_text(spark):
    rows = {r.tag: r.text for r in html.deep_text(nodes_of(spark, PAGE)).where("tag in ('nav', 'table')").collect()}
    assert rows == {"nav": "A", "table": "1"}


def test_decode_body(spark):
    df = spark.createDataFrame([(bytearray("影片名单".encode("gb18030")),), (bytearray("影片".encode()),), (None,)], "b binary")
    assert [r.t for r in df.select(html.decode_body("b").alias("t")).collect()] == ["影片名单", "影片", None]


NODE = "snapshot_id string, ref string, tag string, role string, text string, name string, ord int"


def snap(spark, rows):
    return spark.createDataFrame([("s", r[0], r[1], r[2], r[3], "", i) for i, r in enumerate(rows)], NODE)


def test_quote_blocks(spark):
    rows = [
        ("r10", "div", "", "“First quote.” by One"), ("r11", "span", "", "“First quote.”"), ("r12", "span", "", "by One (about)"),
        ("r13", "small", "", "One"), ("r14", "div", "", "Tags: alpha beta"), ("r15", "div", "", "“Second quote.” by Two"),
        ("r16", "span", "", "“Second quote.”"), ("r17", "span", "", "by Two (about)"), ("r18", "small", "", "Two"), ("r19", "div", "", "Tags: gamma"),
    ]
    got = sorted(snapshots.quote_blocks(snap(spark, rows), 2).collect(), key=lambda r: r.item_no)
    assert len(got) == 2
    assert (got[0].author, got[0].text) == ("One", "“First quote.”")
    assert got[1].tags == ["gamma"]


def test_quotes_from_one_text(spark):
    text = "“Q1” by A (about) Tags: x y “Q2” by B (about) Tags: z Next"
    got = sorted(snapshots.quote_blocks(snap(spark, [("r1", "div", "", text)]), 2).collect(), key=lambda r: r.item_no)
    assert [(r.text, r.author, r.tags) for r in got] == [("“Q1”", "A", ["x", "y"]), ("“Q2”", "B", ["z"])]


def test_table_rows(spark):
    rows = [
        ("r38", "tr", "row", "headers"), ("r39", "th", "", "Team Name"), ("r48", "tr", "row", "Boston 1990 44 24"), ("r49", "td", "", "Boston Bruins"),
        ("r50", "td", "", "1990"), ("r51", "td", "", "44"), ("r52", "td", "", "24"), ("r58", "tr", "row", "x"), ("r59", "td", "", "Buffalo Sabres"),
        ("r60", "td", "", "1990"), ("r61", "td", "", "31"), ("r62", "td", "", "30"),
    ]
    got = sorted(snapshots.table_rows(snap(spark, rows), 2).collect(), key=lambda r: r.item_no)
    assert got[0].team == "Boston Bruins"
    assert got[1].losses == "30"


def test_table_rows_read_one_order(spark):
    rows = [
        ("r1", "td", "", "before any row"), ("r2", "tr", "row", "a"), ("r3", "td", "", "short"), ("r4", "td", "", "1990"), ("r5", "td", "", "1"),
        ("r6", "tr", "row", "b"), ("r7", "td", "", "Team"), ("r8", "p", "", "between"), ("r9", "td", "", " "), ("r10", "td", "", "1991"), ("r11", "td", "", "2"),
        ("r12", "td", "", "3"), ("r13", "td", "", "fifth"), ("r14", "tr", "row", "c"), ("r15", "tr", "", "no row"), ("r16", "td", "", "Other"),
        ("r17", "td", "", "199"), ("r18", "td", "", "4"), ("r19", "td", "", "5"), ("r20", "tr", "row", "d"), ("r21", "td", "", "Last"), ("r22", "td", "", "2001"),
        ("r23", "td", "", "6"), ("r24", "td", "", "7"),
    ]
    out = snapshots.table_rows(snap(spark, rows))
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.item_no, r.team, r.year, r.wins, r.losses) for r in out.collect()) == [(1, "Team", "1991", "2", "3"), (2, "Last", "2001", "6", "7")]


def test_long_snapshots_lose_no_record(spark, tmp_path):
    from reapline.catalog import pages

    lines = spark.range(1, 1501).select(
        F.lit(7).cast("long").alias("l_orderkey"), F.col("id").alias("l_linenumber"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"),
        F.lit("1996-01-02").cast("date").alias("l_shipdate"), F.lit(3.0).alias("l_quantity"),
    )
    turns = spark.range(150).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("some answer").alias("text"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.item_no for r in pages.table_rows(spark, str(tmp_path)).orderBy("item_no").collect()] == list(range(1, 1501))
    quotes = pages.quote_blocks(spark, str(tmp_path)).orderBy("item_no").collect()
    assert [(r.item_no, r.author) for r in quotes] == [(i + 1, f"Author {i}") for i in range(150)]


def test_enrich_products(spark):
    rows = [
        ("r20", "h3", "", "Product One"), ("r21", "p", "", "Description"), ("r22", "div", "", "24.99"), ("r30", "h3", "", "Product Two"), ("r31", "div", "", "4.99"),
    ]
    items = spark.createDataFrame(
        [("s", 1, {"title": "Product One", "url": "https://example.test/1"}), ("s", 2, {"title": "Product Two", "url": "https://example.test/2"})],
        "snapshot_id string, pos int, fields map<string,string>",
    )
    contracts = spark.createDataFrame([("s", ["title", "price", "url"], 2)], "snapshot_id string, schema array<string>, min_items int")
    got = sorted(snapshots.enrich_records(snap(spark, rows), items, contracts, 2).collect(), key=lambda r: r.pos)
    assert [r.fields["price"] for r in got] == ["24.99", "4.99"]
    assert {r.record_source for r in got} == {"price_by_title"}


def test_good_records_stay(spark):
    items = spark.createDataFrame([("s", 1, {"title": "A", "url": "https://e.t/1"})], "snapshot_id string, pos int, fields map<string,string>")
    contracts = spark.createDataFrame([("s", ["title", "url"], 1)], "snapshot_id string, schema array<string>, min_items int")
    got = snapshots.enrich_records(snap(spark, [("r1", "p", "", "x")]), items, contracts, 1).collect()
    assert [r.record_source for r in got] == ["original"]


def test_json_ld(spark):
    graph = {"@graph": [{"name": "Book A", "url": "https://x/a", "offers": {"price": "12.50"}, "author": [{"name": "N"}, "M"]}, [{"headline": "Nested", "keywords": "k"}]]}
    page = f"<script type='application/ld+json'>{json.dumps(graph)}</script><script type=\"application/ld+json\">broken</script>"
    df = spark.createDataFrame([(1, "https://x/", page)], "page_id long, url string, html string")
    got = {r.title: r for r in structured.json_ld_items(df, ["title", "url", "price", "author", "tags"]).collect()}
    assert got["Book A"].price == "12.50"
    assert got["Book A"].author == "N, M"
    assert got["Nested"].url == "https://x/"
    assert got["Nested"].tags == ["k"]


def test_json_ld_opens_lists_of_any_depth(spark):
    deep = {"name": "deep [x \" ]"}
    for i in range(40):
        deep = [deep] if i % 2 else {"@graph": [deep, {"name": f"n{i}"}]}
    pages = [(1, "u", f"<script type='application/ld+json'>{json.dumps(x)}</script>") for x in (deep, {"name": "flat"}, [], "text", [[{"name": "two"}], {"name": "one"}])]
    df = spark.createDataFrame([(i, *p[1:]) for i, p in enumerate(pages)] + [(9, "u", None), (10, "u", "")], "page_id long, url string, html string")
    found = structured.json_ld_objects(df).selectExpr("page_id", "place", "variant_get(v, '$.name', 'string') as name").collect()
    assert sorted((r.page_id, r.name) for r in found) == sorted(
        [(0, "deep [x \" ]"), *((0, f"n{i}") for i in range(0, 40, 2)), (1, "flat"), (4, "one"), (4, "two")]
    )
    assert len({(r.page_id, *r.place) for r in found}) == len(found)


FULL = (
    "snapshot_id string, ref string, ref_type string, tag string, role string, name string, text string, placeholder string, label string, input_type string, "
    "value string, href string, parent_ref string, xpath string, interactable_now boolean, in_viewport boolean, ord int, ancestors array<string>"
)


def full(spark, rows):
    out = []
    for i, r in enumerate(rows):
        base = {"snapshot_id": "s", "ref_type": "element", "tag": "a", "role": "link", "name": "", "text": "", "placeholder": "", "label": "", "input_type": "",
                "value": "", "href": "", "parent_ref": "r1", "xpath": "", "interactable_now": True, "in_viewport": True, "ord": i, "ancestors": ["r1"]}
        out.append({**base, **r})
    return spark.createDataFrame(out, FULL)


def test_merge_nodes_first_value_wins(spark):
    a = full(spark, [{"ref": "e1", "text": "", "name": "n1", "ref_type": ""}])
    b = full(spark, [{"ref": "e1", "text": "t2", "name": "n2", "ref_type": ""}])
    row = snapshots.merge_nodes([a, b]).first()
    assert (row.text, row.name, row.ref_type) == ("t2", "n1", "element")


def test_sibling_groups_and_expansion(spark):
    nodes = full(spark, [{"ref": f"e{i}", "text": f"t{i}", "href": f"/{i}"} for i in (3, 5, 9)] + [{"ref": "e20", "tag": "button", "role": "button"}])
    g = snapshots.sibling_groups(nodes).first()
    assert (g["count"], g.refs, g["index"], g.available_actions) == (3, ["e3", "e5", "e9"], [3, 5, 9], ["list-items", "click"])
    assert [r.ref for r in snapshots.ungrouped_nodes(nodes, snapshots.sibling_groups(nodes)).collect()] == ["e20"]
    assert snapshots.expand_group(snapshots.sibling_groups(nodes), nodes, 2).count() == 2


def test_references_without_semicolon_stay_text(spark, tmp_path):
    from reapline.catalog.pages import text_index

    page = "<html><body><h1>cut&amp;&amp</h1><p>both &copy; R&D a&amp;amp &quot;x1&#33;</p></body></html>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.token for r in text_index(spark, str(tmp_path)).collect()} == {"cut&&amp", "both", "r&d", "a&amp", "x1"}


def test_find_text_prefers_tokens(spark):
    nodes = full(spark, [{"ref": "e1", "text": "Sign in"}, {"ref": "e2", "text": "Signature"}])
    req = spark.createDataFrame([(1, "s", "sign"), (2, "s", "gnatu")], "request_id int, snapshot_id string, text string")
    got = {(r.request_id, r.ref, r.match_kind) for r in snapshots.find_text(snapshots.text_index(nodes), nodes, req).collect()}
    assert got == {(1, "e1", "token"), (2, "e2", "substring")}


def test_subtree_and_region_match(spark):
    nodes = full(spark, [{"ref": "r1", "xpath": "/html/body/div[1]"}, {"ref": "e2", "xpath": "/html/body/div[1]/a[1]"}, {"ref": "e3", "xpath": "/html/body/div[10]/a[1]"}])
    t = spark.createDataFrame([("s", "r1")], "snapshot_id string, target_ref string")
    assert {r.ref for r in snapshots.subtree(nodes, t).collect()} == {"r1", "e2"}
    pairs = spark.createDataFrame([("s", "r1", "e2"), ("s", "r1", "e3")], "snapshot_id string, region_ref string, target_ref string")
    assert {r.target_ref: r.matches for r in snapshots.region_match(nodes, pairs).collect()} == {"e2": True, "e3": False}


def test_page_features(spark):
    nodes = full(
        spark,
        [
            {"ref": "e1", "tag": "input", "role": "searchbox", "placeholder": "Search here", "parent_ref": "r2", "ancestors": ["r1", "r2"]},
            {"ref": "e2", "tag": "button", "role": "button", "text": "Search", "parent_ref": "r2", "ancestors": ["r1", "r2"]},
            {"ref": "e3", "text": "Home"}, {"ref": "e4", "text": "About us"}, {"ref": "e5", "text": "1", "parent_ref": "r5"},
            {"ref": "e6", "text": "2", "parent_ref": "r5"}, {"ref": "e7", "text": "Next", "parent_ref": "r5"}, {"ref": "e8", "role": "dialog", "tag": "div", "name": "D"},
            {"ref": "e9", "text": "Buy"},
        ],
    )
    area = features.search_areas(nodes).first()
    assert (area.input_ref, area.nearby_buttons) == ("e1", ["e2"])
    nav = features.navigation(nodes).first()
    assert (nav.kind, nav.links) == ("navigation_links", ["e3", "e4"])
    form = features.forms(nodes).first()
    assert (form.inputs, form.buttons) == (["e1"], ["e2"])
    paging = features.pagination_groups(nodes).first()
    assert (paging.parent_ref, paging.controls, paging.has_moves, paging.has_numbers) == ("r5", 3, True, True)
    assert [r.ref for r in features.dialogs(nodes).collect()] == ["e8"]
    assert "e9" in [r.ref for r in features.primary_actions(nodes).collect()]
    kinds = {r.kind: r["count"] for r in features.page_groups(nodes, spark.createDataFrame([("s", "r9", 1, "list", 4)], "snapshot_id string, ref string, ord int, kind string, item_count int")).collect()}
    assert kinds == {"search_area": 2, "pagination": 3, "repeated_data_items": 4}
    acts = spark.range(1).select(features.region_actions(F.lit("r1"), F.lit("list"), F.lit(3)).alias("a")).first().a
    assert acts == ["expand", "list-items", "extract", "batch-detail-extract_candidate"]


REQUEST = (
    "request_id int, snapshot_id string, intent string, target_hint string, roles array<string>, texts array<string>, region_hint string, near string, exclude array<string>"
)


def test_match_elements(spark):
    nodes = full(
        spark,
        [
            {"ref": "e1", "text": "Add to cart", "name": "Add to cart"}, {"ref": "e2", "text": "Cart", "name": "Cart"}, {"ref": "e3", "text": "Open", "name": "Open"},
            {"ref": "e4", "text": "Open", "name": "Open"}, {"ref": "e5", "text": "Filter by size", "name": "Size"},
        ],
    )
    rows = [
        (1, "s", "click", "x", None, ["Cart"], "", "", None), (2, "s", "click", "open", None, None, "", "", None), (3, "s", "click", "nothing at all", None, None, "", "", None),
        (4, "s", "click", "filter by size", None, None, "", "", None), (5, "s", "click", "cart", None, None, "", "", ["add"]),
    ]
    got = {r.request_id: r for r in matching.match_elements(nodes, spark.createDataFrame(rows, REQUEST)).collect()}
    assert (got[1].status, got[1].target_ref) == ("selected", "e2")
    assert (got[2].status, got[2].has_conflict) == ("need_approval", True)
    assert got[3].status == "not_found"
    assert (got[4].status, got[4].target_ref) == ("selected", "e5")
    assert (got[5].status, got[5].target_ref) == ("selected", "e2")


def test_candidates_late_on_the_page_are_judged(spark):
    rows = [{"ref": f"e{i}", "text": f"cart {i}", "name": f"cart {i}"} for i in range(1, 31)] + [{"ref": "e31", "text": "Cart", "name": "Cart"}]
    asked = spark.createDataFrame([(1, "s", "click", "x", None, ["Cart"], "", "", None)], REQUEST)
    row = matching.match_elements(full(spark, rows), asked).first()
    assert (row.status, row.target_ref, row.candidates) == ("selected", "e31", 31)


def test_lists_of_features_are_whole(spark):
    rows = [{"ref": f"e{i}", "text": f"Home {i}"} for i in range(30)] + [{"ref": f"e{100 + i}", "tag": "article", "role": "article"} for i in range(30)]
    nodes = full(spark, rows)
    assert len(features.navigation(nodes).first().links) == 30
    assert features.content_regions(nodes).count() == 30
    assert features.content_regions(nodes, 5).count() == 5


def test_lookup_order_of_verify_and_near(spark):
    nodes = full(spark, [{"ref": "e1"}, {"ref": "r2", "ref_type": "container", "tag": "div", "role": ""}])
    req = spark.createDataFrame([(1, "s", "e1", "click"), (2, "s", "r2", "click"), (3, "s", "e99", "type")], "request_id int, snapshot_id string, ref string, intent string")
    got = {r.request_id: r.issues for r in snapshots.verify_ref(nodes, req).collect()}
    assert got == {1: [], 2: ["element_expected", "not_clickable"], 3: ["ref_not_found"]}
    anchors = spark.createDataFrame([(1, "s", "e1")], "request_id int, snapshot_id string, ref string")
    assert {r.ref for r in snapshots.near(nodes, anchors).collect()} == {"e1", "r2"}


def test_merged_nodes_keep_the_first_value_of_every_field(spark):
    kind = "snapshot_id string, ref string, ord long, text string, attrs map<string,string>, kids array<string>"
    first = spark.createDataFrame([("s", "e1", 0, "", {"a": "1", "b": None}, []), ("s", "e2", 1, "two", None, ["x"]), ("s", None, 2, "loose", None, None)], kind)
    second = spark.createDataFrame([("s", "e1", 5, "one", {"a": "9", "b": "2"}, ["k"]), ("s", "e3", 6, None, {}, None)], kind)
    got = {r.ref: r for r in snapshots.merge_nodes([first, second]).collect()}
    assert (got["e1"].text, got["e1"].attrs, got["e1"].kids) == ("one", {"a": "1", "b": "2"}, ["k"])
    assert (got["e2"].text, got["e2"].attrs, got["e2"].kids) == ("two", {}, ["x"])
    assert got["e3"].text is None and got[None].text == "loose" and len(got) == 4
    assert snapshots.merge_nodes([first.limit(0), second.limit(0)]).count() == 0

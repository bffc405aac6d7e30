"""SQL functions and the entry point of the driver."""

import __spark_entry__ as contract
from reapline.functions.registry import register_functions


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        "select is_http_url(' https://a.b/c') as ok, url_site('https://A.b:80/c') as site, page_identity('https://a.b/c/?x#y') as identity, "
        "page_title('<TITLE> a\n b</TITLE>') as title, has_cjk('a影') as cjk, token_estimate('abcde') as n, is_meaningful(' ') as m, dom_hash(null) as h"
    ).first()
    assert row.asDict() == {"ok": True, "site": "a.b:80", "identity": "https://a.b/c", "title": "a b", "cjk": True, "n": 2, "m": False, "h": "d41d8cd98f00b204"}


def test_table_function(spark):
    register_functions(spark)
    rows = spark.sql("select p.id, n.tag, n.href from (select 1 as id, '<body><a href=\"/x\">t</a></body>' as html) p, lateral html_nodes(p.html) n").collect()
    assert [(r.id, r.tag, r.href) for r in rows] == [(1, "body", None), (1, "a", "/x")]


def test_entry_and_names(spark):
    assert contract.entry(spark).count() == 3
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 130


def test_json_ld_in_sql(spark):
    register_functions(spark)
    page = """<script type="application/ld+json">{"@graph": [{"name": "a"}, [{"name": "b"}]]}</script><script type="application/ld+json">{broken</script>"""
    spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("ld_pages")
    rows = spark.sql("select p.id, o.block_no, o.place, o.json from ld_pages p, lateral json_ld(p.html) o order by o.place").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "/0", '{"name": "a"}'), (1, 0, "/1/0", '{"name": "b"}')]


def test_json_ld_makes_no_arrow_batch_a_page(spark):
    register_functions(spark)
    spark.createDataFrame([(i, f'<script type="application/ld+json">{{"n": {i}}}</script>') for i in range(3)], "id int, html string").createOrReplaceTempView("few_pages")
    df = spark.sql("select p.id, o.json from few_pages p, lateral json_ld(p.html) o")
    assert "BatchEvalPythonUDTF" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in df.collect()) == [(i, f'{{"n": {i}}}') for i in range(3)]


def test_parts_in_one_split_are_spread(spark):
    from reapline.catalog import lookups, pages

    for made in (lookups.text_rules(spark, "/root/testdata/sf0.001"), pages.part_pages(spark, "/root/testdata/sf0.001")):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

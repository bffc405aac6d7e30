"""Functions for SQL text: temporary SQL functions and table functions.

Spark joins no pure Arrow table function laterally, so these take a page a call.  An Arrow
exchange makes a batch of every page, which costs more than the pages of ``json_ld``; it sends pickled rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from reapline.operators.html import page_rows
from reapline.operators.structured import SCRIPT

# Name, parameters, result type and body of each SQL function.
SQL_FUNCTIONS = (
    ("is_http_url", "u STRING", "BOOLEAN", r"coalesce(trim(u) RLIKE '(?i)^https?://[^/?#]+', false)"),
    ("url_site", "u STRING", "STRING", r"lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"),
    ("page_identity", "u STRING", "STRING", r"regexp_replace(regexp_replace(trim(u), '[?#].*$', ''), '/+$', '')"),
    ("page_title", "html STRING", "STRING", r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' '))"),
    ("dom_hash", "s STRING", "STRING", "left(md5(coalesce(s, '')), 16)"),
    ("has_cjk", "s STRING", "BOOLEAN", r"coalesce(s RLIKE '[\\u3400-\\u4dbf\\u4e00-\\u9fff]', false)"),
    ("token_estimate", "s STRING", "BIGINT", "length(coalesce(s, '')) div 2"),
    ("is_meaningful", "s STRING", "BOOLEAN", r"coalesce(s RLIKE '\\S', false)"),
)


@udtf(returnType="ref string, parent_ref string, ord int, depth int, tag string, xpath string, txt string, href string", useArrow=True)
class HtmlNodes:
    """Nodes of a page for ``LATERAL html_nodes(html)``; a null page has none."""

    def eval(self, html: str):
        for r in page_rows(0, html or ""):
            yield r[1], r[2], r[3], r[6], r[7], r[8], r[11], dict(r[12]).get("href")


def ld_objects(html: str | None) -> Iterator[tuple[int, str, str]]:
    """(block, place, JSON text) of every linked-data object; lists and graphs are opened however deep."""
    for number, block in enumerate(re.findall(SCRIPT, html or "")):
        try:
            left = [("", json.loads(block))]
        except (ValueError, RecursionError):
            continue
        while left:
            place, v = left.pop()
            inner = v if isinstance(v, list) else v.get("@graph") if isinstance(v, dict) else None
            if isinstance(inner, list):
                left += [(f"{place}/{i}", x) for i, x in reversed(list(enumerate(inner)))]
            elif isinstance(v, dict):
                yield number, place, json.dumps(v, ensure_ascii=False, sort_keys=True)


@udtf(returnType="block_no int, place string, json string", useArrow=False)
class JsonLd:
    """Linked-data objects of a page for ``LATERAL json_ld(html)``; broken blocks and null pages have none."""

    def eval(self, html: str):
        yield from ld_objects(html)


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions available to SQL text of a session; returns their names."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    tables = {"html_nodes": HtmlNodes, "json_ld": JsonLd}
    for name, found in tables.items():
        spark.udtf.register(name, found)
    return [name for name, *_ in SQL_FUNCTIONS] + list(tables)

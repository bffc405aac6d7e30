"""Linked data inside pages: every ld+json block as records, with built-in JSON functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.url import let, stripped

SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?\s*application/ld\+json\s*["']?[^>]*>(.*?)</script>"""


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(_get(v, p, "string"), F.lit("")) for p in paths])


def _elements(v: Column) -> Column:
    """Members of a list or of a ``@graph``, else the value itself."""
    return F.coalesce(_get(v, "$", "array<variant>"), _get(v, "$['@graph']", "array<variant>"), F.array(v))


def _author(v: Column) -> Column:
    one = lambda a: stripped(F.coalesce(_get(a, "$.name", "string"), F.when(F.schema_of_variant(a) == "STRING", _get(a, "$", "string")), F.lit("")))
    many = _get(v, "$.author", "array<variant>")
    listed = F.array_join(F.filter(F.transform(many, one), lambda x: x != ""), ", ")
    single = let(_get(v, "$.author", "variant"), one)
    return F.coalesce(F.when(many.isNotNull(), listed), single, F.lit(""))


def _tags(v: Column, name: str) -> Column:
    many = _get(v, f"$.{name}", "array<string>")
    single = F.nullif(_get(v, f"$.{name}", "string"), F.lit(""))
    return F.when(F.size(many) > 0, many).otherwise(F.when(many.isNull() & single.isNotNull(), F.array(single)))


def nesting(json: Column) -> Column:
    """How deep the lists of a JSON text nest, at most: brackets outside its strings, in one pass."""
    plain = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), r'"[^"]*+"', "")
    bare = F.regexp_replace(plain, r"[^\[\]]+", "")
    step = lambda acc, c: F.struct(
        (acc["now"] + F.when(c == "[", 1).otherwise(-1)).alias("now"),
        F.greatest(acc["top"], acc["now"] + F.when(c == "[", 1).otherwise(-1)).alias("top"),
    )
    return F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])


def json_ld_objects(pages: DataFrame) -> DataFrame:
    """One row per linked-data object of a page, with lists and graphs opened however deep they nest.

    ``place`` holds the number of the block and the positions on the way to the object.
    """
    blocks = pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("block_no", "_json")
    )
    df = blocks.select("page_id", "url", "block_no", F.try_parse_json("_json").alias("v"), nesting(F.col("_json")).alias("_levels")).where("v is not null")
    member = lambda place, v: F.struct(place.alias("place"), v.alias("v"))
    opened = F.aggregate(
        F.sequence(F.lit(0), F.col("_levels")),
        F.array(member(F.array("block_no"), F.col("v"))),
        lambda acc, _: F.flatten(
            F.transform(acc, lambda e: F.transform(_elements(e["v"]), lambda x, i: member(F.concat(e["place"], F.array(i)), x)))
        ),
    )
    return df.select("page_id", "url", F.inline(opened)).where(F.schema_of_variant("v").startswith("OBJECT"))


def json_ld_items(pages: DataFrame, schema: Sequence[str]) -> DataFrame:
    """Records from linked data with the requested fields; records without any are dropped.

    ``tags`` is an array column, all other fields are text.
    """
    v = F.col("v")
    offers = F.coalesce(F.get(_get(v, "$.offers", "array<variant>"), F.lit(0)), _get(v, "$.offers", "variant"))
    none = F.lit("")
    known = {
        "title": _text(v, "$.name", "$.headline", "$.title"),
        "url": F.coalesce(_text(v, "$.url"), F.col("url")),
        "description": _text(v, "$.description"),
        "author": _author(v),
        "price": F.coalesce(_text(v, "$.price"), F.nullif(_get(offers, "$.price", "string"), none)),
        "text": _text(v, "$.articleBody", "$.description"),
        "tags": F.coalesce(_tags(v, "keywords"), _tags(v, "about")),
    }
    wanted = [f for f in schema if f in known]
    columns = [known[f].alias(f) if f == "tags" else stripped(F.coalesce(known[f], none)).alias(f) for f in wanted]
    filled = [(F.coalesce(F.size(f) > 0, F.lit(False)) if f == "tags" else F.col(f) != "") for f in wanted]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    df = json_ld_objects(pages).select("page_id", "place", F.col("url").alias("page_url"), *columns)
    return df.where(some).withColumn("record_source", F.lit("session_json_ld"))

"""Record values: what counts as present, valid, canonical or numeric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reapline.functions.url import BLANKS, _col, is_http_url, let, stripped

# The names under which a canonical field may be delivered.
FIELD_ALIASES = {
    "title": ("title", "name", "book_title", "product_name"),
    "url": ("url", "href", "link", "detail_url", "final_url"),
    "price": ("price", "amount", "cost"),
    "text": ("text", "quote", "content", "正文"),
    "author": ("author", "writer", "作者"),
    "tags": ("tags", "tag", "标签"),
    "team": ("team", "team_name", "name", "title", "球队名称"),
    "year": ("year", "年份"),
    "wins": ("wins", "win", "胜场"),
    "losses": ("losses", "loss", "负场"),
    "description": ("description", "summary", "简介", "描述"),
    "rating": ("rating", "score", "评分", "得分"),
    "rank": ("rank", "ranking", "排名", "名次"),
    "hot_value": ("hot_value", "heat", "热度", "热搜指数"),
    "time": ("time", "published_at", "发布时间", "时间"),
    "subtitle": ("subtitle", "sub_title", "副标题"),
    "badge": ("badge", "label", "徽标", "角标"),
}

# Field families with their own validity rule.
TITLE_FIELDS = ("title", "name")
TEXT_FIELDS = ("title", "name", "description", "text", "author", "team")
URL_FIELDS = ("url", "href", "detail_url", "link")
INTEGER_FIELDS = ("year", "wins", "losses", "count", "rank")

MARKUP = r"(?i)<\s*/?\s*[a-z][^>]*>"
PRICE = r"^(?:[$€£¥]\s*)?\d+(?:\.\d{1,2})?$"

# Cells that mean "no value", and currency signs in front of numbers.
NULL_TOKENS = ("", "-", "--", "N/A", "n/a", "null", "None")
CURRENCY = r"^[¥$€£￥]\s*"


def meaningful(v) -> Column:
    """Text that is present and not blank."""
    return F.coalesce(stripped(v) != "", F.lit(False))


def meaningful_array(v) -> Column:
    return F.coalesce(F.size(_col(v)) > 0, F.lit(False))


def is_valid_field(field, value) -> Column:
    """Whether a value is plausible for the field it is stored under.

    ``field`` may be a column, so that one expression serves exploded schemas.
    """
    name = F.lower(stripped(F.lit(field) if isinstance(field, str) else field))
    raw = _col(value)
    text = stripped(raw)
    is_text = text != ""
    is_title = is_text & ~is_http_url(text) & ~text.rlike(MARKUP)
    is_price = stripped(F.regexp_replace(text, ",", "")).rlike(PRICE)
    integer = text.rlike(r"^\+?\d+$|^-0+$")
    is_year = F.coalesce(
        F.when(text.rlike(r"^\+?\d{1,9}$"), text.try_cast("int").between(1000, 2100)), F.lit(False)
    )
    verdict = (
        F.when(raw.isNull(), F.lit(False))
        .when(name.isin(*TITLE_FIELDS), is_title)
        .when(name.isin(*URL_FIELDS), is_http_url(text))
        .when(name == "price", is_price)
        .when(name == "year", is_year)
        .when(name.isin(*INTEGER_FIELDS), integer)
        .otherwise(is_text)
    )
    return F.coalesce(verdict, F.lit(False))


def valid_tags(tags) -> Column:
    return F.coalesce(F.exists(_col(tags), lambda t: t.rlike(r"\S")), F.lit(False))


def lower_keys(fields) -> Column:
    """Field map with trimmed lower-case names; of equal names the last one stays."""
    entries = F.transform(
        F.map_entries(_col(fields)),
        lambda e: F.struct(F.lower(stripped(e["key"])).alias("key"), e["value"].alias("value")),
    )

    def build(found: Column) -> Column:
        names = F.transform(found, lambda e: e["key"])
        last_only = F.filter(
            found, lambda e, i: ~F.exists(F.slice(found, i + F.lit(2), F.size(found)), lambda o: o["key"] == e["key"])
        )
        clash = F.size(F.array_distinct(names)) < F.size(found)
        return F.map_from_entries(F.when(clash, last_only).otherwise(found))

    return F.when(has_plain_names(fields), _col(fields)).otherwise(let(entries, build))


def has_plain_names(fields) -> Column:
    """Whether all names of a field map are in lower case and without blanks, as they mostly are."""
    names = F.array_join(F.map_keys(_col(fields)), "")
    return (names == F.lower(names)) & ~names.rlike(f"[{BLANKS}]")


def first_meaningful(fields, names: Sequence[str]) -> Column:
    """First present value among ``names`` in a lower-case field map."""
    m = _col(fields)
    return F.coalesce(*[F.when(meaningful(m[n.lower()]), m[n.lower()]) for n in names])


def canonical(lowered_fields, field: str) -> Column:
    return first_meaningful(lowered_fields, FIELD_ALIASES.get(field, (field,)))


def canonical_by_name(lowered_fields, field: Column) -> Column:
    """Canonical value when the field name itself is a column."""
    m = _col(lowered_fields)
    chain = None
    for name in FIELD_ALIASES:
        value = canonical(m, name)
        chain = F.when(field == name, value) if chain is None else chain.when(field == name, value)
    own = m[F.lower(field)]
    return chain.otherwise(F.when(meaningful(own), own))


def names_of(field) -> Column:
    """Lower-case names under which a field, its name given as a column, may be delivered."""
    f = _col(field)
    known = F.create_map(*[x for name, aliases in FIELD_ALIASES.items() for x in (F.lit(name), F.array(*[F.lit(a.lower()) for a in aliases]))])
    return F.coalesce(known[f], F.array(F.lower(f)))


def first_of_names(lowered_fields, names) -> Column:
    """``first_meaningful`` with the names in a column."""
    m = _col(lowered_fields)
    return F.get(F.filter(F.transform(_col(names), lambda n: m[n]), lambda v: meaningful(v)), F.lit(0))


def sorted_json(fields) -> Column:
    """JSON of a field map with its keys in order: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(_col(fields)))))


def identity(fields) -> Column:
    """Key under which two records are the same record: URL first, else all fields."""
    m = _col(fields)
    bare = lambda low: F.regexp_replace(stripped(canonical(low, "url")), r"/+$", "")
    url = F.when(has_plain_names(m), bare(m)).otherwise(let(lower_keys(m), bare))
    return F.coalesce(F.nullif(url, F.lit("")), sorted_json(m))


def delivery_identity(fields) -> Column:
    """Identity for exports: where and when a record was seen does not distinguish it."""
    m = _col(fields)
    url = F.coalesce(
        *[
            F.nullif(F.regexp_replace(stripped(m[n]), r"/+$", ""), F.lit(""))
            for n in ("final_url", "detail_url", "url", "href")
        ]
    )
    rest = sorted_json(F.map_filter(m, lambda k, _: ~k.isin("source_url", "captured_at")))
    return F.coalesce(F.concat(F.lit("url:"), url), F.concat(F.lit("record:"), rest))


def coerce_number(v) -> Column:
    """struct(value, text, was_percent) of a scraped cell; all null for "no value"."""
    text = stripped(v)
    bare = stripped(F.regexp_replace(text, CURRENCY, ""))
    percent = bare.endswith("%")
    digits = F.regexp_replace(F.when(percent, F.regexp_replace(bare, r"\s*%$", "")).otherwise(bare), ",", "")
    number = F.when(
        digits.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), digits.try_cast("double")
    )
    absent = text.isNull() | text.isin(*NULL_TOKENS)
    return F.when(
        ~absent,
        F.struct(
            number.alias("value"),
            F.when(number.isNull(), text).alias("text"),
            (percent & number.isNotNull()).alias("was_percent"),
        ),
    )


def field_type(v) -> Column:
    """number or string, by the coerced value of a cell."""
    return F.when(coerce_number(v)["value"].isNotNull(), F.lit("number")).otherwise(F.lit("string"))


def record_text(fields) -> Column:
    """Main text of a record: first filled text field, else the whole record as JSON."""
    m = _col(fields)
    names = ("text", "content", "page_content", "description", "summary")
    return F.coalesce(*[F.nullif(m[n], F.lit("")) for n in names], F.to_json(m))

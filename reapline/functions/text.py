"""Text functions: Column in, Column out, without Python workers unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reapline.functions.url import _col, let, stripped

CJK = r"[\u3400-\u4dbf\u4e00-\u9fff]"


def has_cjk(s) -> Column:
    return F.coalesce(_col(s).rlike(CJK), F.lit(False))


def collapse_blanks(s) -> Column:
    return stripped(F.regexp_replace(_col(s), r"\s+", " "))


def clean_html(html) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags."""
    text = F.regexp_replace(_col(html), r"(?s)<script.*?>.*?</script>|<style.*?>.*?</style>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"<[^\n]*?>", " ")
    return collapse_blanks(text)


def page_title(html) -> Column:
    title = F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return collapse_blanks(title)


def dom_hash(s) -> Column:
    """16 hex digits that change when anything in the page structure changes."""
    return F.substring(F.md5(F.coalesce(_col(s), F.lit(""))), 1, 16)


def compact_dom(s) -> Column:
    """Page structure with blanks collapsed and numbers replaced by 0."""
    text = F.regexp_replace(F.coalesce(_col(s), F.lit("")), r"\s+", " ")
    return F.regexp_replace(text, r"\b\d+\b", "0")


def word_set(s) -> Column:
    """Distinct lower-case alphanumeric words of two or more characters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_col(s), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def search_tokens(s) -> Column:
    """Tokens for keyword search.

    Other scripts are cut at anything that is not an ASCII letter or digit.  Chinese
    runs become overlapping character pairs; a run of one character stays as it is.
    A dictionary segmenter may be passed to the search operators instead.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(s), F.lit(""))), F.lit(r"[\u4e00-\u9fa5]+|[a-z0-9]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(r"^[\u4e00-\u9fa5]"), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, pieces))


def token_estimate(s) -> Column:
    """Half the number of characters; callers flag it as an estimate."""
    return F.floor(F.length(F.coalesce(_col(s), F.lit(""))) / 2).cast("long")


def ellipsize(s, n: int = 160) -> Column:
    text = collapse_blanks(s)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def truncate(s, n: int, suffix: str = "...[截断]") -> Column:
    text = _col(s)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def normalize_locator(s) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(s), F.lit(""))), r"\s+", "")


def sanitize_locator(s) -> Column:
    """Element locator without attribute, text() and tag parts a lookup cannot use."""
    loc = stripped(s)
    loc = F.regexp_replace(loc, r"/@[\w-]+$", "")
    loc = F.regexp_replace(loc, r"/text\(\)$", "")
    loc = F.regexp_replace(loc, r"^x:\.//", "x://")
    loc = F.when(loc.startswith(".//"), F.concat(F.lit("x:"), F.substr(loc, F.lit(2)))).otherwise(loc)
    return stripped(F.regexp_replace(loc, r"@@(?:tag|attr)=\S+", ""))


def locators_in(code, info) -> Column:
    """Distinct locators named in a hint line and in stored page code, in order."""
    hinted = F.transform(
        F.split(F.coalesce(_col(info), F.lit("")), r"\|"), lambda p: stripped(F.regexp_extract(p, r"^([^(]*)", 1))
    )
    called = F.concat(
        F.regexp_extract_all(F.coalesce(_col(code), F.lit("")), F.lit(r"""(?:tab|new_tab|page)\.ele\(\s*(?:'([^']+)'|"[^"]+")"""), F.lit(1)),
        F.regexp_extract_all(F.coalesce(_col(code), F.lit("")), F.lit(r"""(?:tab|new_tab|page)\.ele\(\s*(?:"([^"]+)"|'[^']+')"""), F.lit(1)),
    )
    return F.array_distinct(F.filter(F.concat(hinted, F.transform(called, stripped)), lambda x: x != ""))


def slug(name) -> Column:
    s = F.regexp_replace(F.regexp_replace(_col(name), r"[^a-zA-Z0-9._\-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("model"))


def is_valid_thread_id(s) -> Column:
    return F.coalesce(_col(s).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:\-]{3,127}$"), F.lit(False))


def parse_ts(s) -> Column:
    """ISO time or one of two plain forms; a time without zone is UTC; else null."""
    text = stripped(s)
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text)
    return F.try_to_timestamp(shaped)


def _whole_json(text: Column) -> Column:
    """Variant of text that is one JSON value; the parser alone would ignore what follows it."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(wrapped, lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))))


def lenient_json(s) -> Column:
    """Variant of almost-JSON: as is, without fences, outermost braces, or joined objects."""
    text = stripped(s)
    unfenced = stripped(F.regexp_replace(text, r"```(?:json)?", ""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    joined = F.concat(F.lit("["), F.regexp_replace(text, r"\}\s*\{", "}, {"), F.lit("]"))
    return F.coalesce(
        _whole_json(text),
        _whole_json(unfenced),
        _whole_json(braces),
        F.when(text.rlike(r"\}\s*\{"), _whole_json(joined)),
    )


def verdict_fields(s) -> Column:
    """struct of the ``Name: value`` lines in a written verdict."""
    text = F.coalesce(_col(s), F.lit(""))

    def line(name: str, default: str = "") -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*(\S[^\r\n]*)$"), F.lit(1))
        return F.coalesce(stripped(F.get(F.reverse(found), F.lit(0))), F.lit(default))

    scope = F.lower(line("FailureScope", "local"))
    return F.struct(
        text.rlike(r"(?i)Status\s*:\s*STEP_SUCCESS").alias("is_success"),
        line("Summary", "Step executed.").alias("summary"),
        let(scope, lambda v: F.when(v.isin("local", "global"), v).otherwise("local")).alias("failure_scope"),
        line("FailedAction").alias("failed_action"),
        line("FailedLocator").alias("failed_locator"),
        line("Evidence").alias("evidence"),
        line("FixHint").alias("fix_hint"),
    )


# Chinese numerals used in "first N" questions; words asking for everything.
CHINESE_DIGITS = "一二两三四五六七八九"
CHINESE_VALUES = "1223456789"
GLOBAL_WORDS = ("全部", "所有", "列表", "清单", "总结", "分析", "all", "summary", "list")


def chinese_number(s) -> Column:
    """Value of a numeral between 一 and 九十九."""
    digit = lambda c: F.translate(c, CHINESE_DIGITS, CHINESE_VALUES).try_cast("int")
    tens = F.regexp_extract(_col(s), r"^([一二两三四五六七八九]?)十", 1)
    ones = F.regexp_extract(_col(s), r"十([一二两三四五六七八九])", 1)
    return F.when(
        F.contains(_col(s), F.lit("十")),
        F.coalesce(digit(F.nullif(tens, F.lit(""))), F.lit(1)) * 10 + F.coalesce(digit(F.nullif(ones, F.lit(""))), F.lit(0)),
    ).otherwise(digit(F.regexp_extract(_col(s), r"([一二两三四五六七八九])$", 1)))


def top_k_hint(question) -> Column:
    """How many passages a question needs: twice the N it names, at least 15, else 10."""
    q = F.coalesce(_col(question), F.lit(""))
    arabic = F.regexp_extract(q, r"(?i)(?:前|top)\s*(\d{1,9})", 1).try_cast("int")
    chinese = chinese_number(F.regexp_extract(q, r"前([一二两三四五六七八九十]+)", 1))
    wide = F.lit(False)
    for word in GLOBAL_WORDS:
        wide = wide | F.contains(F.lower(q), F.lit(word))
    return (
        F.when(arabic.isNotNull(), F.greatest(arabic * 2, F.lit(15)))
        .when(chinese > 0, F.greatest(chinese * 2, F.lit(15)))
        .when(wide, F.lit(15))
        .otherwise(F.lit(10))
    )


def format_context(texts, metadata) -> Column:
    """Numbered passages with their metadata, joined to one context text."""
    rows = F.arrays_zip(_col(texts).alias("text"), _col(metadata).alias("meta"))

    def passage(r: Column, i: Column) -> Column:
        kept = F.filter(
            F.map_entries(r["meta"]),
            lambda e: ~e["key"].isin("text", "pk", "vector") & e["value"].rlike(r"\S"),
        )
        line = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
        head = F.concat(F.lit("[片段 "), (i + 1).cast("string"), F.lit("] "), r["text"])
        return F.when(F.coalesce(line, F.lit("")) != "", F.concat(head, F.lit("\n  元数据: "), line)).otherwise(head)

    return F.array_join(F.transform(rows, passage), "\n\n")


def digest(hex_digits: int, *cols) -> Column:
    """Stable key over named columns: sha256 of their JSON in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, hex_digits)

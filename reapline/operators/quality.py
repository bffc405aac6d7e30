"""Extracted records: merging, validity, provenance and contract evaluation.

``items``: a run key, ordering columns and ``fields`` map<string,string>; an optional
``tags`` array<string>.  ``contracts``: one row per run with ``schema`` and ``min_items``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import ITEM_ACTIONS, any_of
from reapline.functions.text import has_cjk
from reapline.functions.url import is_http_url, let, normalized_url, stripped
from reapline.functions.values import (
    MARKUP,
    first_meaningful,
    identity,
    is_valid_field,
    lower_keys,
    meaningful,
    first_of_names,
    names_of,
    sorted_json,
    valid_tags,
)
from reapline.plans.ranking import broadcast_if_small, first_per_key, top_k
from reapline.session import durable

ORDER = ("page_number", "pos")
LINK_NAMES = ("final_url", "detail_url", "url", "href")
URL_CELLS = ("url", "href", "link", "detail_url", "final_url")

#: So many field names at most become columns when records are merged.
COLUMN_NAMES = 32

# Titles that name a widget instead of a record.
GENERIC_TITLES = ("link", "image", "cover", "cover image", "details", "read more")


def _field_names(items: DataFrame) -> list[str] | None:
    """Names of the fields that occur, in order; none where there are more than ``COLUMN_NAMES``."""
    found = items.select(F.explode(F.map_keys("fields")).alias("name")).distinct().limit(COLUMN_NAMES + 1).collect()
    return sorted(r.name for r in found) if len(found) <= COLUMN_NAMES else None


def merge_items(
    items: DataFrame,
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ORDER,
    identity_of: Callable[[Column], Column] = identity,
) -> DataFrame:
    """One row per record of a run; later present values replace earlier ones.

    Fields are aggregated one by one with map-side combine, so many copies of one
    record never meet as rows in one task; only its few final fields do.  Up to
    ``COLUMN_NAMES`` field names are columns of one aggregation; with more names every
    field of a row is a row of its own.  ``first_pos`` keeps the position of the first copy.
    """
    keys = list(keys)
    names = _field_names(items)
    rows = (
        items.where(F.col("fields").isNotNull())
        .withColumns({"identity": identity_of(F.col("fields")), "_at": F.struct(*order)})
    )
    merged = _merge_by_row if names is None else lambda *a: _merge_by_column(*a, names)
    return merged(rows, keys, "tags" in items.columns)


def _latest_tags() -> Column:
    return F.max_by("tags", F.when(F.size("tags") > 0, F.col("_at")))


def _merge_by_column(rows: DataFrame, keys: list[str], has_tags: bool, names: list[str]) -> DataFrame:
    value = lambda n: F.when(meaningful(F.col("fields")[n]), F.col("fields")[n])
    columns = {f"_v{i}": n for i, n in enumerate(names)}
    cells = rows.select(
        *keys, "identity", "_at", *[value(n).alias(v) for v, n in columns.items()], *(["tags"] if has_tags else [])
    )
    latest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in columns]
    merged = cells.groupBy(*keys, "identity").agg(
        *latest, F.min("_at").alias("first_pos"), *([_latest_tags().alias("tags")] if has_tags else [])
    )
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(v).alias("value")) for v, n in columns.items()]) if names else empty
    fields = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return merged.select(*keys, "identity", fields.alias("fields"), "first_pos", *(["tags"] if has_tags else []))


def _merge_by_row(rows: DataFrame, keys: list[str], has_tags: bool) -> DataFrame:
    filled = F.filter(F.map_entries("fields"), lambda e: meaningful(e["value"]))
    anchor = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    cells = rows.select(
        *keys, "identity", "_at", F.explode(F.concat(anchor, filled)).alias("_e"), *(["tags"] if has_tags else [])
    )
    is_anchor = F.col("_e.key").isNull()
    aggregates = [F.max_by("_e.value", "_at").alias("value"), F.min("_at").alias("_first")]
    if has_tags:
        aggregates.append(F.max_by("tags", F.when(is_anchor & (F.size("tags") > 0), F.col("_at"))).alias("_tags"))
    per_field = cells.groupBy(*keys, "identity", F.col("_e.key").alias("field")).agg(*aggregates)
    entry = F.when(F.col("field").isNotNull(), F.struct(F.col("field").alias("key"), F.col("value").alias("value")))
    final = [
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"),
        F.min("_first").alias("first_pos"),
    ]
    if has_tags:
        final.append(F.first("_tags", ignorenulls=True).alias("tags"))
    return per_field.groupBy(*keys, "identity").agg(*final)


def first_items(
    items: DataFrame, cap: Column | int, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ORDER,
    identity_of: Callable[[Column], Column] = identity, limit_hint: int | None = None,
) -> DataFrame:
    """First copy of every record, and of those the first ``cap`` per run.

    ``cap`` may be a column of the run; ``limit_hint`` is an upper bound of it that lets
    Spark limit groups before the shuffle.
    """
    keyed = items.where(F.col("fields").isNotNull()).withColumn("identity", identity_of(F.col("fields")))
    unique = first_per_key(keyed, [*keys, "identity"], order)
    if isinstance(cap, int):
        return top_k(unique, keys, order, cap, "item_no")
    if limit_hint is not None:
        return top_k(unique, keys, order, limit_hint, "item_no").where(F.col("item_no") <= cap)
    from pyspark.sql import Window

    ranked = unique.withColumn("item_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("item_no") <= cap)


def item_quality(fields: Column | str, schema: Column | str, tags: Column | str | None = None) -> Column:
    """struct(valid_fields, issues) of one record."""
    m = F.col(fields) if isinstance(fields, str) else fields
    s = F.col(schema) if isinstance(schema, str) else schema
    t = F.col(tags) if isinstance(tags, str) else tags
    names = F.array_distinct(F.filter(F.transform(s, lambda f: stripped(f)), lambda f: f != ""))

    def valid(f: Column) -> Column:
        ok = is_valid_field(f, m[f])
        return ok if t is None else F.when((f == "tags") & t.isNotNull(), valid_tags(t)).otherwise(ok)

    marks = F.transform(names, lambda f: F.struct(f.alias("key"), valid(f).alias("value")))
    issues = F.transform(
        F.filter(marks, lambda e: ~e["value"]),
        lambda e: F.struct(e["key"].alias("field"), F.lit("missing_or_invalid").alias("reason")),
    )
    return F.struct(F.map_from_entries(marks).alias("valid_fields"), issues.alias("issues"))


def annotate_provenance(items: DataFrame, captured_at: Column) -> DataFrame:
    """Where each record of a successful data result came from, and how valid it is.

    Columns read: ok, action, schema, fields, page_url, current_url, snapshot_id,
    content_hash, index_file.
    """
    action = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    applies = F.coalesce("ok", F.lit(False)) & action.isin(*ITEM_ACTIONS) & (F.size("schema") > 0)

    def first_of(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))

    provenance = F.struct(
        first_of("page_url", "current_url").alias("source_url"),
        first_of("snapshot_id", "content_hash", "index_file").alias("snapshot_id"),
        action.alias("action"),
        captured_at.alias("captured_at"),
    )
    tags = "tags" if "tags" in items.columns else None
    return items.withColumns(
        {"provenance": F.when(applies, provenance), "quality": F.when(applies, item_quality("fields", "schema", tags))}
    )


def _cells(merged: DataFrame, contracts: DataFrame, keys: Sequence[str], schema: Column, outer: bool = False) -> DataFrame:
    """Counts of every contract field over the merged records of a run; with ``outer`` also of runs without fields, under null."""
    tags = F.col("tags") if "tags" in merged.columns else None
    wanted = contracts.select(*keys, F.transform(schema, lambda f: F.struct(f.alias("field"), names_of(f).alias("names"))).alias("_wanted"))
    cells = (
        merged.select(*keys, lower_keys("fields").alias("_low"), *([] if tags is None else ["tags"]))
        .join(broadcast_if_small(wanted), list(keys))
        .select("*", (F.explode_outer if outer else F.explode)("_wanted").alias("_w")).drop("_wanted")
    )
    value = first_of_names(F.col("_low"), F.col("_w.names"))
    if tags is not None:
        value = F.coalesce(value, F.when((F.col("_w.field") == "tags") & valid_tags(tags), F.array_join(tags, " ")))
    cells = cells.select(*keys, F.col("_w.field").alias("field"), value.alias("_value"))
    return cells.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("_value").isNotNull()).alias("populated"),
        F.count_if(is_valid_field(F.col("field"), F.col("_value"))).alias("valid"),
    )


def field_ratios(merged: DataFrame, contracts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Coverage and validity of every contract field over the merged records of a run."""
    return _cells(merged, contracts, keys, F.col("schema"))


def evaluate_contract(
    items: DataFrame, contracts: DataFrame, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ORDER,
    expected: str = "min_items", threshold: float = 0.8,
) -> DataFrame:
    """Whether the records of a run satisfy its contract: count, coverage and validity.

    Runs without records are evaluated too.
    """
    keys = list(keys)
    ratios = _cells(merge_items(items, keys, order), contracts, keys, F.array_distinct("schema"), outer=True)
    share = lambda c: F.when(F.col("field").isNotNull(), F.col(c) / F.col("items"))
    by_field = lambda c: F.when(
        F.count("field") > 0,
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", share(c)))))),
    )
    per_run = ratios.groupBy(*keys).agg(
        F.max("items").alias("_n"),
        F.bool_and(share("populated") >= threshold).alias("_covered"),
        F.bool_and(share("valid") >= threshold).alias("_valid"),
        by_field("populated").alias("field_coverage"),
        by_field("valid").alias("field_validity"),
    )
    no = F.lit(False)
    has_schema = F.coalesce(F.size("schema") > 0, no)
    df = contracts.join(per_run, keys, "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    required = F.coalesce(F.nullif(F.col(expected), F.lit(0)), F.lit(1)).cast("long")
    df = df.withColumns(
        {
            "item_count": n,
            "required_count": required,
            "count_ok": n >= required,
            "fields_ok": has_schema & F.coalesce("_covered", no),
            "values_ok": has_schema & F.coalesce("_valid", no),
        }
    ).withColumn("is_success", F.col("count_ok") & F.col("fields_ok") & F.col("values_ok"))
    failures = F.concat_ws(
        "; ",
        F.when(~F.col("count_ok"), F.format_string("item count %d/%d", "item_count", "required_count")),
        F.when(~F.col("fields_ok"), F.lit("required field coverage below 80%")),
        F.when(~F.col("values_ok"), F.lit("invalid required field values")),
    )
    summary = F.when(F.col("is_success"), F.format_string("task contract satisfied (%d items)", "item_count")).otherwise(failures)
    return df.withColumn("summary", summary).select(
        *keys, "is_success", "summary", "item_count", "required_count", "count_ok", "fields_ok", "values_ok",
        "field_coverage", "field_validity",
    )


def schema_coverage(
    results: DataFrame, items: DataFrame, key: str = "result_id", threshold: float = 0.6, unique_threshold: float = 0.8
) -> DataFrame:
    """Cell coverage of every successful data result, with a verdict.

    ``results``: key, ok and ``schema`` array; ``items``: key and ``fields``.  The verdict
    stays null where the cells alone cannot decide.
    """
    usable = items.where(F.exists(F.map_values("fields"), lambda v: meaningful(v))).withColumn("_low", lower_keys("fields"))
    fields = F.filter(F.transform("schema", lambda f: F.lower(stripped(f))), lambda f: f != "")
    wanted = results.withColumn("_fields", fields)
    counts = usable.groupBy(key).agg(F.count(F.lit(1)).alias("usable_items"))
    cells = (
        usable.join(wanted.select(key, "_fields"), key)
        .select(key, "_low", F.explode("_fields").alias("field"))
        .withColumn("value", F.col("_low")[F.col("field")])
    )
    is_link = F.col("field").isin(*URL_CELLS)
    url = F.when(is_link & is_http_url("value"), normalized_url("value"))
    per_url = cells.groupBy(key, url.alias("_url")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.when(is_link, is_http_url("value")).otherwise(meaningful("value"))).alias("populated"),
    )
    is_url = F.col("_url").isNotNull()
    covered = per_url.groupBy(key).agg(
        F.sum("cells").alias("total_cells"),
        F.sum("populated").alias("populated_cells"),
        F.sum(F.when(is_url, F.col("cells"))).alias("urls"),
        F.count_if(is_url).alias("distinct_urls"),
    )
    df = wanted.join(counts, key, "left").join(covered, key, "left")
    df = df.withColumns(
        {
            "usable_items": F.coalesce("usable_items", F.lit(0)).cast("long"),
            "coverage": F.coalesce(F.col("populated_cells") / F.col("total_cells"), F.lit(0.0)),
            "unique_url_ratio": F.when(F.col("urls") > 1, F.col("distinct_urls") / F.col("urls")),
        }
    )
    no_schema = F.coalesce(F.size("_fields") <= 0, F.lit(True))
    bad = (
        (F.col("usable_items") == 0)
        | (~no_schema & (F.col("coverage") == 0))
        | (~no_schema & F.coalesce(F.col("unique_url_ratio") < unique_threshold, F.lit(False)))
    )
    ok = F.coalesce("ok", F.lit(False))
    decision = (
        F.when(~ok, F.lit(None).cast("string"))
        .when(bad, "data_quality")
        .when(no_schema, "data_action")
        .when(F.col("coverage") >= threshold, "schema_match")
    )
    return df.withColumn("decision", decision).select(
        key, "usable_items", "coverage", "unique_url_ratio", "decision",
        F.when(F.col("decision").isNotNull(), F.col("decision") != "data_quality").alias("is_success"),
    )


def detail_success_ratio(details: DataFrame, key: str = "result_id", threshold: float = 0.8) -> DataFrame:
    """Share of detail rows that loaded, ended on a real URL and hold a value."""
    verified = (
        F.coalesce("detail_ok", F.lit(False))
        & is_http_url("final_url")
        & F.coalesce(F.exists(F.map_values("detail_fields"), lambda v: meaningful(v)), F.lit(False))
    )
    n = F.count(F.lit(1))
    return (
        details.groupBy(key)
        .agg(n.alias("rows"), F.count_if(verified).alias("verified"), (F.count_if(verified) / n).alias("success_ratio"))
        .withColumn("is_success", F.col("success_ratio") >= threshold)
    )


def title_of(lowered: Column | str) -> Column:
    return F.coalesce(first_meaningful(lowered, ("title", "name", "text", "content")), F.lit(""))


def link_of(fields: Column | str) -> Column:
    m = F.col(fields) if isinstance(fields, str) else fields
    return stripped(F.coalesce(*[F.nullif(m[n], F.lit("")) for n in LINK_NAMES], F.lit("")))


def any_pattern(patterns: Column | str, text: Column) -> Column:
    p = F.col(patterns) if isinstance(patterns, str) else patterns
    return F.coalesce(F.exists(p, lambda x: F.rlike(text, F.concat(F.lit("(?i)"), x))), F.lit(False))


def is_relevant(title: Column, url: Column) -> Column:
    """Title long enough, URL allowed and not forbidden; reads the case columns."""
    allowed = (F.coalesce(F.size("relevant_url_patterns"), F.lit(0)) <= 0) | any_pattern("relevant_url_patterns", url)
    return (
        (F.length(title) >= F.coalesce("minimum_title_length", F.lit(0)))
        & allowed
        & ~any_pattern("forbidden_url_patterns", url)
        & (title != "")
        & (url != "")
    )


def relevant_items(items: DataFrame, cases: DataFrame, key: str = "case_key") -> DataFrame:
    keep = let(title_of(lower_keys("fields")), lambda title: let(link_of("fields"), lambda url: is_relevant(title, url)))
    return items.join(broadcast_if_small(cases), key).where(keep).select(*items.columns)


def valid_records(items: DataFrame, cases: DataFrame, key: str = "case_key") -> DataFrame:
    """Records with a real title, a valid value in every required group and an allowed URL."""

    def keep(low: Column) -> Column:
        title = F.coalesce(stripped(first_meaningful(low, ("title", "name", "text"))), F.lit(""))
        url = F.coalesce(stripped(first_meaningful(low, LINK_NAMES)), F.lit(""))

        def group_ok(group: Column) -> Column:
            filled = F.filter(F.transform(group, lambda a: low[F.lower(a)]), lambda v: meaningful(v))
            return let(
                F.get(filled, F.lit(0)), lambda value: value.isNotNull() & F.exists(group, lambda a: is_valid_field(a, value))
            )

        title_ok = let(title, lambda t: ~F.lower(t).isin(*GENERIC_TITLES) & ~t.rlike(MARKUP))
        url_ok = let(
            url,
            lambda u: ((F.coalesce(F.size("relevant_url_patterns"), F.lit(0)) <= 0) | any_pattern("relevant_url_patterns", u))
            & ~any_pattern("forbidden_url_patterns", u),
        )
        return title_ok & url_ok & F.coalesce(F.forall("required_field_groups", group_ok), F.lit(True))

    return items.join(broadcast_if_small(cases), key).where(let(lower_keys("fields"), keep)).select(*items.columns)


def detail_candidates(items: DataFrame, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ORDER) -> DataFrame:
    """Records with a page of their own, first record per page."""
    m = F.col("fields")
    url = stripped(F.coalesce(*[F.nullif(m[n], F.lit("")) for n in ("detail_url", "url", "href")], F.lit("")))
    linked = items.withColumn("detail_url", F.regexp_replace(url, r"/+$", "")).where(is_http_url(url))
    return first_per_key(linked, [*keys, "detail_url"], order)


def detail_ready(runs: DataFrame, candidates: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether the detail step of a run is due.

    ``runs``: detail_required, list_complete, detail_batch_ran, wants_details.
    """
    some = candidates.select(key).distinct().withColumn("_has", F.lit(True))
    due = (
        ~F.coalesce("detail_batch_ran", F.lit(False)) & F.col("detail_required") & F.col("list_complete")
        & F.col("wants_details") & F.coalesce("_has", F.lit(False))
    )
    return runs.join(some, key, "left").withColumn("detail_ready", F.coalesce(due, F.lit(False))).drop("_has")


def detail_queue(
    runs: DataFrame, items: DataFrame, max_items: int = 100, key: str = "run_id", order: Sequence[str] = ORDER
) -> DataFrame:
    """Next pages to open for every run whose detail step is due."""
    candidates = detail_candidates(items, [key], order)
    due = detail_ready(runs, candidates, key).where("detail_ready").select(key)
    return top_k(candidates.join(due, key, "left_semi"), [key], order, max_items, "queue_no")


def project_schema(items: DataFrame, schema: Column | Sequence[str]) -> DataFrame:
    """Requested fields only; records without any of them are dropped."""
    wanted = schema if isinstance(schema, Column) else F.array(*[F.lit(s) for s in schema])
    kept = F.map_filter(F.col("fields"), lambda k, _: F.array_contains(wanted, k))
    return items.withColumn("fields", kept).where(F.exists(F.map_values("fields"), lambda v: F.coalesce(v != "", F.lit(False))))


# Wordings of goals about detail pages.
REFUSED_DETAILS = ("不要进入详情", "不进入详情", "无需进入详情", "只提取详情链接", "仅提取详情链接", "do not open detail", "without opening detail")
DETAIL_LINKS = ("详情链接", "详情 url", "detail link", "detail url")
DETAIL_CONTENT = ("进入详情", "打开详情", "点进去", "简介", "描述", "detail page", "description", "summary")
DETAIL_WORDS = ("详情", "详细", "简介", "介绍", "点进去", "进入每", "每一", "detail", "details", "profile")


def wants_details(goal: Column | str, compiled: Column | str) -> Column:
    """Whether a goal asks for detail pages: its contract says so, or its wording does."""
    text = F.lower(F.col(goal) if isinstance(goal, str) else goal)
    required = F.col(compiled) if isinstance(compiled, str) else compiled
    refused, link_only, content, asks = (text.rlike(any_of(words)) for words in (REFUSED_DETAILS, DETAIL_LINKS, DETAIL_CONTENT, DETAIL_WORDS))
    return required | (~refused & ~(link_only & ~content) & asks)


def flatten_items(results: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Records of successful results: list fields, then detail fields, then own fields on top.

    ``items`` is array<struct<fields, list_info, detail_info, tags?>> of string maps.
    """
    rows = results.where(F.coalesce("ok", F.lit(False))).select(*keep, F.posexplode("items").alias("pos", "_item"))
    layers = F.concat(
        *[F.coalesce(F.map_entries(F.col(f"_item.{n}")), F.array().cast("array<struct<key:string,value:string>>"))
          for n in ("list_info", "detail_info", "fields")]
    )
    last = F.filter(layers, lambda e, i: ~F.exists(F.slice(layers, i + F.lit(2), F.size(layers)), lambda o: o["key"] == e["key"]))
    return rows.select(*keep, "pos", F.map_from_entries(last).alias("fields"))


def delivery_fields(fields: Column | str, source_url: Column, captured_at: Column) -> Column:
    """Fields to hand out: private ones removed, provenance added where missing."""
    m = F.col(fields) if isinstance(fields, str) else fields
    public = F.map_filter(m, lambda k, _: ~k.startswith("_") & ~k.isin("list_info", "detail_info"))
    extra = F.filter(
        F.array(
            F.struct(F.lit("source_url").alias("key"), source_url.alias("value")),
            F.struct(F.lit("captured_at").alias("key"), captured_at.alias("value")),
        ),
        lambda e: meaningful(e["value"]) & ~F.coalesce(meaningful(public[e["key"]]), F.lit(False)),
    )
    base = F.filter(F.map_entries(public), lambda e: ~F.exists(extra, lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.concat(base, extra))


def fallback_if_failing(
    primary: DataFrame, fallback: DataFrame, contracts: DataFrame, key: str = "page_id", order: Sequence[str] = ("pos",)
) -> DataFrame:
    """Records of a page from the fallback where only the fallback satisfies the contract.

    Of the fallback at most ``min_items`` records of a page are taken.
    """
    first = evaluate_contract(primary, contracts, [key], order).where(~F.col("is_success")).select(key)
    second = evaluate_contract(fallback, contracts, [key], order).where("is_success").select(key)
    taken = F.greatest(F.col("min_items"), F.lit(1)).alias("_taken")
    replaced = durable(first.join(second, key, "left_semi").join(contracts.select(key, taken), key))
    most = replaced.agg(F.max("_taken")).first()[0] or 1
    replaced = broadcast_if_small(replaced)
    chosen = (
        top_k(fallback.join(replaced, key), [key], order, most, "_n").where(F.col("_n") <= F.col("_taken"))
        .drop("_n", "_taken").withColumn("record_source", F.lit("fallback"))
    )
    kept = primary.join(replaced, key, "left_anti").withColumn("record_source", F.lit("primary"))
    return kept.unionByName(chosen, allowMissingColumns=True)


def evaluate_runs(runs: DataFrame, cases: DataFrame, results: DataFrame, items: DataFrame) -> DataFrame:
    """Score of every run against its case: seven to nine checks.

    ``runs``: run_id, case_key, status.  ``results``: run_id, ok, action, page_url.
    ``items``: run_id, ordering columns, fields.  ``cases``: case_key, url,
    expected_min_items, expected_max_items, required_field_groups, anchor_values,
    anchor_required, allow_detail_batch, minimum_title_length, relevant_url_patterns,
    forbidden_url_patterns, minimum_chinese_title_ratio, minimum_relevant_item_ratio.
    """
    from reapline.functions.url import netloc

    def record_key(fields: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_replace(link_of(fields), r"/+$", ""), F.lit("")), sorted_json(fields))

    keyed = runs.select("run_id", "case_key", "status").join(cases, "case_key")
    opened = (
        results.where("ok").join(keyed.select("run_id", "url"), "run_id")
        .groupBy("run_id").agg(F.bool_or((netloc("url") != "") & F.contains(netloc("page_url"), netloc("url"))).alias("_opened"))
    )
    detail = results.groupBy("run_id").agg(F.bool_or(F.lower("action") == "batch-detail-extract").alias("_detail"))
    merged = merge_items(items, identity_of=record_key).withColumn("_low", lower_keys("fields"))
    case_columns = [
        "run_id", "required_field_groups", "anchor_values", "minimum_title_length", "relevant_url_patterns", "forbidden_url_patterns",
    ]
    rows = merged.join(keyed.select(*case_columns), "run_id")
    title, corpus = title_of("_low"), F.lower(F.to_json("fields"))
    groups = F.transform(
        "required_field_groups", lambda g: F.exists(g, lambda a: meaningful(F.col("_low")[F.lower(a)])).cast("long")
    )
    per_run = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(has_cjk(title)).alias("_cjk"),
        F.count_if(is_relevant(title, link_of("fields"))).alias("_relevant"),
        F.coalesce(F.bool_or(F.exists("anchor_values", lambda a: F.contains(corpus, F.lower(a)))), F.lit(False)).alias("_anchor"),
    )
    covered = (
        rows.select("run_id", F.posexplode(groups).alias("group_no", "filled")).groupBy("run_id", "group_no")
        .agg(F.avg("filled").alias("coverage"))
        .groupBy("run_id").agg(F.bool_and(F.col("coverage") >= 0.8).alias("_fields"))
    )
    df = keyed.join(opened, "run_id", "left").join(detail, "run_id", "left").join(per_run, "run_id", "left").join(covered, "run_id", "left")
    no, n = F.lit(False), F.coalesce("_n", F.lit(0))
    ratio = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    no_anchor = F.coalesce(F.size("anchor_values"), F.lit(0)) <= 0
    anchor = F.when(no_anchor & ~F.coalesce("anchor_required", no), F.lit(True)).otherwise(F.coalesce("_anchor", no))
    named = [
        ("target_opened", F.coalesce("_opened", no)),
        ("minimum_unique_items", n >= F.col("expected_min_items")),
        ("maximum_unique_items", n <= F.col("expected_max_items")),
        ("required_field_coverage_80pct", F.coalesce("_fields", no)),
        ("known_anchor_present", anchor),
        ("no_unrequested_detail_batch", F.coalesce("allow_detail_batch", no) | ~F.coalesce("_detail", no)),
        ("autonomous_completion", F.col("status") == "completed"),
        ("chinese_title_ratio", F.when(F.col("minimum_chinese_title_ratio") > 0, ratio("_cjk") >= F.col("minimum_chinese_title_ratio"))),
        ("content_relevance", F.when(F.col("minimum_relevant_item_ratio") > 0, ratio("_relevant") >= F.col("minimum_relevant_item_ratio"))),
    ]
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named]), lambda e: e["value"].isNotNull()
    )
    df = df.withColumn("checks", F.map_from_entries(entries))
    passed = F.size(F.filter(F.map_values("checks"), lambda x: x))
    return df.select(
        "run_id", "case_key", "status", "checks",
        F.round(passed * 100.0 / F.size("checks"), 1).alias("accuracy_score"),
        n.cast("long").alias("unique_item_count"),
        F.round(ratio("_cjk"), 3).alias("chinese_title_ratio"),
        F.round(ratio("_relevant"), 3).alias("relevant_item_ratio"),
        anchor.alias("anchor_match"),
        F.coalesce("_detail", no).alias("detail_batch_ran"),
    )

"""What a page offers: search, navigation, forms, pagination, content and coverage.

All inputs are snapshot node tables; lists are whole unless a limit is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import any_of
from reapline.functions.text import ellipsize
from reapline.functions.url import stripped
from reapline.plans.ranking import top_k

KEY = "snapshot_id"

# Words that mark search, paging and navigation controls.
SEARCH_WORDS = ("搜索", "search", "検索", "查找", "keyword", "关键词")
NEXT_WORDS = ("下一页", "下一頁", "next", ">", "→", "›", "》", "next page", "forward")
PREVIOUS_WORDS = ("上一页", "上一頁", "prev", "previous", "<", "←", "‹", "《", "prev page", "back")
NAVIGATION_WORDS = ("首页", "主页", "home", "Home", "index", "Index", "关于", "about", "About", "联系", "contact", "Contact")

# How many entries of each kind a bounded view shows.
VIEW_LIMITS = {
    "search_area": 3, "navigation": 5, "form": 5, "data_region": 5, "pagination": 5, "content_region": 5, "dialog": 3,
    "primary_action": 12,
}


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _text(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def _is(kind_role: str, *tags: str) -> Column:
    return (_low("role") == kind_role) | _low("tag").isin(*tags)


def search_areas(nodes: DataFrame, max_inputs: int | None = None, max_buttons: int | None = None, reach: int = 5) -> DataFrame:
    """Search inputs with the search buttons that share a near ancestor.

    ``nodes`` carries ``ancestors`` (refs from the root down).  The nearest ``reach``
    ancestors of both sides are matched by equality.
    """
    text = F.lower(_text("text", "name", "placeholder"))
    has_word = text.rlike(any_of([w.lower() for w in SEARCH_WORDS]))
    role, tag = _low("role"), _low("tag")
    is_input = role.isin("searchbox", "textbox") | ((tag == "input") & _low("input_type").isin("text", "search"))
    inputs = top_k(nodes.where(is_input & (has_word | (role == "searchbox"))), [KEY], ["ord"], max_inputs, "input_no")
    inputs = inputs.select(
        KEY, F.col("ref").alias("input_ref"), _text("name", "placeholder").alias("input_name"), "input_no",
        F.concat(F.slice(F.reverse("ancestors"), 1, reach), F.array("ref")).alias("_up"),
    )
    buttons = nodes.where((_is("button", "button", "a")) & has_word).select(
        KEY, F.col("ref").alias("button_ref"), "ord", F.concat(F.slice(F.reverse("ancestors"), 1, reach - 1), F.array("ref")).alias("_up")
    )
    pairs = (
        inputs.select(KEY, "input_ref", F.explode("_up").alias("_a"))
        .join(buttons.select(KEY, "button_ref", "ord", F.explode("_up").alias("_a")), [KEY, "_a"])
        .groupBy(KEY, "input_ref", "button_ref").agg(F.min("ord").alias("ord"))
    )
    nearest = (
        top_k(pairs, [KEY, "input_ref"], ["ord"], max_buttons, "n")
        .groupBy(KEY, "input_ref").agg(F.array_sort(F.collect_list(F.struct("n", "button_ref"))).alias("_b"))
        .select(KEY, "input_ref", F.transform("_b", lambda b: b["button_ref"]).alias("nearby_buttons"))
    )
    return (
        inputs.drop("_up").join(nearest, [KEY, "input_ref"], "left")
        .withColumn("nearby_buttons", F.coalesce("nearby_buttons", F.array().cast("array<string>")))
    )


def navigation(nodes: DataFrame, limit: int | None = None, max_links: int | None = None) -> DataFrame:
    """Navigation elements first, then parents that hold at least two navigation links."""
    own = nodes.where(_is("navigation", "nav")).select(
        KEY, F.lit(0).alias("_rank"), "ord", F.col("ref"), F.lit("navigation").alias("kind"), F.lit(None).cast("bigint").alias("link_count"),
        F.array().cast("array<string>").alias("links"),
    )
    words = _text("text", "name").rlike(any_of(NAVIGATION_WORDS))
    linked = top_k_links(nodes.where(~_is("navigation", "nav") & _is("link", "a") & words), max_links)
    groups = linked.where("link_count >= 2").select(
        KEY, F.lit(1).alias("_rank"), "ord", F.col("parent_ref").alias("ref"), F.lit("navigation_links").alias("kind"), "link_count", "links"
    )
    return top_k(own.unionByName(groups), [KEY], ["_rank", "ord", "ref"], limit, "entry_no").drop("_rank", "ord")


def top_k_links(links: DataFrame, max_links: int | None) -> DataFrame:
    counted = links.groupBy(KEY, "parent_ref").agg(F.count(F.lit(1)).alias("link_count"), F.min("ord").alias("ord"))
    first = (
        top_k(links.select(KEY, "parent_ref", "ref", F.col("ord").alias("_o")), [KEY, "parent_ref"], ["_o"], max_links, "n")
        .groupBy(KEY, "parent_ref").agg(F.array_sort(F.collect_list(F.struct("n", "ref"))).alias("_l"))
        .select(KEY, "parent_ref", F.transform("_l", lambda x: x["ref"]).alias("links"))
    )
    return counted.join(first, [KEY, "parent_ref"])


def forms(nodes: DataFrame, limit: int | None = None, max_fields: int | None = None) -> DataFrame:
    """Form elements first, then parents that hold input controls."""
    is_form = _is("form", "form")
    own = nodes.where(is_form).select(
        KEY, F.lit(0).alias("_rank"), "ord", "ref", F.lit("form").alias("kind"), F.array().cast("array<string>").alias("inputs"),
        F.array().cast("array<string>").alias("buttons"),
    )
    is_input = _low("role").isin("textbox", "searchbox", "combobox", "checkbox", "radio") | _low("tag").isin("input", "textarea", "select")
    is_button = _is("button", "button")
    controls = nodes.where(~is_form & (is_input | is_button)).select(
        KEY, "parent_ref", "ref", "ord", F.explode(F.array_compact(F.array(F.when(is_input, "input"), F.when(is_button, "button")))).alias("part")
    )
    place = controls.groupBy(KEY, "parent_ref").agg(F.min("ord").alias("ord"), F.bool_or(F.col("part") == "input").alias("_some"))
    listed = (
        top_k(controls.withColumnRenamed("ord", "_o"), [KEY, "parent_ref", "part"], ["_o"], max_fields, "n")
        .groupBy(KEY, "parent_ref").agg(F.array_sort(F.collect_list(F.struct("n", "part", "ref"))).alias("_c"))
    )
    of = lambda part: F.transform(F.filter("_c", lambda c: c["part"] == part), lambda c: c["ref"])
    groups = place.where("_some").join(listed, [KEY, "parent_ref"]).select(
        KEY, F.lit(1).alias("_rank"), "ord", F.col("parent_ref").alias("ref"), F.lit("form_group").alias("kind"), of("input").alias("inputs"),
        of("button").alias("buttons"),
    )
    return top_k(own.unionByName(groups), [KEY], ["_rank", "ord", "ref"], limit, "entry_no").drop("_rank", "ord")


def page_controls(nodes: DataFrame) -> DataFrame:
    """Links and buttons that page through a list, with their direction."""
    text = _text("text", "name")
    label = stripped(text)
    low = F.lower(text)
    number = F.when(label.rlike(r"^\d{1,9}$"), label.cast("int")).between(1, 999)
    direction = (
        F.when(low.rlike(any_of(NEXT_WORDS)), "next").when(low.rlike(any_of(PREVIOUS_WORDS)), "prev").when(number, "page_number")
    )
    enabled = ~F.contains(F.lower(_text("name", "text")), F.lit("disabled"))
    wanted = nodes.where((_low("role").isin("button", "link") | _low("tag").isin("a", "button")) & (label != ""))
    return wanted.select(
        KEY, F.coalesce("parent_ref", F.lit("")).alias("parent_ref"), "ref", "ord", label.alias("label"), direction.alias("direction"),
        enabled.alias("enabled"),
    ).where(F.col("direction").isNotNull())


def pagination_groups(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Parents whose controls page through a list."""
    moves = F.col("direction").isin("next", "prev")
    groups = page_controls(nodes).groupBy(KEY, "parent_ref").agg(
        F.count(F.lit(1)).alias("controls"),
        F.bool_or(moves).alias("has_moves"),
        F.bool_or(F.col("direction") == "page_number").alias("has_numbers"),
        F.min("ord").alias("ord"),
    )
    accepted = groups.where(F.col("has_moves") | (F.col("has_numbers") & (F.col("controls") >= 2)))
    named = accepted.withColumn("group_id", F.concat(F.lit("g_pagination_"), F.substring(F.md5("parent_ref"), 1, 8)))
    return top_k(named, [KEY], ["ord", "parent_ref"], limit, "entry_no").drop("ord")


def content_regions(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    hit = _low("role").isin("main", "article", "section", "region") | _low("tag").isin("main", "article", "section")
    return _listed(nodes.where(hit), "content_region", limit)


def dialogs(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    return _listed(nodes.where(_low("role") == "dialog"), "dialog", limit)


def primary_actions(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Buttons and links that do none of the recognised things."""
    words = [w.lower() for w in (*SEARCH_WORDS, *NEXT_WORDS, *PREVIOUS_WORDS, *NAVIGATION_WORDS)]
    text = _text("text", "name")
    hit = ((_low("role") == "button") | _low("tag").isin("button", "a")) & (text != "") & ~F.lower(text).rlike(any_of(words))
    return _listed(nodes.where(hit).withColumn("name", text), "primary_action", limit)


def _listed(nodes: DataFrame, kind: str, limit: int | None) -> DataFrame:
    chosen = nodes.select(KEY, "ref", "ord", _low("role").alias("role"), _low("tag").alias("tag"), "name", F.lit(kind).alias("kind"))
    return top_k(chosen, [KEY], ["ord", "ref"], limit, "entry_no").drop("ord")


def region_actions(ref: Column, kind: Column, item_count: Column) -> Column:
    """What may be done with a data region."""
    return F.array_compact(
        F.array(
            F.when(ref.rlike("^[rg]"), F.lit("expand")),
            F.when(item_count >= 3, F.lit("list-items")),
            F.when(kind.isin("list", "table", "card_grid", "repeated_structure"), F.lit("extract")),
            F.when(kind.isin("list", "table", "card_grid"), F.lit("batch-detail-extract_candidate")),
        )
    )


def format_regions(regions: DataFrame, limit: int | None = None) -> DataFrame:
    """Data regions of every snapshot in page order with their permitted actions."""
    acted = regions.withColumn("available_actions", region_actions(F.col("ref"), F.col("kind"), F.col("item_count")))
    return top_k(acted, [KEY], ["ord", "ref"], limit, "region_no")


def page_groups(nodes: DataFrame, regions: DataFrame, min_items: int = 3, max_regions: int | None = None) -> DataFrame:
    """Search areas, pagination and repeated data of every page in one table."""
    ident = lambda prefix, c: F.concat(F.lit(prefix), F.substring(F.md5(c), 1, 8))
    search = search_areas(nodes).select(
        KEY, ident("g_search_", "input_ref").alias("group_id"), F.lit("search_area").alias("kind"),
        (F.size("nearby_buttons") + 1).cast("long").alias("count"), F.col("input_ref").alias("ref"),
    )
    paging = pagination_groups(nodes).select(
        KEY, "group_id", F.lit("pagination").alias("kind"), F.col("controls").alias("count"), F.col("parent_ref").alias("ref")
    )
    data = top_k(regions, [KEY], ["ord", "ref"], max_regions, "n").where(F.col("item_count") >= min_items).select(
        KEY, ident("g_repeated_data_", "ref").alias("group_id"), F.lit("repeated_data_items").alias("kind"),
        F.col("item_count").cast("long").alias("count"), "ref",
    )
    return search.unionByName(paging).unionByName(data)


def group_coverage(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """How much of a page its groups stand for."""
    total = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("total_nodes"))
    grouped = groups.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("groups_collapsed"), F.sum("count").alias("count_omitted"), F.max("count").alias("largest_group")
    )
    zero = F.lit(0).cast("long")
    filled = {c: F.coalesce(c, zero) for c in ("groups_collapsed", "count_omitted", "largest_group")}
    df = total.join(grouped, KEY, "left").withColumns(filled)
    return df.withColumn("shown", F.greatest(zero, F.col("total_nodes") - F.col("count_omitted")))


def bounded_view(entries: DataFrame, text_columns: list[str], limits: dict[str, int] | None = None, length: int = 160) -> DataFrame:
    """Capped entries per kind with shortened texts.

    ``entries``: snapshot, kind, entry_no and text columns; kinds without limit are dropped.
    """
    caps = limits or VIEW_LIMITS
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    shown = top_k(entries, [KEY, "kind"], ["entry_no"], max(caps.values()), "_n").where(F.col("_n") <= cap).drop("_n")
    return shown.withColumns({c: F.nullif(ellipsize(c, length), F.lit("")) for c in text_columns})

"""Requests met with page elements, regions and controls.

Requests and nodes meet only inside their snapshot.  Every candidate is judged before any
is left out; rankings then keep the best of a request through a group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import any_of
from reapline.functions.url import let, stripped
from reapline.operators.snapshots import find_text, text_index
from reapline.plans.ranking import top_k

KEY = "snapshot_id"

# Tags and roles that frame a page, fields of statistics tables and quotes,
# and the words that speak of paging.
FRAME_TAGS = ("nav", "header", "footer")
FRAME_ROLES = ("navigation", "banner", "contentinfo", "tablist")
TABLE_FIELDS = ("team", "year", "wins", "losses")
QUOTE_FIELDS = ("text", "author", "tags")
QUOTE_WORDS = ("quote", "author", "tags", "albert")
PAGING_WORDS = ("pagination", "page ", "page_", "页码", "分页", "下一页", "上一页")
NEXT_HINTS, PREVIOUS_HINTS = ("下一页", "next", "forward"), ("上一页", "prev", "previous", "back")


def _low(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _none() -> Column:
    return F.array().cast("array<string>")


def confidence(name: Column, text: Column, hint: Column, interactable: Column, visible: Column) -> Column:
    """How well a node answers a hint: 0.5 plus text agreement, readiness and visibility."""
    words = F.filter(F.split(hint, r"\s+"), lambda w: F.length(w) >= 2)
    agreement = (
        F.when(hint == "", 0.0)
        .when(F.contains(name, hint) | F.contains(text, hint), 0.3)
        .when(F.contains(hint, name) | F.contains(hint, text), 0.2)
        .when(F.exists(words, lambda w: F.contains(name, w) | F.contains(text, w)), 0.15)
        .otherwise(0.0)
    )
    extra = F.when(interactable, 0.1).otherwise(0.0) + F.when(visible, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(F.lit(0.5) + agreement + extra, 2))


def candidates(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Nodes a request may mean, all of them, numbered in the order the rules find them.

    ``requests``: request_id, snapshot_id, intent, target_hint, roles, texts, region_hint,
    near, exclude (arrays may be null).  Order: the named region alone; nodes with a hint's
    text; nodes of the role; token hits; then neighbours of ``near``.
    """
    none = _none()
    asked = requests.select(
        "request_id", KEY, F.col("intent"), F.coalesce("target_hint", F.lit("")).alias("target_hint"), F.coalesce("roles", none).alias("roles"),
        F.coalesce("texts", none).alias("texts"), F.coalesce("region_hint", F.lit("")).alias("region_hint"),
        F.coalesce("near", F.lit("")).alias("near"), F.coalesce("exclude", none).alias("exclude"),
    )
    roles = F.transform("roles", lambda r: F.lower(r))
    of_role = (F.size("roles") == 0) | F.array_contains(roles, _low("role"))
    of_type = F.when(F.col("intent").isin("click", "type"), F.col("ref_type") == "element").otherwise(
        ~F.col("intent").isin("expand", "list-items", "extract") | F.col("ref_type").isin("element", "container")
    )
    slim = nodes.select(KEY, "ref", "ref_type", "role", "name", "text", "placeholder", "parent_ref", "ord")
    hit = lambda df, tier, hint="0": df.select("request_id", "ref", F.lit(tier).alias("tier"), F.expr(hint).alias("hint_no"), "ord")
    without = lambda df, *found: _minus(df, found)

    region = hit(asked.where("region_hint <> ''").join(slim, KEY).where(F.col("ref") == F.col("region_hint")), 0)
    open_ = without(asked, region)
    hints = F.when(F.size("texts") > 0, F.col("texts")).when(F.col("target_hint") != "", F.array("target_hint")).otherwise(none)
    worded = open_.select("request_id", KEY, "intent", "roles", F.posexplode(hints).alias("hint_no", "_hint"))
    needle = F.lower("_hint")
    holds = F.contains(_low("text"), needle) | F.contains(_low("name"), needle) | F.contains(_low("placeholder"), needle)
    by_text = hit(worded.join(slim, KEY).where(of_role & of_type & holds), 1, "hint_no")
    rest = without(open_, by_text)
    by_role = hit(rest.where(F.size("roles") > 0).join(slim, KEY).where(of_role & of_type), 2)
    index = text_index(nodes)
    left = without(rest, by_role).where("target_hint <> ''")
    found = find_text(index, nodes, left.select("request_id", KEY, F.col("target_hint").alias("text")))
    by_token = hit(
        found.select("request_id", KEY, "ref").join(left.select("request_id", "roles"), "request_id").join(slim, [KEY, "ref"]).where(of_role), 3
    )
    near = asked.where("near <> '' and region_hint = ''")
    anchor = find_text(index, nodes, near.select("request_id", KEY, F.col("near").alias("text")), limit=1)
    parent = anchor.select("request_id", KEY, "ref").join(slim.select(KEY, "ref", F.col("parent_ref").alias("_p")), [KEY, "ref"]).drop("ref")
    around = (
        parent.where(F.coalesce("_p", F.lit("")) != "").join(near.select("request_id", "roles"), "request_id").join(slim, KEY)
        .where((F.col("parent_ref") == F.col("_p")) & (F.col("ref_type") == "element") & of_role)
    )
    by_near = hit(around, 4)
    every = region.unionByName(by_text).unionByName(by_role).unionByName(by_token).unionByName(by_near)
    place = F.struct("tier", "hint_no", "ord")
    unique = every.groupBy("request_id", "ref").agg(F.min(place).alias("_at"))
    full = (
        unique.join(asked, "request_id")
        .join(nodes.select(KEY, "ref", "name", "text", "interactable_now", "in_viewport", "role", "tag"), [KEY, "ref"])
    )
    body = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    barred = let(body, lambda b: F.exists("exclude", lambda x: (stripped(x) != "") & F.contains(b, F.lower(stripped(x)))))
    return top_k(full.where(~barred), ["request_id"], ["_at", "ref"], None, "candidate_no").drop("_at")


def _minus(requests: DataFrame, found) -> DataFrame:
    df = requests
    for hits in found:
        df = df.join(hits.select("request_id").distinct(), "request_id", "left_anti")
    return df


def match_elements(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """One decision per request: selected element, approval needed, or nothing found.

    Adds to the candidate columns of ``requests`` the optional ``exact_text``.
    """
    pack = candidates(nodes, requests)
    hints = F.concat(F.array(F.lower("target_hint")), F.transform(F.filter("texts", lambda t: stripped(t) != ""), lambda t: F.lower(t)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    scored = pack.withColumn(
        "confidence",
        F.array_max(F.transform(hints, lambda h: confidence(_low("name"), _low("text"), h, yes("interactable_now"), yes("in_viewport")))),
    )
    exact_column = F.col("exact_text") if "exact_text" in requests.columns else F.lit(None).cast("string")
    stated = requests.select(
        "request_id",
        F.filter(F.transform(F.concat(F.coalesce("texts", _none()), F.array(F.coalesce(exact_column, F.lit("")))), lambda t: F.lower(stripped(t))), lambda t: t != "").alias("_stated"),
    )
    rows = scored.join(stated, "request_id").withColumn(
        "_exact", F.array_contains("_stated", F.lower(stripped("name"))) | F.array_contains("_stated", F.lower(stripped("text")))
    )
    rows = top_k(rows, ["request_id"], [F.desc("confidence"), "candidate_no"], None, "_place")
    strong = F.col("confidence") > 0.7
    at = lambda place, c: F.max(F.when(F.col("_place") == place, F.col(c)))
    per = rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        at(1, "ref").alias("_best_ref"), at(1, "confidence").alias("_best"), at(2, "confidence").alias("_second"),
        F.count_if("_exact").alias("_exact"),
        F.min(F.when(F.col("_exact"), F.col("ref"))).alias("_exact_ref"),
        F.count_if(strong).alias("_strong"),
        F.count_distinct(F.when(strong, F.coalesce("name", F.lit("")))).alias("_names"),
        F.count_distinct(F.when(strong, F.coalesce("text", F.lit("")))).alias("_texts"),
    )
    top, gap = F.col("_best"), F.col("_best") - F.coalesce("_second", F.lit(0.0))
    clash = (F.col("_names") < F.col("_strong")) | (F.col("_texts") < F.col("_strong"))
    chosen = (
        F.when(F.col("_exact") == 1, F.struct(F.col("_exact_ref").alias("ref"), F.lit(1.0).alias("confidence")))
        .when((F.col("candidates") == 1) & (top >= 0.8), F.struct(F.col("_best_ref").alias("ref"), top.alias("confidence")))
        .when(~clash & (top >= 0.85) & (F.round(gap, 2) >= 0.2), F.struct(F.col("_best_ref").alias("ref"), top.alias("confidence")))
    )
    decided = per.withColumns({"_c": chosen, "has_conflict": clash})
    df = requests.select("request_id", KEY).join(decided, "request_id", "left")
    status = F.when(F.col("_c").isNotNull(), "selected").when(F.col("candidates") > 0, "need_approval").otherwise("not_found")
    return df.select(
        "request_id", KEY, status.alias("status"), F.col("_c.ref").alias("target_ref"), F.col("_c.confidence").alias("confidence"),
        F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"),
    )


def match_pagination(controls: DataFrame, requests: DataFrame) -> DataFrame:
    """The one enabled paging control a click request means, if there is exactly one.

    ``controls``: snapshot_id, ref, label, direction, enabled.  ``requests``: request_id,
    snapshot_id, intent, target_hint, region_hint, texts.
    """
    blob = F.lower(F.concat_ws(" ", "target_hint", "region_hint"))
    direction = F.when(blob.rlike(any_of(NEXT_HINTS)), "next").when(blob.rlike(any_of(PREVIOUS_HINTS)), "prev")
    digits = F.regexp_extract_all(F.coalesce("target_hint", F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    labels = F.concat(F.transform(F.coalesce("texts", _none()), lambda t: F.lower(stripped(t))), digits)
    asked = requests.where((F.lower("intent") == "click") & blob.rlike(any_of(PAGING_WORDS))).select(
        "request_id", KEY, direction.alias("_dir"), labels.alias("_labels")
    )
    usable = controls.where(F.col("ref").rlike(r"^e\d+$") & F.coalesce("enabled", F.lit(True)))
    meant = F.array_contains("_labels", F.lower(stripped("label"))) | F.coalesce(F.col("_dir") == F.lower("direction"), F.lit(False))
    hits = asked.join(usable, KEY).where(meant).groupBy("request_id").agg(F.count_distinct("ref").alias("_n"), F.min("ref").alias("target_ref"))
    return hits.where("_n = 1").drop("_n")


def next_page_ref(controls: DataFrame, runs: DataFrame) -> DataFrame:
    """Control that leads to a page: its number if shown, else the last "next" control.

    ``runs``: run_id, snapshot_id, page_number.  ``controls`` also carry ``ord``.
    """
    usable = controls.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("ref", F.lit("")) != ""))
    pairs = runs.join(usable, KEY)
    is_number = stripped("label") == F.col("page_number").cast("string")
    is_next = F.lower("direction") == "next"
    picked = pairs.where(is_number | is_next).groupBy("run_id").agg(
        F.min_by("ref", F.when(is_number, F.col("ord"))).alias("_n"), F.max_by("ref", F.when(is_next, F.col("ord"))).alias("_x")
    )
    return runs.join(picked, "run_id", "left").withColumn("target_ref", F.coalesce("_n", "_x")).drop("_n", "_x")


def region_candidates(regions: DataFrame, failed: DataFrame) -> DataFrame:
    """Regions of a run that have not failed in it."""
    return regions.where(F.coalesce("ref", F.lit("")) != "").join(failed.select("run_id", "ref"), ["run_id", "ref"], "left_anti")


def region_score(schema: Column, required: Column) -> Column:
    """Fitness of a data region for a contract; reads the region columns."""
    tag, role, kind = _low("tag"), _low("role"), _low("kind")
    blob = F.lower(F.concat_ws(" ", "name", "kind", "tag", "role", "why", F.array_join(F.coalesce("samples", _none()), " ")))
    any_field = lambda *names: F.arrays_overlap(schema, F.array(*[F.lit(n) for n in names]))
    words = lambda names: sum((F.contains(blob, F.lit(n)).cast("int") for n in names), F.lit(0)) * 80
    items = F.coalesce("item_count", F.lit(0))
    table_like = (kind == "table") | (tag == "table") | (role == "table")
    both = F.array_contains(schema, "title") & F.array_contains(schema, "url")
    parts = [
        F.coalesce(F.nullif("source_score", F.lit(0)), F.lit(0)),
        F.when(tag.isin(*FRAME_TAGS) | role.isin(*FRAME_ROLES), -1500).otherwise(0),
        F.when(any_field(*TABLE_FIELDS), F.when(table_like, 1800).otherwise(-800) + words(TABLE_FIELDS)).otherwise(0),
        F.when(any_field(*QUOTE_FIELDS), F.when(kind.isin("repeated_structure", "list", "card_grid"), 650).otherwise(0) + words(QUOTE_WORDS)).otherwise(0),
        F.when(
            F.array_contains(schema, "price"),
            F.when(kind.isin("card_grid", "list", "repeated_structure"), 750).otherwise(0) + F.when(blob.rlike(r"\b\d+\.\d{2}\b"), 250).otherwise(0),
        ).otherwise(0),
        F.when(both, F.when(kind.isin("list", "card_grid"), 500).otherwise(120)).otherwise(0),
        F.when(items >= required, 220).otherwise(0),
        -F.least(F.abs(items - required), F.lit(100)),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.when(F.array_contains("available_actions", "extract"), total).otherwise(-10000)


def rank_regions(regions: DataFrame, contracts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Best region of every run under its contract; only a positive score counts."""
    usable = regions if failed is None else region_candidates(regions, failed)
    scored = usable.join(contracts.select("run_id", "schema", "required_count"), "run_id").withColumn(
        "region_score", region_score(F.col("schema"), F.col("required_count"))
    )
    return top_k(scored.drop("schema", "required_count"), ["run_id"], [F.desc("region_score"), "ord", "ref"], 1, "_n").where("region_score > 0").drop("_n")


def rank_regions_by_hint(regions: DataFrame, requests: DataFrame, margin: int = 15) -> DataFrame:
    """Region a data request means, unless two different regions score within the margin.

    ``requests``: run_id, intent, target_hint, region_hint, texts, want_kind, want_count.
    """
    hints = F.filter(
        F.transform(F.concat(F.array("target_hint", "region_hint"), F.coalesce("texts", _none())), lambda h: F.lower(stripped(h))),
        lambda h: F.coalesce(h != "", F.lit(False)),
    )
    blob = F.lower(F.concat_ws(" ", "ref", "name", "kind", F.array_join(F.coalesce("samples", _none()), " ")))
    points = lambda h: (
        F.when(h == F.lower("ref"), 100).when(F.contains(blob, h), 30)
        .when(F.exists(F.split(h, r"\s+"), lambda w: (w != "") & F.contains(blob, w)), 10).otherwise(0)
    )
    acts = lambda a: F.array_contains("available_actions", a)
    fits = F.col("intent").isin("extract", "list-items", "expand") & F.array_contains("available_actions", F.col("intent"))
    items, source = F.coalesce("item_count", F.lit(0)), F.coalesce("source_score", F.lit(0))
    score = (
        F.when(fits, 50).when(acts("extract"), 20).otherwise(0)
        + F.when(F.coalesce(F.col("want_count") == items, F.lit(False)), 10).otherwise(0)
        + F.when(F.coalesce(F.col("want_kind") == F.col("kind"), F.lit(False)), 15).otherwise(0)
        + F.aggregate(F.transform(hints, points), F.lit(0), lambda acc, p: acc + p)
        + F.least(items, F.lit(50)) + F.least(F.floor(F.greatest(source, F.lit(0)) / 20), F.lit(30)).cast("int")
    )
    signature = F.md5(F.concat_ws("\u0001", _low("kind"), _low("name"), items.cast("string"), F.array_join(F.slice(F.coalesce("samples", _none()), 1, 3), "\u0002")))
    named = F.array_contains(F.array(_low("target_hint"), _low("region_hint")), F.lower("ref"))
    scored = regions.join(requests, "run_id").select(
        "run_id", "ref", "ord", score.alias("hint_score"), source.alias("source_score"), signature.alias("_sig"), named.alias("_named"),
        (F.size(F.coalesce("samples", _none())) > 0).alias("_sampled"),
    )
    two = top_k(scored, ["run_id"], [F.desc("hint_score"), "ord", "ref"], 2, "n")
    first = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    second = lambda c: F.max(F.when(F.col("n") == 2, F.col(c)))
    per = two.groupBy("run_id").agg(
        first("ref").alias("ref"), first("hint_score").alias("hint_score"), second("hint_score").alias("_s2"),
        first("source_score").alias("_src1"), second("source_score").alias("_src2"), first("_sig").alias("_sig1"), second("_sig").alias("_sig2"),
        first("_named").alias("_named"), first("_sampled").alias("_sampled"),
    )
    close = F.coalesce(F.col("hint_score") - F.col("_s2") < margin, F.lit(False)) & ~F.col("_named")
    wrapper = (F.col("_sig1") == F.col("_sig2")) & F.col("_sampled") & (F.col("_src1") > F.col("_src2"))
    ambiguous = close & ~F.coalesce(wrapper, F.lit(False))
    return per.select("run_id", F.when(~ambiguous, F.col("ref")).alias("ref"), "hint_score", ambiguous.alias("is_ambiguous"))


def rank_filter_inputs(inputs: DataFrame, filters: DataFrame) -> DataFrame:
    """Input to type a filter into.

    ``inputs``: run_id, ref, source (search or form), name, role, input_type, ord.
    ``filters``: run_id, field_hint.
    """
    hint = F.lower(stripped(F.coalesce("field_hint", F.lit(""))))
    search = F.col("source") == "search"
    typed = _low("role").isin("textbox", "searchbox") | _low("input_type").isin("text", "search")
    score = (
        F.when(search, 100).otherwise(80)
        + F.when((hint != "") & F.contains(_low("name"), hint), 30).otherwise(0)
        + F.when(~search & ((_low("role") == "searchbox") | (_low("input_type") == "search")), 20).otherwise(0)
    )
    usable = inputs.where(F.col("ref").rlike(r"^e\d+$") & (search | typed)).join(filters, "run_id").withColumn("input_score", score)
    return top_k(usable, ["run_id"], [F.desc("input_score"), "ord", "ref"], 1, "_n").drop("_n")


def anchor_match(items: DataFrame, anchors: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether any anchor text of a run occurs in its records.

    ``anchors``: run and ``anchor_values``; a run without anchors matches.
    """
    corpus = F.lower(F.to_json("fields"))
    hits = (
        items.join(anchors.select(key, "anchor_values"), key)
        .groupBy(key).agg(F.bool_or(F.exists("anchor_values", lambda a: F.contains(corpus, F.lower(a)))).alias("_hit"))
    )
    empty = F.coalesce(F.size("anchor_values"), F.lit(0)) <= 0
    return anchors.join(hits, key, "left").select(key, (empty | F.coalesce("_hit", F.lit(False))).alias("anchor_match"))


def audit_cases(cases: DataFrame, region_pairs: DataFrame, evaluations: DataFrame, anchored: DataFrame, key: str = "case_key") -> DataFrame:
    """Replayed cases: was the region found, did the projection pass, and both.

    ``region_pairs``: case and ``matches``; ``evaluations``: case and ``is_success``;
    ``anchored``: case and ``anchor_match``.
    """
    found = region_pairs.groupBy(key).agg(F.bool_or("matches").alias("_found"))
    df = cases.join(found, key, "left").join(evaluations.select(key, "is_success"), key, "left").join(anchored, key, "left")
    no = F.lit(False)
    df = df.withColumns(
        {
            "region_detected": F.coalesce("_found", no),
            "projection_pass": F.coalesce("is_success", no) & F.coalesce("anchor_match", no),
        }
    )
    return df.withColumn("component_pass", F.col("region_detected") & F.col("projection_pass")).drop("_found", "is_success", "anchor_match")

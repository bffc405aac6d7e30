"""Page snapshots: merged node tables, sibling groups, text index, search and deltas.

``nodes``: snapshot_id, ref, ref_type, tag, role, name, text, placeholder, label,
input_type, value, href, parent_ref, xpath, interactable_now, in_viewport, ord.
A snapshot describes one page; windows per snapshot are as long as a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reapline.functions.url import let, stripped
from reapline.functions.values import meaningful
from reapline.plans.ranking import top_k

# Text fields of a node, punctuation cut from tokens, roles of controls.
INDEXED = ("name", "text", "placeholder", "label", "input_type", "value")
SEARCHED = ("name", "text", "placeholder", "label")
PUNCTUATION = ".,;:!?\"'()[]{}"
INPUT_ROLES = ("textbox", "searchbox", "combobox")
INPUT_TAGS = ("input", "textarea", "select")
CLICK_ROLES = ("button", "link", "tab", "option", "menuitem")
CLICK_TAGS = ("button", "a")


def infer_ref_type(ref: Column, known: Column) -> Column:
    return F.coalesce(
        F.nullif(known, F.lit("")), F.when(ref.startswith("e"), "element"), F.when(ref.startswith("r"), "container")
    )


def merge_nodes(lists: list[DataFrame], key: str = "snapshot_id") -> DataFrame:
    """Union of node lists, one row per ref; the first list with a value decides a field.

    Map fields are merged entry by entry, earlier lists first.  Nodes without ref stay
    as they are.
    """
    tagged = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    at = F.struct("_list", "ord")
    fields = [f for f in every.schema.fields if f.name not in (key, "ref", "ord", "_list")]
    aggregates = []
    for field in fields:
        kind = field.dataType.typeName()
        c = F.col(field.name)
        if kind == "string":
            aggregates.append(F.min_by(c, F.when(c.isNotNull() & (c != ""), at)).alias(field.name))
        elif kind == "map":
            none = F.create_map().cast(field.dataType)
            aggregates.append(
                F.aggregate(
                    F.array_sort(F.collect_list(F.struct(at.alias("at"), F.map_entries(F.coalesce(c, none)).alias("m")))),
                    none,
                    lambda acc, e: F.map_zip_with(acc, F.map_from_entries(e["m"]), lambda _, x, y: F.coalesce(x, y)),
                ).alias(field.name)
            )
        elif kind == "array":
            aggregates.append(F.min_by(c, F.when(F.size(c) > 0, at)).alias(field.name))
        else:
            aggregates.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(field.name))
    named = every.where(F.coalesce("ref", F.lit("")) != "")
    merged = named.groupBy(key, "ref").agg(*aggregates, F.min(F.col("_list").cast("long") * 1_000_000_000 + F.col("ord")).alias("ord"))
    unnamed = every.where(F.coalesce("ref", F.lit("")) == "").drop("_list").withColumn("ord", F.col("ord").cast("long"))
    out = merged.unionByName(unnamed)
    return out.withColumn("ref_type", infer_ref_type(F.col("ref"), F.col("ref_type"))) if "ref_type" in out.columns else out


def sibling_groups(nodes: DataFrame, min_size: int = 3, samples: int = 5, key: str = "snapshot_id") -> DataFrame:
    """All siblings of one shape, neighbours or not, with aligned columns and samples."""
    parts = F.concat_ws("_", *[F.nullif(F.col(c), F.lit("")) for c in ("tag", "role", "input_type", "ref_type", "parent_ref")])
    member = F.struct("ord", "ref", "text", "name", "href", "role", "tag")
    groups = (
        nodes.withColumn("_shape", F.substring(F.md5(parts), 1, 12))
        .groupBy(key, F.coalesce(F.nullif("parent_ref", F.lit("")), F.lit("__root__")).alias("parent_ref"), "_shape")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.array_sort(F.collect_list(member)).alias("_m"),
            F.min_by("ref_type", "ord").alias("_ref_type"),
        )
        .where(F.col("count") >= min_size)
    )
    first = F.get("_m", F.lit(0))
    column = lambda c: F.transform("_m", lambda m: F.coalesce(m[c], F.lit("")))
    role, tag = F.coalesce(first["role"], F.lit("unknown")), F.coalesce(first["tag"], F.lit("unknown"))
    number = lambda r: F.coalesce(F.nullif(F.regexp_extract(r, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(-1))
    actions = F.array_compact(
        F.array(
            F.when(F.col("_ref_type") == "container", F.lit("expand")), F.lit("list-items"),
            F.when(role.isin("link", "button"), F.lit("click")),
        )
    )
    return groups.select(
        key, F.concat(F.lit("g_"), tag, F.lit("_"), F.col("_shape")).alias("group_id"), "parent_ref", "count", tag.alias("tag"),
        role.alias("role"), F.lit("repeated_structure").alias("kind"), column("ref").alias("refs"),
        F.transform("_m", lambda m: number(m["ref"])).alias("index"), *[column(c).alias(f"{c}s") for c in ("text", "name", "href")],
        F.slice("_m", 1, samples).alias("samples"), actions.alias("available_actions"),
    )


def ungrouped_nodes(nodes: DataFrame, groups: DataFrame, key: str = "snapshot_id") -> DataFrame:
    return nodes.join(groups.select(key, F.explode("refs").alias("ref")), [key, "ref"], "left_anti")


def expand_group(groups: DataFrame, nodes: DataFrame, limit: int | None = None, kind: str | None = None, key: str = "snapshot_id") -> DataFrame:
    """Members of every group, the first ``limit`` if given, as node rows."""
    chosen = groups.where(F.col("kind") == kind) if kind else groups
    refs = chosen.select(key, "group_id", F.posexplode("refs" if limit is None else F.slice("refs", 1, limit)).alias("member_no", "ref"))
    return refs.join(nodes, [key, "ref"])


def text_index(nodes: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Token table: which node says what in which field."""
    pairs = F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(c).alias("field"), stripped(c).alias("full")) for i, c in enumerate(INDEXED)])
    words = nodes.select(key, "ref", "ord", F.inline(F.filter(pairs, lambda p: F.coalesce(p["full"] != "", F.lit(False)))))
    tokens = F.filter(
        F.transform(F.split("full", r"\s+"), lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION))), lambda w: F.length(w) >= 2
    )
    return words.withColumn("token", F.explode(tokens))


def find_text(index: DataFrame, nodes: DataFrame, requests: DataFrame, limit: int | None = None, key: str = "snapshot_id") -> DataFrame:
    """Nodes a text points at: token hits, and substring hits only where no token hits.

    ``requests``: request_id, snapshot, text, optional scope_parent.
    """
    wanted = requests.withColumn("_text", F.lower("text"))
    by_token = (
        wanted.select("request_id", key, F.explode(F.split("_text", r"\s+")).alias("token"))
        .join(index.select(key, "token", "ref", "ord", "field", "field_no", "full"), [key, "token"])
        .groupBy("request_id", key, "ref").agg(F.min("ord").alias("ord"), F.min_by("field", F.struct("field_no", "full")).alias("match_field"))
        .withColumn("match_kind", F.lit("token"))
    )
    missed = wanted.join(by_token.select("request_id").distinct(), "request_id", "left_anti").where(F.length(stripped("text")) >= 2)
    holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("_text"))
    field = F.coalesce(*[F.when(holds(f"_n_{c}"), F.lit(c)) for c in SEARCHED])
    texts = nodes.select(key, "ref", "ord", *[F.col(c).alias(f"_n_{c}") for c in SEARCHED])
    by_part = (
        missed.select("request_id", key, "_text").join(texts, key).withColumn("match_field", field)
        .where(F.col("match_field").isNotNull())
        .select("request_id", key, "ref", "ord", "match_field", F.lit("substring").alias("match_kind"))
    )
    hits = by_token.unionByName(by_part)
    if "scope_parent" in requests.columns:
        scope = requests.select("request_id", "scope_parent")
        hits = (
            hits.join(scope, "request_id").join(nodes.select(key, "ref", "parent_ref"), [key, "ref"])
            .where(F.col("scope_parent").isNull() | (F.col("scope_parent") == F.col("parent_ref"))).drop("scope_parent", "parent_ref")
        )
    return top_k(hits, ["request_id"], ["ord", "ref"], limit, "hit_no")


def search_nodes(
    nodes: DataFrame, *, role=None, tag=None, text=None, name=None, ref_type=None, parent_ref=None, region_refs: DataFrame | None = None,
    visible=False, interactable=False, limit: int | None = None, key: str = "snapshot_id",
) -> DataFrame:
    """Nodes that satisfy every given condition, the first ``limit`` per snapshot if given."""
    many = lambda v: [v] if isinstance(v, str) else list(v)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    df = nodes
    if role:
        df = df.where(low("role").isin([r.lower() for r in many(role)]))
    if tag:
        df = df.where(low("tag").isin([t.lower() for t in many(tag)]))
    if text:
        needle = F.lit(text.lower())
        df = df.where(F.contains(low("text"), needle) | F.contains(low("name"), needle) | F.contains(low("placeholder"), needle))
    if name:
        df = df.where(low("name") == name.lower())
    if ref_type:
        df = df.where(F.col("ref_type").isin(many(ref_type)))
    if parent_ref:
        df = df.where(F.col("parent_ref") == parent_ref)
    if region_refs is not None:
        df = df.join(region_refs.select(key, "ref"), [key, "ref"], "left_semi")
    if visible:
        df = df.where(F.coalesce("in_viewport", F.lit(False)))
    if interactable:
        df = df.where(F.coalesce("interactable_now", F.lit(False)))
    return df if limit is None else top_k(df, [key], ["ord", "ref"], limit, "hit_no")


def snapshot_summary(nodes: DataFrame, regions: DataFrame | None = None, key: str = "snapshot_id") -> DataFrame:
    """Counts of what a snapshot offers."""
    role, tag = F.coalesce("role", F.lit("")), F.coalesce("tag", F.lit(""))
    is_container = F.coalesce(F.col("ref_type") == "container", F.lit(False))
    is_input = (F.col("ref_type") == "element") & (role.isin(*INPUT_ROLES) | tag.isin(*INPUT_TAGS) | meaningful("input_type"))
    out = nodes.groupBy(key).agg(
        F.count_if(~is_container).alias("elements"),
        F.count_if(is_container).alias("containers"),
        F.count_if((role == "button") | (tag == "button")).alias("buttons"),
        F.count_if((role == "link") | (tag == "a")).alias("links"),
        F.count_if(is_input).alias("inputs"),
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if("interactable_now").alias("interactable_now"),
        F.count_if("in_viewport").alias("in_viewport"),
    )
    if regions is None:
        return out
    counted = regions.groupBy(key).agg(F.count(F.lit(1)).alias("regions"))
    return out.join(counted, key, "left").withColumn("regions", F.coalesce("regions", F.lit(0)))


def snapshot_delta(nodes: DataFrame, compared: list[str]) -> DataFrame:
    """What changed between a snapshot and the one before it in the session.

    ``nodes``: session, seq, ref and the compared columns.  Sequence numbers have no gaps.
    """
    seen = nodes.select("session", "seq", "ref", F.md5(F.to_json(F.struct(*compared))).alias("state"))
    known = seen.select("session", "seq").distinct()
    before = seen.select("session", (F.col("seq") + 1).alias("seq"), "ref", F.col("state").alias("_before"))
    before = before.join(known, ["session", "seq"], "left_semi")
    has_before = known.select("session", (F.col("seq") + 1).alias("seq")).join(known, ["session", "seq"], "left_semi")
    now = seen.join(has_before, ["session", "seq"], "left_semi")
    both = now.join(before, ["session", "seq", "ref"], "full")
    s, b = F.col("state"), F.col("_before")
    return both.groupBy("session", "seq").agg(
        F.count_if(s.isNotNull() & b.isNull()).alias("added"),
        F.count_if(s.isNull() & b.isNotNull()).alias("removed"),
        F.count_if(s.isNotNull() & b.isNotNull() & (s != b)).alias("changed"),
        F.count_if(s.isNotNull() & (s == b)).alias("unchanged"),
    )


def region_children(regions: DataFrame, nodes: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Members of every region."""
    members = nodes.select(key, F.col("parent_ref").alias("region_ref"), F.col("ref").alias("child_ref"), "ord")
    return regions.select(key, F.col("ref").alias("region_ref")).join(members, [key, "region_ref"])


def path_prefixes(xpath: Column) -> Column:
    """A path and all paths above it."""
    steps = F.split(F.regexp_replace(xpath, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def subtree(nodes: DataFrame, targets: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Nodes at or below each target: every node meets its own path prefixes by equality."""
    roots = targets.select(key, "target_ref").join(
        nodes.select(key, F.col("ref").alias("target_ref"), F.regexp_replace("xpath", "/+$", "").alias("_root")), [key, "target_ref"]
    )
    with_path = roots.where(F.coalesce("_root", F.lit("")) != "")
    below = nodes.select(key, "ref", F.explode(path_prefixes(F.col("xpath"))).alias("_root"))
    alone = roots.where(F.coalesce("_root", F.lit("")) == "").select(key, "target_ref", F.col("target_ref").alias("ref"))
    return with_path.join(below, [key, "_root"]).select(key, "target_ref", "ref").unionByName(alone)


def subtree_depth(nodes: DataFrame, targets: DataFrame, depth: int = 2, key: str = "snapshot_id") -> DataFrame:
    """Nodes down to ``depth`` levels below each target: one equality join per level."""
    edges = nodes.select(key, F.col("parent_ref").alias("_p"), F.col("ref").alias("_c"))
    roots = targets.select(key, "target_ref").join(nodes.select(key, F.col("ref").alias("target_ref")), [key, "target_ref"], "left_semi")
    level = roots.select(key, "target_ref", F.col("target_ref").alias("ref"), F.lit(0).alias("level"))
    found = level
    for d in range(1, depth + 1):
        level = (
            level.join(edges.withColumnRenamed("_p", "ref"), [key, "ref"])
            .select(key, "target_ref", F.col("_c").alias("ref"), F.lit(d).alias("level"))
        )
        found = found.unionByName(level)
    return found


def region_match(nodes: DataFrame, pairs: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Whether region and target lie on one path; without paths only equal refs match.

    ``pairs``: snapshot, region_ref, target_ref.
    """
    paths = nodes.select(key, F.col("ref").alias("_r"), F.regexp_replace("xpath", "/+$", "").alias("_x"))
    df = pairs.join(paths.withColumnsRenamed({"_r": "region_ref", "_x": "_rx"}), [key, "region_ref"], "left")
    df = df.join(paths.withColumnsRenamed({"_r": "target_ref", "_x": "_tx"}), [key, "target_ref"], "left")
    r, t = F.coalesce("_rx", F.lit("")), F.coalesce("_tx", F.lit(""))
    slash = F.lit("/")
    on_path = (r == t) | F.startswith(r, F.concat(t, slash)) | F.startswith(t, F.concat(r, slash))
    matched = F.when((r == "") | (t == ""), F.col("region_ref") == F.col("target_ref")).otherwise(on_path)
    return df.withColumn("matches", matched).drop("_rx", "_tx")


def near(nodes: DataFrame, anchors: DataFrame, limit: int | None = None, key: str = "snapshot_id") -> DataFrame:
    """Siblings of each anchor node.  ``anchors``: request_id, snapshot, ref."""
    parents = anchors.join(nodes.select(key, "ref", "parent_ref"), [key, "ref"]).where(F.coalesce("parent_ref", F.lit("")) != "")
    around = parents.select("request_id", key, "parent_ref").join(nodes, [key, "parent_ref"])
    return top_k(around, ["request_id"], ["ord", "ref"], limit, "hit_no")


def verify_ref(nodes: DataFrame, requests: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Whether a ref exists and suits the intent.  ``requests``: request_id, snapshot, ref, intent."""
    known = nodes.select(key, "ref", "ref_type", "role", "tag").withColumn("_known", F.lit(True))
    df = requests.join(known, [key, "ref"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = F.coalesce("_known", F.lit(False))
    clickable = text("role").isin(*CLICK_ROLES) | text("tag").isin(*CLICK_TAGS)
    issues = F.array_compact(
        F.array(
            F.when(~found, F.lit("ref_not_found")),
            F.when(found & F.col("intent").isin("click", "type") & (text("ref_type") != "element"), F.lit("element_expected")),
            F.when(found & (F.col("intent") == "click") & ~clickable, F.lit("not_clickable")),
        )
    )
    return df.withColumns({"issues": issues, "valid": F.size(issues) == 0}).drop("_known")


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """Text and document position of the container nodes, as the record rules read them."""
    number = F.regexp_extract("ref", r"^r(\d+)$", 1)
    text = F.coalesce(F.nullif(stripped("text"), F.lit("")), stripped("name"), F.lit(""))
    df = nodes.where(F.col("ref").rlike(r"^r\d+$")).withColumns({"n": number.cast("long"), "t": text})
    return df.withColumn("tag", F.lower(F.coalesce("tag", F.lit("")))).withColumn("role", F.lower(F.coalesce("role", F.lit(""))))


def table_rows(nodes: DataFrame, limit: int | None = None, key: str = "snapshot_id") -> DataFrame:
    """Team table records: the cells between one row element and the next; the first ``limit`` per snapshot if given."""
    w = Window.partitionBy(key).orderBy("n")
    is_row = (F.col("tag") == "tr") & (F.col("role") == "row")
    is_cell = (F.col("tag") == "td") & (F.col("t") != "")
    marked = ordered_nodes(nodes).where(is_row | is_cell).select(
        key, "n", is_row.cast("int").alias("opens"), F.when(is_cell, F.col("t")).alias("t")
    )
    cells = marked.withColumn("row_no", F.sum("opens").over(w)).where((F.col("row_no") > 0) & F.col("t").isNotNull())
    # cells of a row follow one another, so that every step reads the one order by n
    ahead = {name: F.lead("t", i).over(w) for i, name in enumerate(("year", "wins", "losses"), 1)}
    first = cells.withColumns(ahead | {"_before": F.lag("row_no").over(w), "_fourth": F.lead("row_no", 3).over(w)}).where(
        ~F.col("row_no").eqNullSafe(F.col("_before")) & (F.col("row_no") == F.col("_fourth")) & F.col("year").rlike(r"^\d{4}$")
    )
    records = first.select(key, "n", F.col("t").alias("team"), "year", "wins", "losses")
    return top_k(records, [key], ["n"], limit, "item_no").drop("n")


QUOTE = r"(?s)([“\"][^”\"]+[”\"])\s+by\s+(.+?)\s+\(about\)\s+Tags:\s*(.*?)(?=\s+[“\"]|\s+Next\b|$)"


def quote_blocks(nodes: DataFrame, limit: int | None = None, key: str = "snapshot_id", least: int | None = None) -> DataFrame:
    """Quote records: from the shortest text that holds enough of them, else from node order.

    The first ``limit`` per snapshot if given.  Enough are ``least``, or ``limit`` without
    it; with neither, node order alone is read.
    """
    least = limit if least is None else least
    count = lambda c, word: (F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)
    text = F.coalesce(F.nullif(stripped("text"), F.lit("")), stripped("name"), F.lit(""))
    enough = lambda n: F.lit(False) if least is None else n >= least
    whole = nodes.withColumn("t", text).where(enough(count(F.col("t"), "Tags:")) & enough(count(F.lower("t"), " by ")))
    parts = [F.regexp_extract_all("t", F.lit(QUOTE), F.lit(i)) for i in (1, 2, 3)]
    matched = whole.withColumn("_q", F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("q", "a", "g"))])).where(enough(F.size("_q")))
    best = matched.groupBy(key).agg(F.min_by("_q", F.struct(F.length("t"), "ord")).alias("_q"))
    tags_of = lambda c: F.filter(F.split(stripped(c), r"\s+"), lambda x: x != "")
    from_text = best.select(key, F.posexplode("_q" if limit is None else F.slice("_q", 1, limit)).alias("item_no", "_r")).select(
        key, (F.col("item_no") + 1).alias("item_no"), stripped("_r.q").alias("text"), stripped("_r.a").alias("author"), tags_of(F.col("_r.g")).alias("tags")
    )
    w = Window.partitionBy(key).orderBy("n")
    rows = ordered_nodes(nodes).join(best.select(key), key, "left_anti")
    t = F.col("t")
    is_quote = t.rlike("^[“\"‘]") & ~F.lower(t).rlike("^(by |tags:)") & ~F.contains(t, F.lit(" (about)"))
    is_author = (F.col("tag") == "small") & (t != "")
    is_tags = F.lower(t).startswith("tags:")
    after = F.when(is_tags, t).when(F.col("tag") == "small", F.lit(""))
    marked = rows.withColumns(
        {
            "quote": F.last(F.when(is_quote, t), ignorenulls=True).over(w.rowsBetween(-5, -1)),
            "_tags": F.first(after, ignorenulls=True).over(w.rowsBetween(1, 4)),
        }
    ).where(is_author & F.col("quote").isNotNull())
    tail = F.regexp_extract(F.coalesce("_tags", F.lit("")), r"(?s)^[^:]*:(.*)$", 1)
    from_order = top_k(marked, [key], ["n"], limit, "item_no").select(
        key, "item_no", F.col("quote").alias("text"), F.col("t").alias("author"), tags_of(tail).alias("tags")
    )
    return from_text.unionByName(from_order)


def price_by_title(nodes: DataFrame, items: DataFrame, limit: int | None = None, key: str = "snapshot_id") -> DataFrame:
    """Records with the first price that follows their heading; others are dropped.

    ``items``: snapshot, pos, title and further columns.
    """
    w = Window.partitionBy(key).orderBy("n").rowsBetween(1, 6)
    t = F.col("t")
    priced = (
        ordered_nodes(nodes)
        .withColumn("price", F.first(F.when(t.rlike(r"^(?:[$€£¥]\s*)?\d+\.\d{2}$"), t), ignorenulls=True).over(w))
        .where((F.col("tag") == "h3") & (t != "") & F.col("price").isNotNull())
        .groupBy(key, F.lower("t").alias("_t")).agg(F.max_by("price", "n").alias("price"))
    )
    wanted = items.withColumn("title", stripped("title")).where("title <> ''").withColumn("_t", F.lower("title"))
    joined = wanted.join(priced, [key, "_t"]).drop("_t")
    return joined if limit is None else top_k(joined, [key], ["pos"], limit, "item_no")


def enrich_records(nodes: DataFrame, items: DataFrame, contracts: DataFrame, limit: int, key: str = "snapshot_id") -> DataFrame:
    """Records of failing extractions rebuilt from the snapshot, where that satisfies the contract.

    The contract of a snapshot picks the rule: table rows, quotes or prices.
    """
    from reapline.operators.quality import evaluate_contract

    cleared = contracts.withColumn("min_items", F.lit(limit))
    failing = evaluate_contract(items, cleared, [key], ["pos"]).where(~F.col("is_success")).select(key)
    has = lambda *names: F.arrays_overlap("schema", F.array(*[F.lit(n) for n in names]))
    rule = (
        F.when(has("team", "year", "wins", "losses"), "table_rows").when(has("text", "author", "tags"), "quote_blocks")
        .when(has("price"), "price_by_title")
    )
    plan = cleared.withColumn("rule", rule).join(failing, key, "left_semi").select(key, "rule")
    under = lambda name: plan.where(F.col("rule") == name).select(key)
    of = lambda name: nodes.join(under(name), key, "left_semi")
    as_map = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    tables = table_rows(of("table_rows"), limit, key).select(
        key, F.col("item_no").alias("pos"), as_map("team", "year", "wins", "losses").alias("fields")
    )
    quotes = quote_blocks(of("quote_blocks"), limit, key).withColumn("tags", F.array_join("tags", " ")).select(
        key, F.col("item_no").alias("pos"), as_map("text", "author", "tags").alias("fields")
    )
    titled = items.withColumn("title", let(F.col("fields"), lambda m: F.coalesce(m["title"], m["name"], F.lit(""))))
    prices = price_by_title(of("price_by_title"), titled, limit, key)
    rest = F.map_filter("fields", lambda k, _: ~k.isin("title", "price"))
    prices = prices.select(key, "pos", F.map_concat(rest, as_map("title", "price")).alias("fields"))
    rebuilt = tables.unionByName(quotes).unionByName(prices)
    good = evaluate_contract(rebuilt, cleared, [key], ["pos"]).where("is_success").select(key)
    replaced = good.join(failing, key, "left_semi")
    kept = items.join(replaced, key, "left_anti").select(key, "pos", "fields", F.lit("original").alias("record_source"))
    taken = rebuilt.join(replaced, key, "left_semi").join(plan, key).select(key, "pos", "fields", F.col("rule").alias("record_source"))
    return kept.unionByName(taken)

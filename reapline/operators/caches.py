"""Similarity caches as tables: lookup, admission, quarantine, rebinding and new entries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reapline.functions.text import compact_dom, dom_hash, normalize_locator, parse_ts, word_set
from reapline.functions.url import domain_key, let, stripped, url_pattern
from reapline.operators.documents import not_expired
from reapline.operators.retrieval import dense_topk, similarity_of, weighted_vector
from reapline.plans.blocks import hashed_words, near_rows, overlapping_sets
from reapline.plans.ranking import top_k
from reapline.session import durable

# Thresholds, weights and limits of the two staged lookups.
CODE_TASK_MIN, CODE_GOAL_MIN = 0.80, 0.88
DOM_TASK_MIN, DOM_SCORE_MIN = 0.80, 0.90
SITE_ROWS = 8192  # entries and requests of a site that meet in one group, about
DOM_STAGE3 = (0.65, 0.35)
DUPLICATE = 0.95
KINDS = 16  # kinds of descriptors for which elements are cut to their fields
MIN_CODE, MAX_NAVIGATION_CODE = 50, 200


def candidates_in(cache: DataFrame, ids: DataFrame, key: str = "cache_id") -> DataFrame:
    """Restrict a cache to the candidates of an earlier stage."""
    return cache.join(ids.select(key).distinct(), key, "left_semi")


def action_words(*columns: str) -> Column:
    return word_set(F.concat_ws(" ", *columns))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_lookup(requests: DataFrame, cache: DataFrame, k: int = 5, block_rows: int = 32_768) -> DataFrame:
    """Reusable entries of the same site that share most words with a request.

    ``requests``: request_id, domain_key, words.  ``cache``: cache_id, domain_key, words,
    is_success, failure_count.  Without a site, a request meets the entries of all sites and an entry the
    requests of all.  Entries lie in blocks with inverted word lists; a request first
    searches the block whose set sizes promise most, then those that can reach its k-th score
    (``plans.blocks``).  Neither pairs nor visits are shuffled, and a hot site is
    spread over its blocks.
    """
    usable = cache.where(F.coalesce("is_success", F.lit(True)) & (F.coalesce("failure_count", F.lit(0)) < 2))
    part, words = F.col("domain_key").cast("string").alias("part"), hashed_words(F.array_distinct("words")).alias("words")
    stored = usable.select(F.col("cache_id").alias("id"), part, words)
    asked = durable(requests.select(F.monotonically_increasing_id().alias("_row"), "request_id", part, words))
    found = overlapping_sets(stored, asked, k, "cache_id", block_rows)
    named = found.drop("rank").join(asked.select("_row", "request_id"), "_row").select("request_id", "cache_id", "score")
    return top_k(named, ["request_id"], [F.desc("score"), "cache_id"], k)


def multi_vector_lookup(
    requests: DataFrame, cache: DataFrame, vectors: Sequence[str], weights: Sequence[float], k: int, earlier_only: bool = False,
    request_id: str = "request_id", cache_id: str = "cache_id",
) -> DataFrame:
    """k best entries of the same site by a weighted sum of cosine similarities."""
    asked = requests.select(request_id, "domain_key", weighted_vector(vectors, weights).alias("_v"))
    stored = cache.select(cache_id, "domain_key", weighted_vector(vectors).alias("_v"))
    return dense_topk(
        stored, asked, k, doc_id=cache_id, query_id=request_id, vector="_v", part="domain_key", normalize=False, earlier_only=earlier_only
    )


def drop_quarantined(hits: DataFrame, blacklist: DataFrame, now: Column) -> DataFrame:
    """Remove hits whose (type, domain, id) is quarantined and not yet expired."""
    active = blacklist.where(F.col("expire_at") > now).select("cache_type", "domain_key", "cache_id").distinct()
    return hits.join(active, ["cache_type", "domain_key", "cache_id"], "left_anti")


def _near_of_site(
    requests: DataFrame, cache: DataFrame, names: Sequence[str], near_min: float, score_of: Callable, score_min: float, k: int, kind: str
) -> DataFrame:
    """The k best entries of a request's site; a vector that is missing is near nothing, and no score reaches its limit without it."""
    asked = requests.select(F.col("request_id").alias("_id"), F.col("domain_key").alias("part"), *names)
    stored = cache.select(F.col("cache_id").alias("_id"), F.col("domain_key").alias("part"), *names)
    found = near_rows(asked, stored, names, near_min, score_of, score_min, k, SITE_ROWS)
    df = found.select("request_id", "cache_id", F.col("part").alias("domain_key"), F.lit(kind).alias("cache_type"), F.col("near").alias("task_similarity"), "score")
    return top_k(df, ["request_id"], [F.desc("score"), "cache_id"], k)


def _usable(cache: DataFrame, kind: str, blacklist: DataFrame | None, now: Column | None) -> DataFrame:
    """The cache without quarantined entries, before anything is ranked."""
    if blacklist is None:
        return cache
    return drop_quarantined(cache.withColumn("cache_type", F.lit(kind)), blacklist, now).drop("cache_type")


def staged_code_lookup(
    requests: DataFrame, cache: DataFrame, k: int = 3, blacklist: DataFrame | None = None, now: Column | None = None
) -> DataFrame:
    """Stored page code for a task: every usable entry of the site near enough by task and by goal; the k best by goal.

    Vector columns on both sides: task_vector, goal_vector; plus domain_key.
    """
    usable = _usable(cache, "codecache", blacklist, now)
    return _near_of_site(requests, usable, ("task_vector", "goal_vector"), CODE_TASK_MIN, lambda _, goal: goal, CODE_GOAL_MIN, k, "codecache")


def staged_dom_lookup(
    requests: DataFrame, cache: DataFrame, now: Column, k: int = 3, blacklist: DataFrame | None = None
) -> DataFrame:
    """Stored element hints for a page: every valid entry of the site near enough by task, structure and step; the k best.

    Vector columns on both sides: task_vector, dom_vector, step_vector; plus domain_key.
    """
    usable = _usable(not_expired(cache, now), "domcache", blacklist, now)
    score = lambda _, dom, step: dom * DOM_STAGE3[0] + step * DOM_STAGE3[1]
    return _near_of_site(requests, usable, ("task_vector", "dom_vector", "step_vector"), DOM_TASK_MIN, score, DOM_SCORE_MIN, k, "domcache")


def admit(
    candidates: DataFrame, thresholds: Mapping[str, float], ttl_hours: Mapping[str, float], now: Column,
    failed: DataFrame | None = None, task_started_at: Column | None = None, required_version: str = "", allow_legacy: bool = False,
) -> DataFrame:
    """Reason each cached candidate may or may not be used, in a fixed order of tests."""
    per_kind = lambda m: F.create_map(*[x for a, b in m.items() for x in (F.lit(a), F.lit(float(b)))])[F.col("kind")]
    no = F.lit(False)
    df = candidates.withColumn("_at", parse_ts(F.col("created_at").cast("string")))
    if failed is None:
        df = df.withColumn("_failed", no)
    else:
        df = df.join(failed.select("cache_id").distinct().withColumn("_failed", F.lit(True)), "cache_id", "left")
    ttl = per_kind(ttl_hours) if ttl_hours else F.lit(None).cast("double")
    age_hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("_at")) / 3_600_000_000
    version = stripped(F.coalesce("fingerprint_version", F.lit("")))
    started = no if task_started_at is None else F.coalesce(F.col("_at") >= task_started_at.cast("timestamp"), no)
    other = (version != required_version.strip()) if required_version.strip() else no
    reason = (
        F.when(F.coalesce("_failed", no) & (F.coalesce(F.col("cache_id").cast("string"), F.lit("")) != ""), "failed_quarantine")
        .when(F.col("score") < F.coalesce(per_kind(thresholds), F.lit(0.0)), "below_threshold")
        .when(started, "same_run_write")
        .when(F.coalesce((ttl > 0) & (age_hours > ttl), no), "expired")
        .when(other & ((version != "") | F.lit(not allow_legacy)), "fingerprint_version_mismatch")
        .otherwise("eligible")
    )
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "eligible").drop("_at", "_failed")


def rejection_counts(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("allowed")).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("rejected"))


def near_duplicates(
    new: DataFrame, cache: DataFrame, vectors: Sequence[str], weights: Sequence[float], threshold: float = DUPLICATE
) -> DataFrame:
    """Entries to store, marked as duplicate when the cache or an earlier entry is that similar.

    ``new``: entry_id and the vectors.  Only the single best match of an entry is kept at
    any stage, so groups of copies produce no pairs.
    """
    stored = multi_vector_lookup(new, cache, vectors, weights, 1, request_id="entry_id").select(
        "entry_id", F.col("cache_id").cast("string").alias("match"), "score"
    )
    older = new.select(F.col("entry_id").alias("earlier_id"), "domain_key", *vectors)
    inside = multi_vector_lookup(new, older, vectors, weights, 1, earlier_only=True, request_id="entry_id", cache_id="earlier_id").select(
        "entry_id", F.col("earlier_id").cast("string").alias("match"), "score"
    )
    best = stored.unionByName(inside).groupBy("entry_id").agg(F.max("score").alias("best_score"))
    joined = new.drop(*vectors).join(best, "entry_id", "left")
    return joined.withColumn("is_duplicate", F.coalesce(F.col("best_score") >= threshold, F.lit(False)))


def quarantine(failures: DataFrame, ttl_seconds: int, min_ttl: int = 60) -> DataFrame:
    """Failed entries with the time until which they stay out of use."""
    ttl = F.make_dt_interval(secs=F.lit(max(min_ttl, ttl_seconds)))
    kind, site = F.lower(F.trim(F.coalesce("cache_type", F.lit("unknown")))), F.lower(F.trim(F.coalesce("domain_key", F.lit(""))))
    return (
        failures.where(F.coalesce(F.col("cache_id").cast("string"), F.lit("")) != "")
        .groupBy(kind.alias("cache_type"), F.coalesce(F.nullif(site, F.lit("")), F.lit("unknown")).alias("domain_key"), "cache_id")
        .agg((F.max("failed_at") + ttl).alias("expire_at"))
    )


def failure_counts(cache: DataFrame, failures: DataFrame) -> DataFrame:
    """Cache rows with the failures added and the last reason."""
    counted = failures.groupBy("cache_id").agg(F.count(F.lit(1)).alias("_n"), F.max_by("reason", "failed_at").alias("last_failure_reason"))
    df = cache.join(counted, "cache_id", "left")
    return df.withColumn("failure_count", F.coalesce("failure_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def is_navigation_only(code: Column) -> Column:
    """Short code that does nothing but open a page."""
    lines = F.filter(F.split(code, "\n"), lambda x: (stripped(x) != "") & ~stripped(x).startswith("print"))
    opens = F.contains(F.lower(code), F.lit("tab.get(")) | F.contains(F.lower(code), F.lit("tab.get ("))
    return (F.length(code) <= MAX_NAVIGATION_CODE) & opens & (F.size(lines) <= 3)


def cacheable(records: DataFrame) -> DataFrame:
    """Generated code worth storing.  Columns: code, code_source."""
    code = F.coalesce("code", F.lit(""))
    return records.where((F.coalesce("code_source", F.lit("")) != "cache") & (F.length(code) >= MIN_CODE) & ~is_navigation_only(code))


def cache_entries(records: DataFrame, now: Column, ttl_hours: int) -> DataFrame:
    """Rows to store: address pattern, site, structure hash, id and expiry."""
    key = dom_hash("dom")
    stamp = F.date_format(now, "yyyyMMddHHmmss")
    return records.withColumns(
        {
            "url_pattern": url_pattern("url"),
            "domain_key": domain_key("url"),
            "dom_hash": key,
            "cache_id": F.concat(key, F.lit("_"), stamp),
            "dom_text": compact_dom("dom"),
            "created_at": now,
            "expire_at": now + F.make_dt_interval(hours=F.lit(max(1, ttl_hours))),
            "success_count": F.lit(0),
            "fail_count": F.lit(0),
        }
    )


def locator_overlap(failed: DataFrame, candidates: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether the locator that failed is one of the suggested ones, or part of one.

    ``failed``: run, failed_locator.  ``candidates``: run, locator; compared within a run.
    """
    hit = let(
        F.struct(normalize_locator("failed_locator").alias("f"), normalize_locator("locator").alias("c")),
        lambda p: (p["f"] != "") & (p["c"] != "") & (F.contains(p["c"], p["f"]) | F.contains(p["f"], p["c"])),
    )
    hits = failed.join(candidates, key).where(hit).select(key, "failed_locator").distinct().withColumn("overlaps", F.lit(True))
    return failed.join(hits, [key, "failed_locator"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def rebind_targets(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Element a stored action points at on the page of today, or null.

    ``stored``: request_id, snapshot_id, ref, capability, descriptor map, ordinal,
    control_ordinal.  ``current``: snapshot_id, ref, capability, descriptor, ordinal,
    control_ordinal.  Order of tests: same element still fits; one fitting element; one
    fitting element at the same place.  An element fits if it holds every filled entry of
    the descriptor; a descriptor without any fits nothing, a null one fits its own ref.

    Descriptors that fill the same fields are of one kind.  For the common kinds an element
    is cut down to those fields, and what is equal then fits: one exchange, requests and
    elements side by side.  Descriptors of other kinds look up their rarest entry.
    """
    fields = F.array_sort(F.map_keys(_filled("descriptor")))
    kinds = [r[0] for r in stored.where(F.size(fields) > 0).groupBy(fields.alias("k")).count().orderBy(F.desc("count"), "k").limit(KINDS + 1).select("k").collect()]
    if not kinds:
        return _by_rarest_entry(stored, current)
    common = F.coalesce(fields.isin([F.array(*map(F.lit, k)) for k in kinds[:KINDS]]), F.lit(False))
    found = _by_kind(stored.where(common), current, kinds[:KINDS])
    return found if len(kinds) <= KINDS and not _any_unfilled(stored) else found.unionByName(_by_rarest_entry(stored.where(~common), current))


def _filled(column: str) -> Column:
    return F.map_filter(column, lambda _, v: F.coalesce(v != "", F.lit(False)))


def _any_unfilled(stored: DataFrame) -> bool:
    return bool(stored.where(F.coalesce(F.size(_filled("descriptor")) <= 0, F.lit(True))).take(1))


def _by_kind(stored: DataFrame, current: DataFrame, kinds: list[list[str]]) -> DataFrame:
    """Requests whose descriptors fill one of the given lists of fields."""
    page, group = ["snapshot_id", "capability", "ordinal", "control_ordinal"], ["snapshot_id", "capability", "_d"]
    values = lambda k: F.to_json(F.array(*[F.concat(F.lit(f"{len(name)}:{name}="), F.col("descriptor")[name]) for name in k]))
    whole = lambda k: F.when(F.array_contains(F.array(*[F.coalesce(F.col("descriptor")[n] != "", F.lit(False)) for n in k]), False), None).otherwise(values(k))
    fields = F.array_sort(F.map_keys(_filled("descriptor")))
    own = F.coalesce(*[F.when(fields == F.array(*map(F.lit, k)), values(k)) for k in kinds])
    asked = stored.withColumns({"_d": own, "_element": F.lit(False)})
    cuts = F.array_compact(F.array(*map(whole, kinds)))
    held = current.where("snapshot_id is not null").select(*page, "ref", F.explode(cuts).alias("_d"), F.lit(True).alias("_element"))
    both = asked.unionByName(held, allowMissingColumns=True).repartition(*group)
    element = F.col("_element")
    each, place, name = Window.partitionBy(*group), Window.partitionBy(*group, "ordinal", "control_ordinal"), Window.partitionBy(*group, "ref")
    here = F.when(element, F.col("ref"))
    df = both.withColumns({"_n": F.count_if(element).over(each), "_only": F.min(here).over(each)})
    df = df.withColumns({"_pn": F.count_if(element).over(place), "_placed": F.min(here).over(place)})
    df = df.withColumn("_same", F.max(element).over(name)).where(~element)
    how = F.when(F.col("_same") & F.col("ref").isNotNull(), "same").when(F.col("_n") == 1, "descriptor").when(F.col("_pn") == 1, "position")
    rebound = F.when(how == "same", F.col("ref")).when(how == "descriptor", F.col("_only")).when(how == "position", F.col("_placed"))
    return df.select(*stored.columns, rebound.alias("rebound_ref"), how.alias("rebound_by"))


def _by_rarest_entry(stored: DataFrame, current: DataFrame) -> DataFrame:
    """A containment join: each distinct descriptor looks up the elements that hold its
    rarest entry on that page, and only those are compared whole.
    """
    key = ["snapshot_id", "capability"]
    asked = stored.withColumn("_d", F.array_sort(F.map_entries(_filled("descriptor"))))
    now = current.select(
        F.col("snapshot_id").alias("_s"), F.col("capability").alias("_c"), F.col("ref").alias("_ref"), F.col("descriptor").alias("_now"),
        F.col("ordinal").alias("_o"), F.col("control_ordinal").alias("_co"),
    )
    fits = F.forall("_d", lambda e: F.coalesce(F.col("_now")[e["key"]] == e["value"], F.lit(False)))
    here = F.col("_s") == F.col("snapshot_id")
    kind = F.col("_c").eqNullSafe(F.col("capability"))
    still = F.col("_d").isNull() | (kind & (F.size("_d") > 0) & fits)
    same = asked.join(now, here & (F.col("_ref") == F.col("ref")) & still).select("request_id").distinct().withColumn("_same", F.lit(True))

    entries = now.select("*", F.explode(F.map_entries("_now")).alias("_e"))
    often = entries.groupBy("_s", "_c", "_e").agg(F.count(F.lit(1)).alias("_n"))
    wanted = asked.where(F.size("_d") > 0).select(*key, "_d").distinct().select(*key, "_d", F.explode("_d").alias("_w"))
    rarest = (
        wanted.join(often, here & kind & (F.col("_e") == F.col("_w")))
        .groupBy(*key, "_d")
        .agg(F.count(F.lit(1)).alias("_held"), F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
        .where(F.col("_held") == F.size("_d"))
    )
    found = rarest.join(entries, here & kind & (F.col("_e") == F.col("_w"))).where(fits)
    placed = found.groupBy(*key, "_d", "_o", "_co").agg(F.count(F.lit(1)).alias("_pn"), F.min("_ref").alias("_placed"))
    single = placed.groupBy(*key, "_d").agg(F.sum("_pn").alias("_n"), F.min("_placed").alias("_only"))

    def meet(left, right, extra=()):
        right = right.withColumnsRenamed({c: f"_r{c}" for c in (*key, "_d")})
        on = [left[c].eqNullSafe(right[f"_r{c}"]) for c in (*key, "_d")] + [left[a].eqNullSafe(right[b]) for a, b in extra]
        return left.join(right, on, "left").drop(*[f"_r{c}" for c in (*key, "_d")])

    df = meet(meet(asked, single), placed, (("ordinal", "_o"), ("control_ordinal", "_co"))).join(same, "request_id", "left")
    how = F.when(F.col("_same"), "same").when(F.col("_n") == 1, "descriptor").when(F.col("_pn") == 1, "position")
    rebound = F.when(how == "same", F.col("ref")).when(how == "descriptor", F.col("_only")).when(how == "position", F.col("_placed"))
    return df.select(*stored.columns, rebound.alias("rebound_ref"), how.alias("rebound_by"))

"""Repeated structure inside pages: equal siblings, their columns and templates.

Windows here are per parent element of one page, so their size is that of a page.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reapline.operators.html import _RUNS, RUN_SCHEMA, deep_text, sibling_runs


def shape(tag: Column, css: Column, kid_tags: Column, input_type: Column) -> Column:
    """Fingerprint of an element: tag, class, tags of its children, kind of input."""
    parts = F.concat_ws("_", tag, css, F.when(F.size(kid_tags) > 0, F.array_join(kid_tags, "|")), F.when(tag == "input", input_type))
    return F.md5(parts)


def structural_hash(nodes: DataFrame) -> DataFrame:
    """Add the fingerprint over the uncompressed children."""
    kids = (
        nodes.where(F.col("parent_ref").isNotNull()).groupBy("page_id", F.col("parent_ref").alias("ref"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_k"))
        .withColumn("kid_tags", F.transform("_k", lambda k: k["tag"])).drop("_k")
    )
    df = nodes.join(kids, ["page_id", "ref"], "left")
    return df.withColumn("hash", shape(F.col("tag"), F.col("class"), F.col("kid_tags"), F.col("attrs")["type"])).drop("kid_tags")


def _mark_page(page: pa.Table, min_size: int) -> pa.Table:
    refs, parents = page["ref"].to_pylist(), page["parent_ref"].to_pylist()
    known, kids, tops = {r: i for i, r in enumerate(refs) if r is not None}, [[] for _ in refs], {}
    for at in pc.sort_indices(page, sort_keys=[("pos", "ascending"), ("ref", "ascending")]).to_pylist():
        above = known.get(parents[at])
        (tops.setdefault(parents[at], []) if above is None else kids[above]).append(at)
    kinds = [dict(a or ()).get("type") for a in page["attrs"].to_pylist()]
    marks = sibling_runs(list(tops.values()), kids, page["tag"].to_pylist(), page["class"].to_pylist(), kinds, min_size)
    columns = list(zip(*marks))
    for (name, kind), column in zip(_RUNS, columns):
        page = page.append_column(name, pa.array(column, type=kind))
    return page


def compress_siblings(nodes: DataFrame, min_size: int = 3) -> DataFrame:
    """Runs of equal neighbours, found from the deepest level upwards.

    A parent is compared by its children as they look after compression.  Adds ``hash``,
    ``run_no`` and ``run_size`` per parent, ``run_role``: member, first (of a compressed
    run) or single, and ``hidden``: a later member of a run, or below one.

    The rows of a page, which came from one stored document, meet in one call, by one
    exchange.  ``html.html_to_compressed`` gives the same without any, where the pages
    themselves are at hand.
    """
    schema = T.StructType([*nodes.schema.fields, *T.DataType.fromDDL(RUN_SCHEMA).fields])
    return nodes.groupBy("page_id").applyInArrow(lambda page: _mark_page(page, min_size), schema)


def compressed_view(compressed: DataFrame) -> DataFrame:
    """What stays visible: everything but later members of compressed runs and what is below them."""
    return compressed.where(~F.col("hidden")).drop("hidden")


def last_index(xpath: Column) -> Column:
    found = F.regexp_extract(xpath, r"\[(\d+)\]$", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(-1))


def group_columns(compressed: DataFrame, max_described: int = 20) -> DataFrame:
    """One row per compressed run with aligned value arrays and a path template."""
    members = (
        (compressed if "text" in compressed.columns else deep_text(compressed)).where(F.col("run_role") != "single")
        .select(
            "page_id", "parent_ref", "run_no", "pos", "tag", "xpath", "depth",
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("attrs")["href"], F.lit("")).alias("href"),
            F.coalesce(F.col("attrs")["title"], F.lit("")).alias("title"),
        )
    )
    grouped = members.groupBy("page_id", "parent_ref", "run_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "href", "title", "xpath"))).alias("m"),
        F.min_by("tag", "pos").alias("tag"),
        F.min_by("xpath", "pos").alias("_x"),
        F.count(F.lit(1)).alias("count"),
    )
    column = lambda name: F.transform("m", lambda r: r[name])
    template = F.regexp_replace("_x", r"\[\d+\]$", "[{i}]")
    readable = F.filter(column("text"), lambda t: t != "")
    described = F.concat(
        template, F.lit(" ["), F.array_join(F.slice(readable, 1, max_described), ", "),
        F.when(F.size(readable) > max_described, ", ...]").otherwise("]"),
    )
    return grouped.select(
        "page_id", "parent_ref", "run_no", "tag", "count", template.alias("xpath_template"),
        column("text").alias("text"), column("href").alias("href"), column("title").alias("title"),
        F.transform("m", lambda r: last_index(r["xpath"])).alias("index"), described.alias("description"),
    )


def dom_changed(captures: DataFrame, block_seconds: int = 6 * 3600) -> DataFrame:
    """Fingerprint of every capture, and whether it differs from the previous one of the session.

    ``captures``: session, captured_at, capture_id, dom.
    """
    from reapline.functions.text import dom_hash
    from reapline.plans.blocked import Blocked, time_block

    by_time = Blocked(["session"], ["captured_at", "capture_id"], time_block("captured_at", block_seconds))
    hashed = captures.withColumn("dom_hash", dom_hash("dom")).drop("dom")
    df = by_time.lag(hashed, {"_before": "dom_hash"})
    return by_time.done(df.withColumn("changed", ~F.col("dom_hash").eqNullSafe(F.col("_before"))).drop("_before"))

"""Progress of runs against their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.operators.quality import evaluate_contract, merge_items
from reapline.plans.ranking import broadcast_if_small


def progress_summary(events: DataFrame, items: DataFrame, contracts: DataFrame) -> DataFrame:
    """Items, pages, stop reason and open obligations of every run.

    ``events``: run_id, ord, kind (open, filter, collect, scroll, details) and number (page,
    filter or round).  Pages collected before the last filter do not count.  ``contracts``:
    run_id, schema, min_items, target_pages, until_text, filters, scroll_rounds, details,
    open_target.
    """
    kind, number = F.col("kind"), F.col("number")
    # the last place of every page, filter or round decides; few rows of a run are left
    last = events.groupBy("run_id", "kind", "number").agg(F.max("ord").alias("ord"))
    filtered = last.where(kind == "filter").groupBy("run_id").agg(F.max("ord").alias("_last_filter"))
    timed = last.join(filtered, "run_id", "left")
    fresh = (kind == "collect") & (F.col("_last_filter").isNull() | (F.col("ord") > F.col("_last_filter")))
    done = timed.groupBy("run_id").agg(
        F.bool_or(kind == "open").alias("_opened"),
        F.count_distinct(F.when(kind == "filter", number)).alias("_filters"),
        F.count_distinct(F.when(fresh, number)).alias("completed_pages"),
        F.max(F.when(kind == "scroll", number)).alias("_scrolls"),
        F.bool_or(kind == "details").alias("_details"),
    )
    wanted = contracts.select("run_id", F.lower(F.trim("until_text")).alias("_until")).where("_until <> ''")
    met = (
        items.join(broadcast_if_small(wanted), "run_id").groupBy("run_id")
        .agg(F.bool_or(F.contains(F.lower(F.to_json("fields")), F.col("_until"))).alias("_met"))
    )
    judged = evaluate_contract(items, contracts).select("run_id", "item_count", F.col("is_success").alias("_ok"))
    df = contracts.join(done, "run_id", "left").join(judged, "run_id", "left").join(met, "run_id", "left")
    no, zero = F.lit(False), F.lit(0)
    pages = F.coalesce("completed_pages", zero)
    condition = F.coalesce("_met", no)
    pages_done = condition | (pages >= F.greatest(F.col("target_pages"), F.lit(1)))
    unmet = F.array_compact(
        F.array(
            F.when(F.col("open_target") & ~F.coalesce("_opened", no), F.lit("open_target")),
            F.when(F.coalesce("_filters", zero) < F.col("filters"), F.lit("filters")),
            F.when(pages < F.greatest(F.col("target_pages"), F.lit(1)), F.lit("pagination")),
            F.when(F.coalesce("_scrolls", zero) < F.col("scroll_rounds"), F.lit("scroll")),
            F.when(F.col("details") & ~F.coalesce("_details", no), F.lit("details")),
        )
    )
    complete = (F.coalesce("_ok", no) | condition) & pages_done
    df = df.withColumns({"unmet": unmet, "list_complete": complete, "stop_condition_met": condition})
    reason = F.when(condition, F.concat(F.lit("until_text:"), F.col("until_text"))).when(complete, "contract_satisfied").otherwise("")
    is_done = F.col("list_complete") & (F.size("unmet") == 0)
    return df.select(
        "run_id", F.coalesce("item_count", zero).cast("long").alias("item_count"), pages.cast("long").alias("completed_pages"),
        "list_complete", "stop_condition_met", reason.alias("stop_reason"), "unmet", is_done.alias("is_done"),
    )


def merge_page(progress_items: DataFrame, page_items: DataFrame) -> DataFrame:
    """Records of a run after another page: later present values win, positions stay."""
    return merge_items(progress_items.unionByName(page_items, allowMissingColumns=True))
